"""Small files and folders on any file system that Spark can reach."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, label: str = "keyed") -> str:
    """A new folder that the driver and all executors share: below spark.checkpoint.dir where that is
    set, else, in a local session only, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='keystrata-')}"
    return f"{base}/{label}-{uuid.uuid4().hex}"


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self.jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        place, fs = self._at(path)
        return fs.exists(place)

    def names(self, path: str) -> list[str]:
        place, fs = self._at(path)
        if not fs.exists(place):
            return []
        held = self.jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(place))
        if not len(held):
            return []
        folder = f"{held[0].getParent().toString().rstrip('/')}/"
        text = self.jvm.org.apache.commons.lang3.ArrayUtils.toString(held)  # {path,path,…}: one call for all of them
        return sorted(text[1:-1].removeprefix(folder).split(f",{folder}"))

    def ages(self, path: str) -> list[tuple[str, float]]:
        """(name, seconds since the epoch of its last change) of what is in a folder, by name."""
        place, fs = self._at(path)
        return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(place)) if fs.exists(place) else []

    def sizes(self, path: str) -> list[tuple[str, int]]:
        """(name, bytes) of the files in a folder."""
        place, fs = self._at(path)
        return [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(place)] if fs.exists(place) else []

    def plain(self, path: str) -> str:
        """The path without scheme and host."""
        return self._at(path)[0].toUri().getPath()

    def make(self, path: str) -> None:
        place, fs = self._at(path)
        fs.mkdirs(place)

    def delete(self, path: str) -> None:
        place, fs = self._at(path)
        fs.delete(place, True)

    def read(self, path: str):
        place, fs = self._at(path)
        stream = fs.open(place)
        try:
            size = fs.getFileStatus(place).getLen()
            held = self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)
            return json.loads(bytes(held).decode())
        finally:
            stream.close()

    def write(self, path: str, value) -> None:
        """Written beside its place and renamed into it; an existing file is an error."""
        beside, fs = self._at(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        stream.write(bytearray(json.dumps(value, indent=1).encode()))
        stream.close()
        place, _ = self._at(path)
        if fs.exists(place) or not fs.rename(beside, place):
            fs.delete(beside, False)
            raise FileExistsError(f"{path} was written by someone else")
