import re
import subprocess
import sys

import __spark_entry__ as entry


def test_names_and_flagship(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert entry.entry(spark).count() > 0


def test_imports_without_the_optional_part(tmp_path):
    """As when the folder and the pipeline are gone."""
    code = "import sys; sys.modules['keystrata.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), *[n for n in e.queries() if n.startswith('op')])"
    root = re.sub(r"/__spark_entry__\.py$", "", entry.__file__)
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout.split()[0]) > 80 and len(done.stdout.split()) == 1
