"""A line-oriented shell: statements end with a semicolon."""

from __future__ import annotations

import atexit
import cmd
import os
import sys
import time

from .plans.statements import KEYWORDS

#: What HELP says of each statement.
HELP = {
    "CREATE": "CREATE TABLE t (c type, ..., PRIMARY KEY (k, ...)) MAPPED BY ([ns.]phys, COLS=[c=fam.qual, ...]) [IN binaryformat|stringformat]",
    "DROP": "DROP TABLE t",
    "ALTER": "ALTER TABLE t ADD c type MAPPED BY (c = fam.qual)  |  ALTER TABLE t DROP c",
    "SHOW": "SHOW TABLES",
    "DESCRIBE": "DESCRIBE t",
    "INSERT": "INSERT INTO TABLE t SELECT ...  |  INSERT INTO TABLE t VALUES (literal, ...)",
    "LOAD": "LOAD [PARALL] DATA [LOCAL] INPATH 'p' INTO TABLE t [FIELDS TERMINATED BY 'regex']",
    "SELECT": "SELECT [DISTINCT] ... FROM ... [JOIN ...] [WHERE] [GROUP BY] [HAVING] [ORDER BY | SORT BY | CLUSTER BY | DISTRIBUTE BY] [LIMIT]",
}


class Shell(cmd.Cmd):
    prompt, more = "keystrata> ", "         > "

    def __init__(self, session, out=sys.stdout):
        super().__init__(stdout=out)
        self.session, self.held = session, []

    def say(self, text: str) -> None:
        print(text, file=self.stdout)

    def onecmd(self, line: str) -> bool:
        word = line.strip().rstrip(";").strip()
        if not self.held and (not word or line.strip().startswith("!")):
            return False
        if not self.held and word.upper() in ("QUIT", "EXIT") or line == "EOF":
            return True
        if not self.held and word.upper().split()[0] == "HELP":
            about = word.upper().split()[1:]
            self.say("\n".join(HELP[a] for a in about if a in HELP) if about else "\n".join(HELP.values()))
            return False
        self.held.append(line)
        if line.rstrip().endswith(";"):
            text, self.held = "\n".join(self.held), []
            self.run(text)
        self.prompt = self.more if self.held else type(self).prompt
        return False

    def run(self, text: str) -> None:
        began = time.time()
        try:
            rows = self.session.sql(text)
            if rows.columns != ["result"]:
                self.say(rows._show_string(1000, False))
            self.say("OK")
        except Exception as e:  # a statement's failure doesn't end the shell
            self.say(f"Error: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
        self.say(f"Time taken: {time.time() - began:.3f} seconds")

    def completenames(self, text: str, *_) -> list[str]:
        return [k for k in sorted({*KEYWORDS, *HELP}) if k.startswith(text.upper())]

    completedefault = completenames


def remember(path: str) -> bool:
    """Take up the lines of earlier shells from a file, and add this one's when it ends; False without readline."""
    try:
        import readline
    except ImportError:
        return False
    if os.path.exists(path):
        readline.read_history_file(path)
    readline.set_history_length(1000)
    atexit.register(readline.write_history_file, path)
    return True


def main() -> None:
    import argparse

    from pyspark.sql import SparkSession

    from .session import KeyedSession

    p = argparse.ArgumentParser(description="SQL over keyed tables")
    p.add_argument("root", help="folder of the tables, shared by the cluster")
    p.add_argument("-e", dest="text", help="run one statement and end")
    args = p.parse_args()
    shell = Shell(KeyedSession(SparkSession.builder.appName("keystrata").getOrCreate(), args.root))
    if args.text:
        shell.run(args.text)
    else:
        remember(os.path.expanduser("~/.keystrata_history"))
        shell.cmdloop()
