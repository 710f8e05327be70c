"""python -m lodestone [--root FOLDER] [--table NAME=PATH ...] (-e SQL | -f FILE): run a script, print JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from .errors import EngineError
from .session import Session
from .streaming import results


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    parser.add_argument("--root", help="folder of stored tables")
    parser.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="a Parquet path to read as a table")
    parser.add_argument("--user", help="check grants for this user")
    parser.add_argument("--diagnose", action="store_true", help="report errors only, run nothing")
    what = parser.add_mutually_exclusive_group(required=True)
    what.add_argument("-e", "--execute")
    what.add_argument("-f", "--file")
    options = parser.parse_args(argv)
    if options.execute is not None:
        script = options.execute
    else:
        with open(options.file, encoding="utf-8") as f:
            script = f.read()
    from pyspark.sql import SparkSession

    session = Session(SparkSession.builder.getOrCreate(), options.root, options.user)
    for name, path in (x.split("=", 1) for x in options.table):
        session.attach(name, path)
    try:
        if options.diagnose:
            found = session.diagnostics(script)
            for e in found:
                print(json.dumps({"code": e.code, "kind": e.kind, "message": e.message, "line": e.line, "column": e.column}, ensure_ascii=False))
            return int(bool(found))
        for r in session.run_script(script if script.rstrip().endswith(";") else script + ";"):
            if r.data is None:
                print(json.dumps({"kind": r.kind, "affectedRows": r.affected_rows, "commitState": r.commit_state}))
            else:
                for line in results.ndjson(r.data, r.columns, r.column_types):
                    print(line)
    except EngineError as e:
        print(json.dumps({"error": str(e), "code": e.code}), file=sys.stderr)
        return 1
    finally:
        session.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
