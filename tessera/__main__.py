"""``python -m tessera list`` or ``python -m tessera run NAME SF_DIR [--out FOLDER]``."""

from __future__ import annotations

import argparse
import sys

from tessera.plans import catalog


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run one query over a folder of tables")
    run.add_argument("name")
    run.add_argument("sf_dir")
    run.add_argument("--out", help="Parquet folder for the result; without it some rows are shown")
    given = parser.parse_args(args)
    if given.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if given.name not in catalog.QUERIES:
        print(f"no query {given.name}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    df = catalog.QUERIES[given.name](SparkSession.builder.appName(given.name).getOrCreate(), given.sf_dir)
    if given.out:
        df.write.mode("overwrite").parquet(given.out)
    else:
        df.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
