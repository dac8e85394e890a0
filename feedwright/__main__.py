"""Command line: ``spark-submit -m``-style entry for clusters, or plain Python for a look at the registry.

python -m feedwright list [--area AREA]
python -m feedwright run --root DIR --out DIR [--format parquet] [--area AREA] [--check NAME ...] [--parallel N]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import run_checks, select_checks
from .session import tune
from .sources import Sources


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="feedwright")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("list", "run"):
        sub = commands.add_parser(name)
        sub.add_argument("--area")
        sub.add_argument("--check", action="append")
        if name == "run":
            sub.add_argument("--root", required=True, help="directory (any file system Spark reads) with one entity each")
            sub.add_argument("--out", required=True)
            sub.add_argument("--format", default="parquet")
            sub.add_argument("--parallel", type=int, default=1)
    args = parser.parse_args(argv)
    if args.command == "list":
        for c in select_checks(args.check, args.area):
            print(f"{c.area:10s} {c.kind:8s} {c.name:28s} {c.about.splitlines()[0]}")
        return 0
    spark = tune(SparkSession.builder.appName("feedwright").getOrCreate())
    sources = Sources.from_files(spark, args.root, fmt=args.format)
    failed = 0
    for r in run_checks(sources, args.out, args.check, args.area, parallel=args.parallel):
        failed += r.passed is False
        print(f"{'-' if r.passed is None else 'ok' if r.passed else 'FAIL':4s} {r.check:28s} {r.rows}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
