"""Command line: ``spark-submit -m faultlens`` style full run."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from faultlens.model import DEFAULT_COMMAND, Options
from faultlens.plans.report import analyze_conf


def main() -> None:
    parser = argparse.ArgumentParser(prog="faultlens", description=__doc__)
    parser.add_argument("conf", help="text file with one log directory per line")
    parser.add_argument("out", help="folder for the counts and the error lines")
    parser.add_argument("--command", default=DEFAULT_COMMAND)
    parser.add_argument("--as-of", help="time that stands in for a missing command bound")
    parser.add_argument("--on-duplicate", choices=("union", "last"), default="union")
    parser.add_argument("--details-format", choices=("parquet", "json", "text"), default="parquet")
    for name in Options.__dataclass_fields__:
        parser.add_argument(f"--{name.replace('_', '-')}", action="store_true")
    args = parser.parse_args()

    spark = SparkSession.builder.appName("faultlens").getOrCreate()
    options = Options(**{name: getattr(args, name) for name in Options.__dataclass_fields__})
    report = analyze_conf(
        spark,
        args.conf,
        command=args.command,
        as_of=args.as_of,
        on_duplicate=args.on_duplicate,
        options=options,
    ).persist()
    report.write(args.out, args.details_format)
    report.close()


if __name__ == "__main__":
    main()
