"""Commands: doctor (the environment), inventory (files under a root), validate (a wide table to a long one with summaries)."""

from __future__ import annotations

import argparse
import json
import platform

from pyspark.sql import SparkSession

from panelia.operators import descriptives
from panelia.sources import files
from panelia.sources.panel import Scale, read_wide


def validate(spark: SparkSession, source: str, target: str, scale: Scale) -> dict[str, int]:
    """Write the long table, minute counts and subject summaries of a wide CSV file; an existing target is an error."""
    panel = read_wide(spark, source, scale).cache()
    tables = {"long": panel, "minutes": descriptives.time_counts(panel), "subjects": descriptives.subject_summary(panel)}
    for name, frame in tables.items():
        files.write_table(frame, f"{target}/{name}")
    counts = {name: frame.count() for name, frame in tables.items()}
    panel.unpersist()
    return counts


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("doctor")
    commands.add_parser("inventory").add_argument("root")
    check = commands.add_parser("validate")
    for name in ("source", "target"):
        check.add_argument(name)
    check.add_argument("--minimum", type=float, default=0.0)
    check.add_argument("--maximum", type=float, default=10.0)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "doctor":
        out = {"python": platform.python_version(), "spark": spark.version, "master": spark.sparkContext.master}
    elif args.command == "inventory":
        out = {r["suffix"]: r["count"] for r in files.scan_files(spark, args.root).groupBy("suffix").count().collect()}
    else:
        out = validate(spark, args.source, args.target, Scale(args.minimum, args.maximum))
    print(json.dumps(out))


if __name__ == "__main__":
    main()
