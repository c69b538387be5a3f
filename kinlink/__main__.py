"""Runs registered queries: python -m kinlink TABLES OUT QUERY [QUERY ..], also under spark-submit; each result goes to OUT/QUERY as Parquet. --list names them."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import registry
from .workers import reachable


def main() -> None:
    parser = argparse.ArgumentParser(prog="kinlink", description=__doc__)
    parser.add_argument("tables", nargs="?", help="folder of the tables")
    parser.add_argument("out", nargs="?", help="folder of the results")
    parser.add_argument("queries", nargs="*")
    parser.add_argument("--list", action="store_true")
    args = parser.parse_args()
    known = registry.queries()
    if args.list:
        print("\n".join(sorted(known)))
        return
    if not args.queries or (strange := set(args.queries) - set(known)):
        parser.error(f"unknown queries: {', '.join(sorted(strange))}" if args.queries else "name a query, or --list")
    spark = SparkSession.builder.appName("kinlink").getOrCreate()
    reachable(spark)
    for name in args.queries:
        known[name](spark, args.tables).write.mode("overwrite").option("compression", "zstd").parquet(f"{args.out}/{name}")


if __name__ == "__main__":
    main()
