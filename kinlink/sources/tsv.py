"""Tab-separated record files in and out: every field a string, nothing quoted, no value taken for null."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")
SPLITS = ("train", "test")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = RECORD) -> DataFrame:
    """Text as it stands: 'NA', 'null', quotes and backslashes stay, an empty field is ''."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, sep="\t", header=True, quote="", escape="", nullValue="\u0000", emptyValue="", encoding="UTF-8").na.fill("")


def load_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The three sources of a split, with src 1 to 3."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    parts = [read_tsv(spark, f"{folder}/{split}_source{i}.tsv").withColumn("src", F.lit(i).cast("tinyint")) for i in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def parse_ids(x: Column) -> Column:
    """A comma list as an array: trimmed, without blanks, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda i: F.trim(i)), lambda i: i != ""))


def ground_truth(rows: DataFrame) -> DataFrame:
    """(s1_id, ids): the matches of each first-source record; repeated records are united."""
    ids = rows.select(F.col(TRUTH[0]).alias("s1_id"), parse_ids(F.col(TRUTH[1])).alias("ids"))
    return ids.groupBy("s1_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))


def truth_pairs(truth: DataFrame, records: DataFrame) -> DataFrame:
    """(s1, src, idx, country): truth by record keys; records (entity_id, src, idx, country). Raises if an id does not resolve."""
    pairs = truth.select("s1_id", F.explode("ids").alias("rec_id"))
    ones = records.filter("src = 1").select(F.col("entity_id").alias("s1_id"), F.col("idx").alias("s1"), "country")
    others = records.filter("src > 1").select(F.col("entity_id").alias("rec_id"), "src", "idx")
    found = pairs.join(ones, "s1_id", "left").join(others, "rec_id", "left")
    lost = found.filter("s1 is null or idx is null").limit(1).count()
    if lost:
        raise ValueError("the truth names records that are in no source")
    return found.select("s1", "src", "idx", "country")


def read_records(spark: SparkSession, path: str, columns: list[str] | None = None, country: str | None = None, src: int | None = None) -> DataFrame:
    """Stored records; columns and filters reach the scan."""
    rows = spark.read.parquet(path)
    if country is not None:
        rows = rows.filter(F.col("country") == country)
    if src is not None:
        rows = rows.filter(F.col("src") == src)
    return rows.select(*columns) if columns else rows


def id_lists(order: DataFrame, matches: DataFrame) -> DataFrame:
    """(idx, s1_id, ids): for each first-source record its ids sorted, each once, comma-joined; '' without any. order (idx, s1_id), matches (s1_id, rec_id)."""
    lists = matches.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("rec_id")), ",").alias("ids"))
    return order.join(lists, "s1_id", "left").select("idx", "s1_id", F.coalesce("ids", F.lit("")).alias("ids"))


def write_id_lists(lists: DataFrame, path: str, column: str = TRUTH[1]) -> None:
    """One text file in the order of idx, with its header; unquoted."""
    rows = lists.select(F.col("idx").cast("long").alias("idx"), F.concat_ws("\t", "s1_id", "ids").alias("value"))
    head = rows.sparkSession.createDataFrame([(-1, f"{TRUTH[0]}\t{column}")], "idx long, value string")
    rows.unionByName(head).orderBy("idx").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_empty_lists(order: DataFrame, path: str) -> None:
    """Every first-source record without a match."""
    write_id_lists(order.select("idx", "s1_id", F.lit("").alias("ids")), path)


def write_records(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("country").parquet(path)


def write_json(path: str, value: dict) -> None:
    Path(path).write_text(json.dumps(value, indent=1, sort_keys=True, ensure_ascii=False), encoding="utf-8")


def file_scan(lines: DataFrame, columns: int = len(RECORD)) -> DataFrame:
    """Counts over raw lines (value): lines, blanks, carriage returns, byte-order marks, wrong numbers of tabs, quotes."""
    v = F.col("value")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return lines.agg(
        F.count(F.lit(1)).alias("n_lines"),
        count(F.trim(v) == "").alias("n_blank"),
        count(v.contains("\r")).alias("n_cr"),
        count(v.startswith("﻿")).alias("n_bom"),
        count(F.length(v) - F.length(F.replace(v, F.lit("\t"), F.lit(""))) != columns - 1).alias("n_bad_tabs"),
        count(v.contains('"')).alias("n_quotes"),
    )


def run_paths(root: str, tag: str = "") -> dict[str, str]:
    """Where a run keeps its tables, by tag."""
    base = f"{root}/{tag}" if tag else root
    return {name: f"{base}/{name}" for name in ("records", "pairs", "candidates", "features", "predictions", "reports")}


def markdown_table(rows: list[tuple], header: list[str]) -> str:
    """Rows as a markdown table; bars and control characters in cells are written out."""

    def cell(x) -> str:
        text = "" if x is None else f"{x:,.4f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x)
        return "".join(f"\\u{ord(c):04x}" if ord(c) < 32 or ord(c) == 127 else c for c in text).replace("|", "\\|")

    lines = ["| " + " | ".join(header) + " |", "|" + " --- |" * len(header)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])
