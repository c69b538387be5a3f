"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact word length. Each source's budget first buys whole rounds of all its documents; of the rest every length gets its share, longest first, and what rounding leaves is filled by bounded-knapsack dynamic programming over the lengths still in stock. The fitted number of documents of each length is then drawn in a seeded order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, staged, table

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = 20240613
LEVELS, _BITS = 3, 6  # times the seeded hash is counted by so many more of its bits before any document is ranked
MOST_BUDGET = 1 << 22  # words that the knapsack's table covers; 5 bytes each


def sized(docs: DataFrame, seed: int = SEED, *more) -> DataFrame:
    """(doc_id, source, skey, size, h) and the columns more; skey is never null, so that a null source joins like any other. h is the place in the draw; without a doc_id the text gives it."""
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source.alias("source"),
        F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)).alias("skey"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id").cast("long"), F.when(F.col("doc_id").isNull(), F.xxhash64(text)), F.lit(seed)).alias("h"),
        *more,
    )


def targets(sources: DataFrame) -> DataFrame:
    """(skey, source, source_size) to the same with target. One row per source goes through one task; nothing else does.

    All sizes together are shared by weight. Sorted by what a weight's unit may hold, the sources that stop at their most come first; the others share the rest evenly by weight, which is where repeated resharing of the excess ends.
    """
    dec = "decimal(38,0)"
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    x = sources.withColumn("w", weight.cast("long"))
    unit = 1
    for w in WEIGHTS:
        unit = int(np.lcm(unit, w))
    x = x.withColumn("room", F.col("source_size") * F.expr(f"{unit} div w"))
    order = Window.orderBy("room", "skey")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    x = (
        x.withColumn("at", F.row_number().over(order))
        .withColumn("left", (F.sum("source_size").over(everything) - MOST_COPIES * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast(dec))
        .withColumn("wleft", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    )
    x = x.withColumn("full", (MOST_COPIES * F.col("source_size")).cast(dec) * F.col("wleft").cast("decimal(20,0)") <= F.col("left") * F.col("w").cast("decimal(10,0)"))
    x = x.withColumn("first", F.min(F.when(~F.col("full"), F.struct("at", "left", "wleft"))).over(everything))
    return x.select(
        "skey",
        "source",
        "source_size",
        F.when(F.col("first").isNull() | (F.col("at") < F.col("first.at")), (MOST_COPIES * F.col("source_size")).cast("double"))
        .otherwise(F.col("first.left").cast("double") * F.col("w") / F.col("first.wleft"))
        .alias("target"),
    )


def subset(stock: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many of each length to take, from (length, count), so that their sum is the largest that fits the budget.

    Counts are split into powers of two; for each sum the first parcel that reached it is kept, so the way back takes no parcel twice.
    """
    if budget <= 0:
        return {}
    parcels: list[tuple[int, int]] = []
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    by = np.full(budget + 1, -1, np.int32)
    for length, count in stock:
        count = min(count, budget // length) if length else 0
        step = 1
        while count and not reach[budget]:
            many = min(step, count)
            weight = length * many
            fresh = reach[:-weight] & ~reach[weight:]
            by[weight:][fresh] = len(parcels)
            reach[weight:] |= fresh
            parcels.append((length, many))
            count -= many
            step *= 2
    at = int(np.flatnonzero(reach)[-1])
    taken: dict[int, int] = {}
    while at:
        length, many = parcels[by[at]]
        taken[length] = taken.get(length, 0) + many
        at -= length * many
    return taken


def fit(sizes: list[int], counts: list[int], target: float) -> tuple[int, list[int]]:
    """Whole rounds of all documents, and how many documents of each length get one copy more."""
    total = sum(s * n for s, n in zip(sizes, counts))
    if total == 0:
        return 0, [0] * len(sizes)
    budget = min(int(target + 0.5), MOST_COPIES * total)
    rounds, rest = divmod(budget, total)
    extra = [0] * len(sizes)
    taken = cumulated = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if sizes[i]:
            cumulated += sizes[i] * counts[i]
            extra[i] = max(0, min(counts[i], (cumulated * rest // total - taken) // sizes[i]))
            taken += extra[i] * sizes[i]
    if rest and taken < rest:  # a few short documents go back, so that what is left to fill meets enough lengths
        back, enough = 0, min(2 * max(sizes), MOST_BUDGET // 2)
        for most in (4, max(counts)):
            for i in sorted(range(len(sizes)), key=sizes.__getitem__):
                if back >= enough:
                    break
                if sizes[i]:
                    many = min(extra[i], most, -(-(enough - back) // sizes[i]))
                    extra[i] -= many
                    back += many * sizes[i]
        taken -= back
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):  # what the table does not cover is filled longest first
        over = rest - taken - MOST_BUDGET
        if over <= 0:
            break
        if sizes[i]:
            many = min(counts[i] - extra[i], (rest - taken) // sizes[i], -(-over // sizes[i]))
            extra[i] += many
            taken += many * sizes[i]
    stock = [(s, n - e) for s, n, e in zip(sizes, counts, extra) if n > e and 0 < s <= rest - taken]
    more = subset(stock, min(rest - taken, sum(s * n for s, n in stock)))
    return rounds, [e + more.get(s, 0) for s, e in zip(sizes, extra)]


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")  # rows come in any order, and the choice must not depend on it
    rounds, extra = fit([int(x) for x in pdf["size"]], [int(x) for x in pdf["n"]], float(pdf["target"].iloc[0]))
    return pd.DataFrame({"skey": pdf["skey"], "size": pdf["size"], "n": pdf["n"], "source_size": pdf["source_size"], "target": pdf["target"], "rounds": rounds, "extra": extra})


def edges(rows: DataFrame) -> DataFrame:
    """(g, at, need): in each group the leaf of the hash at which the documents taken end, and how many of that leaf are, from rows (g, h, extra).

    Counted by leaf once; then each level looks at the few bins of the one bin that the level before ended in, so no window sees more than 64 rows of a group.
    """
    leaf = F.shiftrightunsigned("h", 64 - LEVELS * _BITS)
    counts = staged(rows.groupBy("g", leaf.alias("leaf")).agg(F.count(F.lit(1)).alias("c"), F.first("extra").alias("need")))
    edge = None
    for level in range(1, LEVELS + 1):
        down = (LEVELS - level) * _BITS
        some = counts if edge is None else counts.drop("need").join(edge, "g").filter(F.shiftright("leaf", down + _BITS) == F.col("at"))
        bins = some.groupBy("g", F.shiftright("leaf", down).alias("bin")).agg(F.sum("c").alias("c"), F.first("need").alias("need"))
        until = F.sum("c").over(Window.partitionBy("g").orderBy("bin"))
        edge = bins.withColumn("until", until).filter((F.col("until") >= F.col("need")) & (F.col("until") - F.col("c") < F.col("need")))
        # written, as it is one row a group at most: joined right behind its window, it would keep the other side from being split
        edge = staged(edge.select("g", F.col("bin").alias("at"), (F.col("need") - F.col("until") + F.col("c")).alias("need")))
    return edge


_GROUP = ("size", "skey")


def _named():
    """A group's name. Groups are named anew for each step: a step that shared a join's keys would keep a hot group of it in one task."""
    return F.concat_ws("|", *(F.col(c).cast("string") for c in _GROUP))


def fitted(rows: DataFrame) -> DataFrame:
    """What is taken of each source and length, from sized rows: (size, skey, n, source_size, target, rounds, extra, at, need)."""
    lengths = staged(rows.groupBy("skey", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    goals = targets(lengths.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    planned = lengths.join(goals.select("skey", "source_size", "target"), "skey")
    plan = staged(planned.groupBy("skey").applyInPandas(_plan, "skey string, size long, n long, source_size long, target double, rounds long, extra long"))
    some = rows.join(plan.filter((F.col("extra") > 0) & (F.col("extra") < F.col("n"))).select(*_GROUP, "extra"), list(_GROUP))
    edge = edges(some.select(_named().alias("g"), "h", "extra"))
    return staged(plan.withColumn("g", _named()).join(edge, "g", "left").drop("g"))


def drawn(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with source_size, target and taken."""
    rows = rows.join(plan, list(_GROUP)).withColumn("leaf", F.shiftrightunsigned("h", 64 - LEVELS * _BITS))
    at_edge = F.coalesce(F.col("leaf") == F.col("at"), F.lit(False))
    ranked = rows.filter(at_edge).withColumn("r", F.concat(_named(), F.lit("|")))
    ranked = ranked.withColumn("more", F.row_number().over(Window.partitionBy("r").orderBy("h", "doc_id")) <= F.col("need")).drop("r")
    more = (F.col("extra") >= F.col("n")) | F.coalesce(F.col("leaf") < F.col("at"), F.lit(False))
    everything = rows.filter(~at_edge).withColumn("more", more).unionByName(ranked)
    return everything.withColumn("taken", (F.col("rounds") + F.col("more").cast("long")) * F.col("size"))


OUT = ("doc_id", "source", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of docs.

    A null or empty text has size 0 and is taken 0 times. A null source is a source, the last one. Repeated rows are documents of their own. The plan of a source is made from one row per distinct length, however many documents it has; the documents of a length are counted by seeded leaves and only those in the leaf where the count ends are ranked, by (hash, doc_id). Reruns agree. Columns other than doc_id, text and source are ignored. An empty table gives no rows.
    """
    # rows without doc_id that share source and size come out alike, so any of them may be drawn; equal texts of theirs are dealt out
    salted = F.when(F.col("doc_id").isNull(), F.xxhash64("h", F.monotonically_increasing_id())).otherwise(F.col("h"))
    rows = staged(sized(docs, seed).withColumn("h", salted))
    return drawn(rows, fitted(rows)).select(*OUT)


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of docs that the mix takes, with all their columns, and size, source_size, target, taken (words, repeats counted) and copies (how often the row is taken).

    Rows are as for mix(); those of equal texts and no doc_id share a place in the draw, so that both readings of docs agree.
    """
    plan = fitted(staged(sized(docs, seed)))
    own = F.struct(*(F.col(c) for c in docs.columns)).alias("own")
    rows = drawn(sized(docs, seed, own), plan).filter("taken > 0")
    return rows.select("own", "size", "source_size", "target", "taken", F.expr("taken div size").alias("copies")).select("own.*", "size", "source_size", "target", "taken", "copies")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op9_source_mix": op9}
ORACLES: dict[str, str] = {}
