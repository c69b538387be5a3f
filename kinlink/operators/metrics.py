"""Scores of matches against the truth, and what the losses are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import seeded
from .blocking import f05


def entity_f05(predicted: Column, true: Column) -> Column:
    """F0.5 of two id arrays taken as sets."""
    p, t = F.array_distinct(predicted), F.array_distinct(true)
    return f05(F.size(F.array_intersect(p, t)), F.size(p), F.size(t))


def per_record(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """truth (s1_id, country, ids) and predicted (s1_id, ids) to (s1_id, country, n_true, n_pred, tp, f05); no prediction is an empty one, predictions for others are ignored."""
    p = predicted.select("s1_id", F.array_distinct("ids").alias("pids"))
    rows = truth.select("s1_id", "country", F.array_distinct("ids").alias("tids")).join(p, "s1_id", "left").withColumn("pids", F.coalesce("pids", F.array().cast("array<string>")))
    return rows.select("s1_id", "country", F.size("tids").alias("n_true"), F.size("pids").alias("n_pred"), F.size(F.array_intersect("tids", "pids")).alias("tp"), entity_f05(F.col("pids"), F.col("tids")).alias("f05"))


def macro(scores: DataFrame) -> DataFrame:
    """(slice, value, n, score): overall, by singleton and by country."""
    whole = scores.agg(F.count(F.lit(1)).alias("n"), F.avg("f05").alias("score")).select(F.lit("overall").alias("slice"), F.lit("all").alias("value"), "n", "score")
    kind = F.when(F.col("n_true") == 0, "singleton").otherwise("matched")
    by_kind = scores.groupBy(kind.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.avg("f05").alias("score")).select(F.lit("type").alias("slice"), "value", "n", "score")
    by_country = scores.groupBy(F.col("country").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.avg("f05").alias("score")).select(F.lit("country").alias("slice"), "value", "n", "score")
    return whole.unionByName(by_kind).unionByName(by_country)


def size_bucket(n: Column) -> Column:
    return F.when(n <= 5, n.cast("string")).when(n <= 10, "6-10").otherwise(">10")


def size_crosstab(scores: DataFrame) -> DataFrame:
    """(true_size, pred_size, n)."""
    return scores.groupBy(size_bucket(F.col("n_true")).alias("true_size"), size_bucket(F.col("n_pred")).alias("pred_size")).agg(F.count(F.lit(1)).alias("n"))


def loss_split(decided: DataFrame, truth: DataFrame) -> DataFrame:
    """Wrong accepts, true pairs refused among the candidates, and true pairs that were no candidates; decided (country, s1, src, idx, label, accepted)."""
    a = decided.agg(F.count_if(F.col("accepted") & (F.col("label") == 0)).alias("false_accepts"), F.count_if(~F.col("accepted") & (F.col("label") == 1)).alias("refused"))
    missed = truth.join(decided, ["country", "s1", "src", "idx"], "left_anti").agg(F.count(F.lit(1)).alias("not_candidates"))
    return a.crossJoin(missed)


def sanity(decided: DataFrame, ones: DataFrame) -> DataFrame:
    """By country: share of first-source records without matches, mean number of matches, mean q of the accepted."""
    per = decided.filter("accepted").groupBy("country", "s1").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("sq"))
    rows = ones.join(per, ["country", "s1"], "left").na.fill(0, ["n"]).na.fill(0.0, ["sq"])
    return rows.groupBy("country").agg(F.avg((F.col("n") == 0).cast("double")).alias("share_empty"), F.avg("n").alias("mean_size"), F.when(F.sum("n") > 0, F.sum("sq") / F.sum("n")).alias("mean_q"))


def best_per_group(results: DataFrame, group: list[str]) -> DataFrame:
    """The best configuration of each group of results (.., name, score); the first by name among equals."""
    return results.groupBy(*group).agg(F.min_by(F.struct("name", "score"), F.struct((-F.col("score")).alias("s"), "name")).alias("b")).select(*group, "b.name", "b.score")


def mistakes(decided: DataFrame, kind: str, n: int = 15, seed: int = 42) -> DataFrame:
    """A seeded sample of n wrong accepts ('fp') or refused true pairs ('fn'); a listing for a report."""
    wrong = F.col("accepted") & (F.col("label") == 0) if kind == "fp" else ~F.col("accepted") & (F.col("label") == 1)
    key = ["country", "s1", "src", "idx"]
    return decided.filter(wrong).orderBy(seeded(key, seed), *key).limit(n)


def set_sizes(decided: DataFrame, ones: DataFrame) -> DataFrame:
    """Mean number of accepted candidates by country, records without any included."""
    per = decided.filter("accepted").groupBy("country", "s1").agg(F.count(F.lit(1)).alias("n"))
    return ones.join(per, ["country", "s1"], "left").groupBy("country").agg(F.avg(F.coalesce("n", F.lit(0))).alias("mean_size"))


def match_counts(lists: Column) -> Column:
    """The number of ids in a comma list; 0 in an empty one."""
    return F.when(lists == "", 0).otherwise(F.size(F.split(lists, ",")))


def choose_variant(scores: list[tuple[str, float, int]], tolerance: float = 0.0005, banned: tuple[str, ...] = ()) -> str:
    """The variant (name, score, complexity) to take: of those within the tolerance of the best that may be taken the simplest, then the best, then the first by name."""
    allowed = [v for v in scores if not v[0].startswith(banned)] if banned else list(scores)
    best = max(s for _, s, _ in allowed)
    return min((v for v in allowed if v[1] >= best - tolerance), key=lambda v: (v[2], -v[1], v[0]))[0]


def probe(decided: DataFrame, countries: list[str]) -> DataFrame:
    """decided with the matches of some countries taken back, to see what they are worth."""
    return decided.withColumn("accepted", F.col("accepted") & ~F.col("country").isin(countries))
