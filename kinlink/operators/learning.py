"""The learned pruner, the slim selection, the classifier with its folds, and calibration; trees from Spark ML.

Samples are taken by hashes of keys, so they are the same everywhere. Tree learners here know no missing values: nulls become a constant and an indicator.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocking import f05, with_counts, with_ranks

PAIR = ["country", "s1", "src", "idx"]
ID_COLUMNS = {*PAIR, "label", "fold", "p", "p_raw", "p_m0", "p_m1", "model"}
PRUNER_SHARE, TRAIN_SHARE, EARLY_SHARE = 0.03, 0.30, 0.10
PRUNER_GRID_K, PRUNER_GRID_BIG_K, PRUNER_MOST, PRUNER_TOLERANCE = (2, 3, 5), (10, 15, 20), 50_000_000, 0.001
SLIM_TAU, SLIM_K, SLIM_BIG_K = 0.02, 3, 15
SLIM_TAUS, SLIM_LOSS = (0.002, 0.005, 0.01, 0.02, 0.05), 0.0007
CALIBRATION_GAP = 0.03
MISSING = -1.0


def half(entity_id: Column) -> Column:
    """The fold of a record: the last bit of its id's CRC-32."""
    return F.crc32(entity_id.cast("string").cast("binary")).bitwiseAND(1).cast("int")


def share_of(key: Column, share: float, salt: str) -> Column:
    """Whether a key is in a seeded sample of this share."""
    first = F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(salt)).cast("binary")), 1, 8)
    return F.conv(first, 16, 10).cast("long") < F.lit(int(share * 2**32))


def feature_columns(rows: DataFrame, drop: tuple[str, ...] = ()) -> list[str]:
    """Every numeric column that is no key."""
    return [n for n, t in rows.dtypes if n not in ID_COLUMNS and n not in drop and t in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")]


def filled(rows: DataFrame, columns: list[str], nullable: list[str]) -> tuple[DataFrame, list[str]]:
    """rows with nulls made MISSING and, for the nullable columns, indicators; and all columns to learn from."""
    rows = rows.withColumns({f"{c}_missing": (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double") for c in nullable})
    rows = rows.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(MISSING)) for c in columns})
    return rows, [*columns, *(f"{c}_missing" for c in nullable)]


def train_trees(rows: DataFrame, columns: list[str], rounds: int = 20, depth: int = 5, validation: str | None = None, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees for label; with validation, a boolean column, rounds stop when its rows gain no more."""
    trees = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed, cacheNodeIds=False)
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep"), trees]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame, out: str = "p") -> DataFrame:
    drop = [c for c in ("rawPrediction", "probability", "prediction", "_x")]
    return model.transform(rows).withColumn(out, vector_to_array("probability")[1].cast("float")).drop(*drop)


def importances(model: PipelineModel, columns: list[str]) -> list[tuple[str, float]]:
    """Columns by gain, the largest first."""
    return sorted(zip(columns, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))


def rank_shift(a: list[tuple[str, float]], b: list[tuple[str, float]]) -> list[tuple[str, int]]:
    """How many places each column moved between two models, the largest moves first."""
    at = {c: i for i, (c, _) in enumerate(b)}
    return sorted(((c, at[c] - i) for i, (c, _) in enumerate(a) if c in at), key=lambda x: (-abs(x[1]), x[0]))


def pruner_sample(pairs: DataFrame, share: float = PRUNER_SHARE) -> DataFrame:
    """All pairs of a share of first-source records."""
    return pairs.filter(share_of(F.concat_ws("|", "country", F.col("s1").cast("string")), share, "pruner"))


def pruner_ranks(pairs: DataFrame) -> DataFrame:
    return with_ranks(pairs, "pscore", "prank_s", "prank_r")


def pruned(pairs: DataFrame, k: int, big_k: int) -> DataFrame:
    """Pairs by the pruner's ranks, ranked anew by score and by pscore, with counts."""
    kept = pairs.filter((F.col("prank_r") <= k) | (F.col("prank_s") <= big_k))
    for c in ("rank_s", "rank_r", "prank_s", "prank_r"):
        kept = kept.withColumnRenamed(c, f"{c}_all")
    return with_counts(with_ranks(with_ranks(kept), "pscore", "prank_s", "prank_r"))


def slim(pairs: DataFrame, tau: float = SLIM_TAU, big_k: int = SLIM_BIG_K, k: int = SLIM_K) -> DataFrame:
    """Pairs of pscore tau or more among both sides' best; rank then filter, as tau keeps a prefix of the ranks."""
    kept = pairs.filter((F.col("pscore") >= tau) & (F.col("prank_s") <= big_k) & (F.col("prank_r") <= k))
    for c in ("rank_s", "rank_r", "prank_s", "prank_r"):
        kept = kept.withColumnRenamed(c, f"{c}_all")
    return with_counts(with_ranks(with_ranks(kept), "pscore", "prank_s", "prank_r"))


def slim_curve(pairs: DataFrame, truth_sizes: DataFrame, taus: tuple[float, ...] = SLIM_TAUS, loss: float = SLIM_LOSS) -> DataFrame:
    """Per tau, in one pass: pairs kept, mean candidates, the oracle score, and the choice: the fewest pairs that lose no more than loss against the best. truth_sizes (country, s1, t) of all first-source records."""
    base = (F.col("prank_s") <= SLIM_BIG_K) & (F.col("prank_r") <= SLIM_K)
    agg = [x for i, t in enumerate(taus) for x in (F.count_if(base & (F.col("pscore") >= t)).alias(f"n{i}"), F.count_if(base & (F.col("pscore") >= t) & (F.col("label") == 1)).alias(f"h{i}"))]
    rows = truth_sizes.join(pairs.groupBy("country", "s1").agg(*agg), ["country", "s1"], "left").na.fill(0)
    cells = F.array(*(F.struct(F.lit(t).alias("tau"), F.col(f"n{i}").alias("n"), f05(F.col(f"h{i}"), F.col(f"h{i}"), F.col("t")).alias("f")) for i, t in enumerate(taus)))
    table = rows.select(F.explode(cells).alias("c")).groupBy("c.tau").agg(F.sum("c.n").alias("n_pairs"), F.avg("c.n").alias("mean_cand"), F.avg("c.f").alias("oracle"))
    best = table.agg(F.max("oracle").alias("top"))
    table = table.crossJoin(F.broadcast(best)).withColumn("near", F.col("oracle") >= F.col("top") - loss)
    pick = table.filter("near").agg(F.min(F.struct("n_pairs", (-F.col("tau")).alias("t"))).alias("b"))
    return table.crossJoin(F.broadcast(pick)).select("tau", "n_pairs", "mean_cand", "oracle", (F.struct("n_pairs", (-F.col("tau")).alias("t")) == F.col("b")).alias("chosen"))


def folds(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with fold; ids (country, s1, entity_id)."""
    return rows.join(ids.select("country", "s1", half(F.col("entity_id")).alias("fold")), ["country", "s1"])


def out_of_fold(rows: DataFrame, columns: list[str], share: float = TRAIN_SHARE, rounds: int = 20, depth: int = 5) -> tuple[DataFrame, list[PipelineModel]]:
    """Predictions of each half by the model of the other; models learn from a share of first-source records, a tenth of it for early stopping."""
    key = F.concat_ws("|", "country", F.col("s1").cast("string"))
    marked = rows.withColumns({"_use": share_of(key, share, "train"), "_stop": share_of(key, EARLY_SHARE, "stop")})
    models, parts = [], []
    for h in (0, 1):
        train = marked.filter((F.col("fold") == h) & F.col("_use"))
        models.append(train_trees(train, columns, rounds, depth, validation="_stop"))
        parts.append(predict(models[-1], rows.filter(F.col("fold") != h)).withColumn("model", F.lit(h).cast("tinyint")))
    return parts[0].unionByName(parts[1]), models


def averaged(rows: DataFrame, models: list[PipelineModel]) -> DataFrame:
    """p as the mean of the folds' models, which stay as p_m0 and p_m1."""
    for i, m in enumerate(models):
        rows = predict(m, rows, f"p_m{i}")
    return rows.withColumn("p", ((F.col("p_m0") + F.col("p_m1")) / 2).cast("float"))


def calibration_table(rows: DataFrame, p: str = "p") -> DataFrame:
    """(bin, n, mean_p, rate, gap) over ten bins."""
    t = rows.groupBy(F.least(F.floor(F.col(p).cast("double") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(p).cast("double")).alias("mean_p"), F.avg(F.col("label").cast("double")).alias("rate"))
    return t.withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))


def calibrate(rows: DataFrame, p: str = "p") -> tuple[DataFrame, IsotonicRegressionModel | None]:
    """Isotonic calibration if the worst bin's gap exceeds CALIBRATION_GAP; p before it is p_raw."""
    worst = calibration_table(rows, p).agg(F.max("gap")).first()[0]
    if worst is None or worst <= CALIBRATION_GAP:
        return rows, None
    model = IsotonicRegression(featuresCol="_f", labelCol="_l").fit(rows.select(F.col(p).cast("double").alias("_f"), F.col("label").cast("double").alias("_l")))
    out = model.setPredictionCol("_q").transform(rows.withColumn("_f", F.col(p).cast("double")))
    return out.withColumn("p_raw", F.col(p)).withColumn(p, F.least(F.greatest("_q", F.lit(0.0)), F.lit(1.0)).cast("float")).drop("_q", "_f"), model


def log_loss(rows: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    c = F.least(F.greatest(F.col(p).cast("double"), F.lit(1e-7)), F.lit(1 - 1e-7))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("label") == 1, -F.log(c)).otherwise(-F.log(1 - c))).alias("logloss"))


def area_by(rows: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """(.., n, auc): the area under the ROC curve of each group, null where a class is missing; from counts by distinct p, equal ones counting half."""
    rows = rows.select(*by, F.col(p).alias("_p"), F.col("label").cast("long").alias("_y"))
    sizes = rows.groupBy(*by, "_p").agg(F.sum("_y").alias("a"), F.sum(1 - F.col("_y")).alias("b"))
    below = F.coalesce(F.sum("b").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = sizes.withColumn("w", F.col("a") * (below + F.col("b") / 2)).groupBy(*by).agg(F.sum("w").alias("w"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return won.select(*by, (F.col("a") + F.col("b")).alias("n"), F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("w") / (F.col("a") * F.col("b"))).alias("auc"))


def area(rows: DataFrame, p: str = "p") -> float:
    """The area under the ROC curve."""
    return area_by(rows.withColumn("_all", F.lit(1)), ["_all"], p).first()["auc"]


def leave_country_out(rows: DataFrame, columns: list[str], source: str, target: str, rounds: int = 20) -> DataFrame:
    """Predictions of a country's pairs by a model of another."""
    return predict(train_trees(rows.filter(F.col("country") == source), columns, rounds), rows.filter(F.col("country") == target))


def pseudo_labels(rows: DataFrame, share: float = TRAIN_SHARE, high: float = 0.97, low: float = 0.03) -> DataFrame:
    """Confident pairs of a share of first-source records, labelled by their own p."""
    key = F.concat_ws("|", "country", F.col("s1").cast("string"))
    sure = rows.filter(share_of(key, share, "pseudo") & ((F.col("p") >= high) | (F.col("p") <= low)))
    return sure.withColumn("label", (F.col("p") >= high).cast("tinyint"))


def adversarial(a: DataFrame, b: DataFrame, columns: list[str], rounds: int = 10, top: int = 15) -> tuple[float, list[tuple[str, float, float, float]]]:
    """How well a model tells two splits apart, and its top columns with their means in both."""
    key = F.concat_ws("|", "country", F.col("s1").cast("string"))
    rows = a.select(*PAIR, *columns).withColumn("label", F.lit(0)).unionByName(b.select(*PAIR, *columns).withColumn("label", F.lit(1)))
    rows = rows.withColumn("_held", share_of(key, 0.3, "adversarial"))
    model = train_trees(rows.filter(~F.col("_held")), columns, rounds)
    score = area(predict(model, rows.filter("_held")))
    means = {r["label"]: r for r in rows.groupBy("label").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns)).collect()}
    return score, [(c, g, means[0][c], means[1][c]) for c, g in importances(model, columns)[:top]]


def refit_with_pseudo(rows: DataFrame, scored: DataFrame, columns: list[str], source: str, target: str, rounds: int = 20, high: float = 0.97, low: float = 0.03) -> DataFrame:
    """Predictions of the target country's pairs by a model of the source country's labelled pairs and the target's confident ones; scored has p for the target's pairs."""
    sure = pseudo_labels(scored.filter(F.col("country") == target), high=high, low=low).select(*PAIR, F.col("label").cast("int").alias("label"))
    own = rows.filter(F.col("country") == target)
    train = rows.filter(F.col("country") == source).unionByName(own.drop("label").join(sure, PAIR).select(*rows.columns))
    return predict(train_trees(train, columns, rounds), own)


def augmented(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows with the further columns of more, a table of a later stage that has each pair once; pairs that it lacks get nulls, pairs of its own go."""
    new = [c for c in more.columns if c not in rows.columns]
    return rows.join(more.select(*PAIR, *new), PAIR, "left")


def save_models(models: list[PipelineModel], path: str) -> None:
    """Each model in a folder of its own, by number; what was there is replaced."""
    for i, m in enumerate(models):
        m.write().overwrite().save(f"{path}/model_{i}")


def load_models(path: str, n: int) -> list[PipelineModel]:
    return [PipelineModel.load(f"{path}/model_{i}") for i in range(n)]


def pruner_grid(pairs: DataFrame, truth_sizes: DataFrame, most: int = PRUNER_MOST, tolerance: float = PRUNER_TOLERANCE) -> DataFrame:
    """(k, big_k, n_pairs, oracle, chosen): every choice of the pruner's ranks in one pass, pairs (.., prank_s, prank_r, label). Chosen are the fewest pairs that stay within the budget of most pairs and within the tolerance of the best score there; truth_sizes (country, s1, t) of all first-source records."""
    grid = [(k, big) for k in PRUNER_GRID_K for big in PRUNER_GRID_BIG_K]
    keep = [(F.col("prank_r") <= k) | (F.col("prank_s") <= big) for k, big in grid]
    agg = [x for i, c in enumerate(keep) for x in (F.count_if(c).alias(f"n{i}"), F.count_if(c & (F.col("label") == 1)).alias(f"h{i}"))]
    rows = truth_sizes.join(pairs.groupBy("country", "s1").agg(*agg), ["country", "s1"], "left").na.fill(0)
    cells = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(big).alias("big_k"), F.col(f"n{i}").alias("n"), f05(F.col(f"h{i}"), F.col(f"h{i}"), F.col("t")).alias("f")) for i, (k, big) in enumerate(grid)))
    table = rows.select(F.explode(cells).alias("c")).groupBy("c.k", "c.big_k").agg(F.sum("c.n").alias("n_pairs"), F.avg("c.f").alias("oracle"))
    fits = F.col("n_pairs") <= most
    top = table.agg(F.max(F.when(fits, F.col("oracle"))).alias("top"))
    table = table.crossJoin(F.broadcast(top)).withColumn("near", F.coalesce(fits & (F.col("oracle") >= F.col("top") - tolerance), F.lit(False)))
    pick = table.filter("near").agg(F.min(F.struct("n_pairs", "k", "big_k")).alias("b"))
    return table.crossJoin(F.broadcast(pick)).select("k", "big_k", "n_pairs", "oracle", F.coalesce(F.struct("n_pairs", "k", "big_k") == F.col("b"), F.lit(False)).alias("chosen"))


def recovery(truth: DataFrame, old: DataFrame, new: DataFrame, flags: DataFrame, flag: str) -> DataFrame:
    """(country, flag, n_true, in_old, in_new, recovered, lost): true pairs by what two candidate sets have of them, apart for records with the flag (country, src, idx, flag)."""
    rows = truth.join(flags.select("country", "src", "idx", flag), ["country", "src", "idx"])
    for name, pairs in (("_old", old), ("_new", new)):
        rows = rows.join(pairs.select(*PAIR).distinct().withColumn(name, F.lit(1)), PAIR, "left")
    has_old, has_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    return rows.groupBy("country", flag).agg(F.count(F.lit(1)).alias("n_true"), F.count_if(has_old).alias("in_old"), F.count_if(has_new).alias("in_new"), F.count_if(has_new & ~has_old).alias("recovered"), F.count_if(has_old & ~has_new).alias("lost"))
