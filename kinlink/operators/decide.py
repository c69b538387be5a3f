"""From probabilities to matches: exclusive ownership, thresholds, and the choice that maximises the expected score."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP = 1e-6
MOST, LEAST_Q = 15, 0.01  # candidates the optimiser sees
THRESHOLDS = [round(0.2 + 0.05 * i, 2) for i in range(13)]
TWO = [round(0.3 + 0.05 * i, 2) for i in range(9)]
GAMMAS = (0.8, 0.9, 1.0, 1.25, 1.5)
ONE, REC = ["country", "s1"], ["country", "src", "idx"]


def odds(pairs: DataFrame, p: str = "p") -> DataFrame:
    """pairs with q: p against all who claim the same record, or nobody."""
    c = F.least(F.greatest(F.col(p).cast("double"), F.lit(CLIP)), F.lit(1 - CLIP))
    o = c / (1 - c)
    return pairs.withColumn("_o", o).withColumn("q", F.col("_o") / (1 + F.sum("_o").over(Window.partitionBy(*REC)))).drop("_o")


def best_owner(pairs: DataFrame, p: str = "p") -> DataFrame:
    """q is p for the record's best claim, the smallest s1 among equals, else 0."""
    rank = F.row_number().over(Window.partitionBy(*REC).orderBy(F.desc(p), "s1"))
    return pairs.withColumn("q", F.when(rank == 1, F.col(p).cast("double")).otherwise(F.lit(0.0)))


def one_home(pairs: DataFrame, how: str, p: str = "p") -> DataFrame:
    return {"odds": odds, "argmax": best_owner, "none": lambda x, p: x.withColumn("q", F.col(p).cast("double"))}[how](pairs, p)


def _order() -> list:
    return [F.desc("q"), "src", "idx"]


def threshold(pairs: DataFrame, t: float) -> DataFrame:
    return pairs.withColumn("accepted", F.col("q") >= t)


def two_thresholds(pairs: DataFrame, t1: float, t2: float) -> DataFrame:
    """The best candidate needs t1, the others t2 and an accepted best one."""
    rank = F.row_number().over(Window.partitionBy(*ONE).orderBy(*_order()))
    first = F.max((F.col("_r") == 1) & (F.col("q") >= t1)).over(Window.partitionBy(*ONE))
    rows = pairs.withColumn("_r", rank).withColumn("_first", first)
    return rows.withColumn("accepted", F.when(F.col("_r") == 1, F.col("q") >= t1).otherwise(F.col("_first") & (F.col("q") >= t2))).drop("_r", "_first")


def poisson_binomial(q: Column) -> Column:
    """The distribution of the number of successes: array of len(q) + 1."""
    one = F.array(F.lit(1.0))
    zero = F.array(F.lit(0.0))
    # adding a trial: each count is reached from itself or from one less
    step = lambda pmf, x: F.zip_with(F.concat(pmf, zero), F.concat(zero, pmf), lambda stay, up: stay * (1 - x) + up * x)
    return F.aggregate(q, one, step)


def expected_scores(q: Column) -> Column:
    """Expected F0.5 of accepting the j best of q (descending), j from 0: array of len(q) + 1."""
    nobody = F.aggregate(q, F.lit(1.0), lambda s, x: s * (1 - x))

    def of(j: Column) -> Column:
        hits, rest = poisson_binomial(F.slice(q, 1, j)), poisson_binomial(F.slice(q, j + 1, F.size(q)))
        rows = F.transform(hits, lambda pa, a: F.aggregate(F.transform(rest, lambda pb, b: pa * pb * 1.25 * a / (j + 0.25 * (a + b))), F.lit(0.0), lambda s, x: s + x))
        return F.aggregate(rows, F.lit(0.0), lambda s, x: s + x)

    return F.concat(F.array(nobody), F.transform(F.sequence(F.lit(1), F.greatest(F.size(q), F.lit(1))), lambda j: F.when(j <= F.size(q), of(j)).otherwise(F.lit(-1.0))))


def best_count(q: Column, gamma: Column | float = 1.0) -> Column:
    """How many to accept: the smallest number of the largest expected score, the optimiser seeing q to the power of gamma. Scores are compared to 12 places, below which only the order of sums speaks."""
    g = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    scores = F.transform(expected_scores(F.transform(q, lambda x: F.pow(x, g))), lambda x: F.round(x, 12))
    return F.array_position(scores, F.array_max(scores)) - 1


def expected_choice(pairs: DataFrame, gamma: Column | float = 1.0) -> DataFrame:
    """pairs with accepted; candidates are the MOST best with q (before gamma) of LEAST_Q or more. gamma may be a column of first-source records' country."""
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(*ONE).orderBy(*_order())))
    sees = (F.col("_r") <= MOST) & (F.col("q") >= LEAST_Q)
    g = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    lists = ranked.filter(sees).withColumn("_g", g).groupBy(*ONE).agg(F.array_sort(F.collect_list(F.struct("_r", "q"))).alias("x"), F.first("_g").alias("_g"))
    counts = lists.select(*ONE, best_count(F.col("x.q"), F.col("_g")).alias("_j"))
    return ranked.join(counts, ONE, "left").withColumn("accepted", sees & (F.col("_r") <= F.coalesce("_j", F.lit(0)))).drop("_r", "_j")


def country_gamma(default: float, overrides: dict[str, float]) -> Column:
    out = F.lit(float(default))
    for country, g in overrides.items():
        out = F.when(F.col("country") == country, F.lit(float(g))).otherwise(out)
    return out


def configurations(limited: bool = False) -> list[dict]:
    """All choices of ownership and rule that the search tries."""
    if limited:
        return [{"home": "odds", "rule": "expected", "gamma": g} for g in GAMMAS[1:]] + [{"home": "odds", "rule": "two", "t1": a, "t2": b} for a, b in product(TWO[2:7], TWO[:5])]
    out = []
    for home in ("none", "odds", "argmax"):
        out += [{"home": home, "rule": "one", "t": t} for t in THRESHOLDS]
        out += [{"home": home, "rule": "two", "t1": a, "t2": b} for a, b in product(TWO, TWO)]
        out += [{"home": home, "rule": "expected", "gamma": g} for g in GAMMAS]
    return out


def apply_configuration(pairs: DataFrame, c: dict) -> DataFrame:
    rows = one_home(pairs, c["home"])
    if c["rule"] == "one":
        return threshold(rows, c["t"])
    if c["rule"] == "two":
        return two_thresholds(rows, c["t1"], c["t2"])
    return expected_choice(rows, c["gamma"])


GATHER = 200_000  # rows of candidates that a worker takes at once
CELLS = 4_000_000  # numbers of the optimiser's tables that it holds at once


def best_counts(q: np.ndarray, gamma: float) -> np.ndarray:
    """best_count() of many records at once: rows of q in descending order, filled up with zeros, which change no distribution."""
    n, most = q.shape
    x = np.power(q, gamma)
    rest = [np.zeros((n, most + 1)) for _ in range(most + 1)]
    rest[most][:, 0] = 1.0
    step = lambda pmf, p: pmf * (1 - p) + np.pad(pmf[:, :-1], ((0, 0), (1, 0))) * p
    for j in range(most, 0, -1):
        rest[j - 1] = step(rest[j], x[:, j - 1 : j])
    scores = np.full((n, most + 1), -1.0)
    scores[:, 0] = np.prod(1 - x, axis=1)
    hits, a = rest[most], np.arange(most + 1)
    for j in range(1, most + 1):
        hits = step(hits, x[:, j - 1 : j])
        gain = 1.25 * a[:, None] / (j + 0.25 * (a[:, None] + a))
        scores[:, j] = np.where(q[:, j - 1] > 0, (hits @ gain * rest[j]).sum(axis=1), -1.0)
    return np.round(scores, 12).argmax(axis=1)


def best_counts_of_all(q: np.ndarray, sizes: np.ndarray, gamma: float) -> np.ndarray:
    """best_count() of records of any numbers of candidates: their q above zero one after another, each record's in descending order, sizes of them.

    The expected score of j is the mean of 5 hits / (4 j + hits + true ones of the rest). The mean of 1 / (u + true ones after k) is made for all u from that after k + 1, so n candidates take some n squared steps. Records of about one size are taken together; of the hits' distributions only some are kept and the others made anew, so memory is n to the power of 1.5.
    """
    out, ends = np.zeros(len(sizes), np.int64), np.cumsum(sizes)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    while len(order):
        most = int(sizes[order[-1]])
        keep = int(np.ceil(np.sqrt(most + 1)))
        take = max(1, CELLS // ((most + 1) * (2 * keep + 6)))
        some, order = order[-take:], order[:-take]
        n = sizes[some]
        at = ends[some, None] - n[:, None] + np.arange(most)
        there = np.arange(most) < n[:, None]
        x = np.where(there, np.power(q[np.where(there, at, 0)], gamma), 0.0)  # zeros at the end change no distribution
        out[some] = _best_of(x, n, keep)
    return out


def _best_of(x: np.ndarray, n: np.ndarray, keep: int) -> np.ndarray:
    rows, most = x.shape

    def hits_from(j: int, hits: np.ndarray, to: int) -> list[np.ndarray]:
        """The distributions of true ones among the first j, j + 1 .. to."""
        found = [hits]
        for k in range(j, to):
            p = x[:, k : k + 1]
            last = found[-1]
            wide = np.zeros((rows, k + 2))
            wide[:, :-1] = last * (1 - p)
            wide[:, 1:] += last * p
            found.append(wide)
        return found

    kept = {0: np.ones((rows, 1))}
    for j in range(0, most, keep):
        kept[min(j + keep, most)] = hits_from(j, kept[j], min(j + keep, most))[-1]
    scores = np.full((rows, most + 1), -1.0)
    scores[:, 0] = np.prod(1 - x, axis=1)
    mean = 1.0 / np.maximum(np.arange(5 * most + 1), 1)[None].repeat(rows, axis=0)  # of 1 / u, with none left
    for low in reversed(range(0, most, keep)):
        high = min(low + keep, most)
        tables = hits_from(low, kept[low], high)
        for j in range(high, low, -1):
            if j < most:
                p = x[:, j : j + 1]
                mean = mean[:, : 5 * j + 1] * (1 - p) + mean[:, 1 : 5 * j + 2] * p
            a = np.arange(j + 1)
            scores[:, j] = np.where(j <= n, (tables[j - low] * 5 * a * mean[:, 4 * j + a]).sum(axis=1), -1.0)
    return np.round(scores, 12).argmax(axis=1)


def _rules(limited: bool) -> tuple[list[float], list[tuple[float, float]], tuple[float, ...]]:
    return ([], list(product(TWO[2:7], TWO[:5])), GAMMAS[1:]) if limited else (THRESHOLDS, list(product(TWO, TWO)), GAMMAS)


def _accepted(q: np.ndarray, label: np.ndarray, src: np.ndarray, idx: np.ndarray, starts: np.ndarray, limited: bool, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(accepted, true ones among them), a row for each record and a column for each rule; records' candidates stand together from starts on. whole: the optimiser sees all candidates with q above zero, not the MOST best of LEAST_Q."""
    one, two, gammas = _rules(limited)
    group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(q)))
    reach = {}
    for t in {*one, *(b for _, b in two)}:
        over = q >= t
        reach[t] = (np.add.reduceat(over, starts, dtype=np.int64), np.add.reduceat(np.where(over, label, 0), starts, dtype=np.int64))
    seen = np.flatnonzero(q > 0 if whole else q >= LEAST_Q)
    seen = seen[np.lexsort((idx[seen], src[seen], -q[seen], group[seen]))]
    if not whole:
        seen = seen[np.arange(len(seen)) - np.searchsorted(group[seen], group[seen]) < MOST]
    sizes = np.bincount(group[seen], minlength=len(starts))
    at = np.cumsum(sizes) - sizes
    some, first_q, first_hit = sizes > 0, np.zeros(len(starts)), np.zeros(len(starts), np.int64)
    first_q[some], first_hit[some] = q[seen][at[some]], label[seen][at[some]]
    columns = [reach[t] for t in one]
    for t1, t2 in two:
        n, tp = reach[t2]
        first = first_q >= t1
        columns.append((np.where(first, np.maximum(n, 1), 0), np.where(first, np.where(n > 0, tp, first_hit), 0)))
    found = np.concatenate([[0], np.cumsum(label[seen])])
    for g in gammas:
        n = best_counts_of_all(q[seen], sizes, g)
        columns.append((n, found[at + n] - found[at]))
    return tuple(np.stack(c, axis=1) for c in zip(*columns))


def _counted(homes: tuple[str, ...], limited: bool, whole: bool = False):
    """(country, s1, n, tp) of rows that come by record: how many each configuration accepts, and how many of them are true."""

    def lists(m: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), pa.int64()))

    def counts(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        whole = lambda c: rows.column(c).fill_null(0).to_numpy()
        label, src, idx = whole("label"), whole("src"), whole("idx")
        # no number is below all of them, and what is not a number above, as in sorting
        made = [_accepted(np.nan_to_num(rows.column(h).fill_null(-1.0).to_numpy(), nan=np.inf), label, src, idx, starts, limited, whole) for h in homes]
        n, tp = (np.concatenate(x, axis=1) for x in zip(*made))
        keys = rows.select(ONE).take(pa.array(starts)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(keys.column(c).combine_chunks() for c in ONE), lists(n), lists(tp)], [*ONE, "n", "tp"])

    def begins(rows: pa.Table) -> np.ndarray:
        new = np.zeros(len(rows), bool)
        new[:1] = True
        for c in ONE:
            code = rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def run(batches):
        held, size, least = [], 0, GATHER
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= least:
                rows = pa.Table.from_batches(held)
                starts = begins(rows)
                if len(starts) > 1:  # the last record may go on
                    yield counts(rows.slice(0, starts[-1]), starts[:-1])
                held = rows.slice(starts[-1]).to_batches()
                size = len(rows) - int(starts[-1])
                least = max(GATHER, 2 * size)
        if size:
            rows = pa.Table.from_batches(held)
            yield counts(rows, begins(rows))

    return run


def configuration_scores(pairs: DataFrame, truth_sizes: DataFrame, by: tuple[str, ...] = (), limited: bool = False, whole: bool = False) -> DataFrame:
    """(home, name, .., score): the macro score of every configuration, all in one pass; pairs with p and label, truth_sizes (country, s1, t) of all first-source records. by: also by these columns of truth_sizes. whole: the optimiser sees all candidates with q above zero; else, as expected_choice(), the MOST best of LEAST_Q.

    A rule accepts a prefix of a first-source record's candidates by q but for the two thresholds, which skip none either, as q falls. Candidates are dealt and sorted by first-source record once; thresholds are counted, and the optimiser's distributions made, over the arrays of many records at a time.
    """
    from .blocking import f05

    homes = ("odds",) if limited else ("none", "odds", "argmax")
    rows = best_owner(pairs.select(*ONE, "src", "idx", F.col("p").cast("double").alias("p"), "label")).withColumnRenamed("q", "argmax")
    rows = odds(rows).select(*ONE, F.col("src").cast("long").alias("src"), F.col("idx").cast("long").alias("idx"), F.col("label").cast("long").alias("label"), F.col("p").alias("none"), F.col("q").alias("odds"), "argmax")
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ONE)
    counts = rows.repartition(*ONE).sortWithinPartitions(*ONE).mapInArrow(_counted(homes, limited, whole), f"{kinds}, n array<bigint>, tp array<bigint>")
    one, two, gammas = _rules(limited)
    names = [f"one {t:.2f}" for t in one] + [f"two {a:.2f} {b:.2f}" for a, b in two] + [f"expected {g:.2f}" for g in gammas]
    every = [(h, n) for h in homes for n in names]
    nothing = F.array_repeat(F.lit(0).cast("long"), len(every))
    lists = truth_sizes.join(counts, ONE, "left").withColumns({"n": F.coalesce("n", nothing), "tp": F.coalesce("tp", nothing)})
    cells = lists.select(*by, "t", "tp", F.posexplode("n").alias("i", "n")).select(*by, "t", "i", "n", F.get("tp", F.col("i")).alias("tp"))
    scores = cells.groupBy("i", *by).agg(F.avg(f05(F.col("tp"), F.col("n"), F.col("t"))).alias("score"))
    of = lambda k: F.get(F.array(*(F.lit(x[k]) for x in every)), F.col("i"))
    return scores.select(of(0).alias("home"), of(1).alias("name"), *by, "score")


def threshold_grid(pairs: DataFrame, truth_sizes: DataFrame, ts: list[float] = THRESHOLDS) -> DataFrame:
    """(t, score): the macro score of every single threshold in one pass; pairs with q and label, truth_sizes (country, s1, t) of all first-source records."""
    per = pairs.groupBy(*ONE).agg(*(x for i, t in enumerate(ts) for x in (F.count_if(F.col("q") >= t).alias(f"n{i}"), F.count_if((F.col("q") >= t) & (F.col("label") == 1)).alias(f"h{i}"))))
    rows = truth_sizes.join(per, ONE, "left").na.fill(0)
    from .blocking import f05

    cells = F.array(*(F.struct(F.lit(t).alias("thr"), f05(F.col(f"h{i}"), F.col(f"n{i}"), F.col("t")).alias("f")) for i, t in enumerate(ts)))
    return rows.select(F.explode(cells).alias("c")).groupBy("c.thr").agg(F.avg("c.f").alias("score"))


def rival_filter(pairs: DataFrame) -> DataFrame:
    """Drops a record whose house differs from the first-source record's (s_house) and is that of two or more of its candidates."""
    n = F.count("house").over(Window.partitionBy(*ONE, "house"))
    rows = pairs.withColumn("_n", n)
    bad = F.coalesce((F.col("house") != F.col("s_house")) & (F.col("_n") >= 2), F.lit(False))
    return rows.withColumn("dropped", bad).drop("_n")


def smoothed(pairs: DataFrame, how: str, component: str = "component") -> DataFrame:
    """pairs with p_smooth over the candidates of a first-source record in one component: none, mean, median, or maxif (the largest if it is 0.9 or more, else the mean)."""
    by = Window.partitionBy(*ONE, component)
    p = F.col("p").cast("double")
    value = {"none": p, "mean": F.avg(p).over(by), "median": F.median(p).over(by), "maxif": F.when(F.max(p).over(by) >= 0.9, F.max(p).over(by)).otherwise(F.avg(p).over(by))}[how]
    return pairs.withColumn("p_smooth", value)


#: The rules by which two records of one source are held to be the same: what makes the key, and what must be empty.
LINK_RULES = {
    "name_core+addr_core": (("name_core", "addr_core"), ()),
    "raw name": (("name_raw",), ()),
    "raw address": (("addr_raw",), ()),
    "name_core, both addr empty": (("name_core",), ("addr_core",)),
}


def link_key(rule: str) -> Column:
    """The key of a rule; null where a part of it is missing."""
    parts, empty = LINK_RULES[rule]
    good = reduce(lambda a, b: a & b, [F.col(c) != "" for c in parts] + [F.col(c) == "" for c in empty])
    return F.when(good, F.concat_ws("|", *parts))


def link_keys(rows: DataFrame, rules: tuple[str, ...] = tuple(LINK_RULES)) -> DataFrame:
    """rows (.., name_core, addr_core, name_raw, addr_raw) with keys: the values by which they are held to be the same, each with its rule."""
    made = [F.concat_ws("|", F.lit(rule), link_key(rule)) for rule in rules]
    return rows.withColumn("keys", F.array_compact(F.array(*(F.when(link_key(rule).isNotNull(), key) for rule, key in zip(rules, made)))))


def link_components(pairs: DataFrame) -> DataFrame:
    """pairs (with keys) and component: the smallest idx that can be reached over shared keys within (country, s1, src), over chains of any length.

    One pass: a group's candidates are taken one by one, and each joins all components so far that have one of its keys into one. A group is what blocking leaves to one first-source record and source.
    """
    home = ["country", "s1", "src"]
    kind = "array<struct<ids:array<int>,keys:array<string>>>"

    def join(found: Column, x: Column) -> Column:
        meets = lambda c: F.arrays_overlap(c["keys"], x["keys"])
        hit = F.filter(found, meets)
        ids = F.concat(F.flatten(F.transform(hit, lambda c: c["ids"])), F.array(x["idx"]))
        keys = F.array_union(F.flatten(F.transform(hit, lambda c: c["keys"])), x["keys"])
        return F.concat(F.filter(found, lambda c: ~meets(c)), F.array(F.struct(ids.alias("ids"), keys.alias("keys"))))

    groups = pairs.groupBy(*home).agg(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.array_distinct("keys").alias("keys"))).alias("x"))
    found = groups.select(*home, F.explode(F.aggregate("x", F.array().cast(kind), join)).alias("c"))
    labels = found.select(*home, F.explode("c.ids").alias("idx"), F.array_min("c.ids").alias("component")).distinct()
    return pairs.join(labels, [*home, "idx"])
