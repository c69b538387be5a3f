"""Quality rules: hashed n-gram log-likelihood ratios.

Two multinomials over hashed byte n-grams are counted, one over the trusted target (documents labelled of quality 1), one over the raw corpus (all documents). A document's score is the mean over its n-grams of log p_target - log p_raw. The ratios are whole numbers of 1 / SCALE, so sums do not depend on their order and the verdict is the same on every run. Every document gets it from one fixed threshold on the score; nothing is sampled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, staged, table

ORDERS = (2, 3, 4)  # bytes in an n-gram
BUCKETS = 1 << 16
SMOOTHING = 1.0
SCALE = 1 << 16  # steps of a log-likelihood ratio of 1
BINS = 1 << 16  # of scores, in the search for the threshold
WINDOW = 5
REPEATED = 20  # per cent of words in repeated windows
FEWEST = 10
_PIECE = 1 << 20  # bytes hashed at once
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of each n-gram of this order, over all bytes."""
    n = len(data) - order + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    value = np.full(n, order, np.uint32)
    for i in range(order):
        value = value * np.uint32(257) + data[i : i + n]
    value *= np.uint32(2654435769)
    value ^= value >> np.uint32(15)
    value *= np.uint32(2246822519)
    return value >> np.uint32(16)


def pieces(text: bytes):
    """The text in stretches that overlap so that each n-gram starts in exactly one of them."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data), _PIECE):
        for order in ORDERS:
            yield grams(data[at : at + _PIECE + order - 1], order)


def _encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _counts(batches):
    """(which, bucket, n): counts of this task; which is 1 in the target, 0 in all documents."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in slices(batches):
        for text, good in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist()):
            for g in pieces(_encode(text)):
                c = np.bincount(g, minlength=BUCKETS) if len(g) > 4096 else None
                if c is None:
                    np.add.at(raw, g, 1)
                    if good:
                        np.add.at(target, g, 1)
                else:
                    raw += c
                    if good:
                        target += c
    for which, counts in ((0, raw), (1, target)):
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), which, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["which", "bucket", "n"])


def ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """SCALE * (log p_target - log p_raw) by bucket, rounded. All documents are counted for the raw corpus, all trusted ones for the target; labels meet texts by a shuffle on doc_id. Counts are summed on the executors; the driver gets the two multinomials, 2 * BUCKETS numbers at any size of the corpus."""
    # rows without doc_id are trusted nowhere; the salt deals them out
    ids = trusted.select("doc_id", F.lit(0).cast("long").alias("salt"), F.lit(True).alias("good"))
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    marked = docs.select("doc_id", "text", salt.alias("salt")).join(ids.hint("shuffle_hash"), ["doc_id", "salt"], "left").select("text", "good")
    rows = marked.mapInArrow(_counts, "which int, bucket int, n long").groupBy("which", "bucket").agg(F.sum("n").alias("n")).toPandas()
    p = np.full((2, BUCKETS), SMOOTHING)
    np.add.at(p, (rows["which"].to_numpy(int), rows["bucket"].to_numpy(int)), rows["n"].to_numpy(float))
    p = np.log(p / p.sum(axis=1, keepdims=True))
    return np.rint(SCALE * (p[1] - p[0])).astype(np.int64)


def rules(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = _encode(text)
    words = data.split()
    if not words:
        return 0, 0, int(_SYMBOLS[np.frombuffer(data, np.uint8)].sum()), 0, 0
    raw = np.frombuffer(data, np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum() - _SPACE[raw].sum())
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dups = len(lines) - len(set(lines))
    return len(words), chars, int(_SYMBOLS[raw].sum()), dups, repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    base = len(ids)
    if n > 1 and base == len(words):
        return 0
    key = code[:n].copy()
    for i in range(1, WINDOW):
        if key.max() > (1 << 62) // max(base, 2):
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * base + code[i : i + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    if not again.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def score(text: str | None, weights: np.ndarray) -> float:
    """The mean log-likelihood ratio of the text's n-grams; 0 without any."""
    total, n = 0, 0
    for g in pieces(_encode(text)):
        total += int(weights[g].sum())
        n += len(g)
    return total / n / SCALE if n else 0.0


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def _scored(weights: np.ndarray):
    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = [rules(t) for t in texts]
            cols = [pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 5)]
            scores = pa.array([score(t, weights) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, scores], [x.split()[0] for x in _SCHEMA.split(", ")])

    return run


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The score that best parts the two, each class weighing the same; midway between the neighbours. Without one of them, everything is kept."""
    if not len(good) or not len(bad):
        return float("-inf")
    cuts = np.unique(np.concatenate([good, bad]))
    good, bad = np.sort(good), np.sort(bad)
    right = (len(good) - np.searchsorted(good, cuts)) / len(good) + np.searchsorted(bad, cuts) / len(bad)
    best = int(np.argmax(right))
    return float(cuts[best] if best == 0 else (cuts[best] + cuts[best - 1]) / 2)


def cut_of(known: DataFrame) -> float:
    """threshold() of all rows of known (score, quality), from counts: of each bin of scores and class, then of each score in the bins that may hold a better cut than the bins' own first scores."""
    known = known.filter("quality in (0, 1)")
    ends = known.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    if ends.low is None:
        return float("-inf")
    scale = (BINS - 1) / (ends.high - ends.low) if ends.high > ends.low else 0.0
    known = known.withColumn("bin", F.floor((F.col("score") - F.lit(ends.low)) * F.lit(scale)).cast("int"))
    good, bad = (F.sum((F.col("quality") == q).cast("long")).alias(n) for q, n in ((1, "good"), (0, "bad")))
    bins = known.groupBy("bin").agg(good, bad, F.min("score").alias("first"), F.max("score").alias("last")).toPandas().sort_values("bin")
    g, b = bins["good"].to_numpy(np.int64), bins["bad"].to_numpy(np.int64)
    if not g.sum() or not b.sum():
        return float("-inf")
    over, under = g.sum() - np.cumsum(g) + g, np.cumsum(b) - b
    at_first = over / g.sum() + under / b.sum()
    may = (over / g.sum() + (under + b) / b.sum() >= at_first.max()) & (b > 0) & ((g > 0) | (np.arange(len(b)) == len(b) - 1))
    cuts = [(x, v, float("nan") if i == 0 else bins["last"].iloc[i - 1]) for i, (x, v) in enumerate(zip(bins["first"], at_first))]
    if may.any():
        inner = known.join(F.broadcast(known.sparkSession.createDataFrame([(int(x),) for x in bins["bin"][may]], "bin int")), "bin").groupBy("bin", "score").agg(good, bad).toPandas()
        for i in np.flatnonzero(may):
            x = inner[inner["bin"] == bins["bin"].iloc[i]].sort_values("score")
            gi, bi, si = x["good"].to_numpy(np.int64), x["bad"].to_numpy(np.int64), x["score"].to_numpy()
            values = (over[i] - np.cumsum(gi) + gi) / g.sum() + (under[i] + np.cumsum(bi) - bi) / b.sum()
            cuts += list(zip(si[1:], values[1:], si[:-1]))
    most = max(v for _, v, _ in cuts)
    cut, _, before = min(c for c in cuts if c[1] == most)
    return float(cut if np.isnan(before) else (cut + before) / 2)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base rules, score and verdict for each row of docs.

    labels (doc_id, quality): quality 1 is the trusted target; rows without label or with null are in the raw corpus alone. The threshold comes from all labelled documents that the base rules let through; with one class missing, all are kept. Null, empty and white texts have no words and fail the base. Repeated rows are judged each. Columns other than doc_id, text and quality are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"))
    weights = ratios(docs, marks.filter("quality = 1"))
    rows = staged(docs.mapInArrow(_scored(weights), _SCHEMA))
    fail = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", fail)
    cut = cut_of(staged(rows.filter(~fail).join(marks, "doc_id").select("score", "quality")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(cut)))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


QUERIES = {"op2_quality_llr": op2}


def _oracle() -> str:
    """The same in SQL: n-grams from the bytes one by one, and the best of all cuts."""
    word = "[^\\x20\\x09-\\x0D]+"
    grams = []
    for order in ORDERS:
        value = f"{order}::UBIGINT"
        for i in range(order):
            value = f"(({value}) * 257::UBIGINT + b[i + {i}]) % 4294967296::UBIGINT"
        grams.append(f"SELECT r, ({value}) * 2654435769::UBIGINT % 4294967296::UBIGINT AS v FROM (SELECT r, b, unnest(range(1, len(b) - {order - 2})) AS i FROM bytes) o{order}")
    window = " || ' ' || ".join(f"w[i + {i}]" for i in range(WINDOW))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
bytes AS (SELECT r, [CAST('0x' || x AS UBIGINT) for x in regexp_extract_all(hex(encode(t)), '..')] AS b FROM d),
grams AS (SELECT r, xor(v, v >> 15) * 2246822519::UBIGINT % 4294967296::UBIGINT >> 16 AS g FROM ({" UNION ALL ".join(grams)}) x),
lab AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
marked AS (SELECT d.r, quality FROM d LEFT JOIN lab ON lab.doc_id = d.doc_id),
counts AS (SELECT g, count(*) AS raw, count(*) FILTER (quality = 1) AS good FROM grams JOIN marked USING (r) GROUP BY g),
total AS (SELECT sum(raw) + {BUCKETS} AS raw, sum(good) + {BUCKETS} AS good FROM counts),
weight AS (SELECT g, CAST(round_even({SCALE} * (ln((counts.good + 1) / CAST(total.good AS DOUBLE)) - ln((counts.raw + 1) / CAST(total.raw AS DOUBLE))), 0) AS BIGINT) AS x FROM counts, total),
scored AS (SELECT r, CAST(sum(x) AS DOUBLE) / count(*) / {SCALE} AS score FROM grams JOIN weight USING (g) GROUP BY r),
windows AS (SELECT r, i, {window} AS k FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d) x),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM windows) x WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + o) AS n FROM again, (SELECT unnest(range(0, {WINDOW})) AS o) x GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) x WHERE regexp_matches(l, '{word}') GROUP BY r),
base AS (SELECT d.r, d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(score, 0) AS score, len(w) < {FEWEST} OR 100 * coalesce(covered.n, 0) > {REPEATED} * len(w) AS base_failed
  FROM d LEFT JOIN lines USING (r) LEFT JOIN covered USING (r) LEFT JOIN scored USING (r)),
known AS (SELECT score, quality FROM base JOIN marked USING (r) WHERE NOT base_failed AND quality IN (0, 1)),
by_score AS (SELECT score, sum(CAST(quality = 1 AS INT)) AS good, sum(CAST(quality = 0 AS INT)) AS bad FROM known GROUP BY score),
run AS (SELECT score, lag(score) OVER (ORDER BY score) AS before, CAST(sum(good) OVER (ORDER BY score DESC) AS DOUBLE) / sum(good) OVER () + CAST(sum(bad) OVER (ORDER BY score) - bad AS DOUBLE) / sum(bad) OVER () AS parted, sum(good) OVER () AS goods, sum(bad) OVER () AS bads FROM by_score),
best AS (SELECT CASE WHEN before IS NULL THEN score ELSE (score + before) / 2 END AS cut FROM run WHERE goods > 0 AND bads > 0 ORDER BY parted DESC, score LIMIT 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(score >= (SELECT cut FROM best), true) AS kept, score FROM base"""


ORACLES = {"op2_quality_llr": _oracle()}
