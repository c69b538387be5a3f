"""Benchmark decontamination with SimHash over item-sized windows.

Windows as long as a benchmark item (a shorter document is one window) get a SimHash of their word shingles. A multi-index over blocks of the fingerprints, kept for each item length, finds all items whose fingerprint is within RADIUS bits: at that radius one of BLOCKS blocks differs in at most RADIUS // BLOCKS bits, and the index holds every such variant of every item block. Candidates are verified by the exact weighted similarity of their shingles, sum of minimum counts over sum of maximum counts.

A window can only reach SIMILAR with some item of its length if 8 of 9 of its places hold a shingle of such items. Only starts of such windows, which is an exact bound, get a fingerprint; which item it is, only the index tells. RADIUS is so that of windows just at SIMILAR, with items of any length, one in 1,000 lies further away (measured on random shingles); README has the recall on documents.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, staged, table

WIDTH = 5  # words in a shingle
SIMILAR = 0.8
RADIUS = 19
BLOCKS = 5
#: First bit and bits of each block.
CUTS = [(64 * b // BLOCKS, 64 * (b + 1) // BLOCKS - 64 * b // BLOCKS) for b in range(BLOCKS)]


def _words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of width words, in order; empty if there are fewer words."""
    at = [F.lit(i) for i in range(1, width + 1)]
    return F.when(
        F.size(words) >= width,
        F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in at))),
    ).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: str) -> Column:
    """Bit b is set if it is in over half of the hashes of this column, repeats included."""
    has = f"size(filter({hashes}, h -> (shiftrightunsigned(h, b) & 1L) = 1L)) * 2 > size({hashes})"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (v, b) -> v | if({has}, shiftleft(1L, b), 0L))")


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, width, shingles, fp): n words, shingles of width words. Items without words are left out; they have nothing to leak."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("words")).filter(F.size("words") > 0).dropDuplicates()
    rows = rows.withColumn("n", F.size("words")).withColumn("width", F.least(F.lit(WIDTH), F.col("n")))
    cases = F.array().cast("array<bigint>")
    for w in range(WIDTH, 0, -1):
        cases = F.when(F.col("width") == w, _shingles(F.col("words"), w)).otherwise(cases)
    rows = staged(rows.withColumn("shingles", cases))
    return staged(rows.withColumn("fp", simhash("shingles")).withColumn("item", F.xxhash64("item_id", "words")).drop("words"))


def _block(fp: Column, b: int) -> Column:
    first, bits = CUTS[b]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _key(b: int, value: Column) -> Column:
    """A block's value with its number."""
    return F.lit(b << 32).cast("long") + value


def index(found: DataFrame) -> DataFrame:
    """(n, key, item, fp): every block of every item with every variant of it at RADIUS // BLOCKS bits or less."""

    def variants(b: int) -> Column:
        flips = [sum(1 << i for i in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(CUTS[b][1]), k)]
        return F.transform(F.expr(f"array({', '.join(f'{x}L' for x in flips)})"), lambda x: _key(b, _block(F.col("fp"), b).bitwiseXOR(x)))

    return found.select("n", "item", "fp", F.explode(F.flatten(F.array(*map(variants, range(BLOCKS))))).alias("key"))


def near_items(windows: DataFrame, by_key: DataFrame) -> DataFrame:
    """windows (n, wfp and more) with item: a row for each item of length n whose fingerprint is within RADIUS of wfp."""
    probes = windows.withColumn("key", F.explode(F.array(*(_key(b, _block(F.col("wfp"), b)) for b in range(BLOCKS)))))
    met = probes.join(by_key, ["n", "key"]).withColumn("apart", F.col("wfp").bitwiseXOR(F.col("fp"))).filter(F.bit_count("apart") <= RADIUS)
    # several blocks may meet; the first one of them speaks
    first = F.coalesce(*(F.when(F.bit_count(_block(F.col("apart"), b)) <= RADIUS // BLOCKS, F.lit(b)) for b in range(BLOCKS)))
    return met.filter(F.shiftright("key", 32) == first).drop("key", "apart", "fp")


def _read(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, words): tkey is a hash of the text."""
    return docs.select("doc_id", F.xxhash64("text").alias("tkey"), _words(F.col("text")).alias("words"))


def places(docs: DataFrame, widths: list[int], lookup: DataFrame) -> DataFrame:
    """(doc_id, tkey, n, width, length, starts): for each text and item length all starts at which a window may reach SIMILAR with an item of that length.

    A window has as many words as the item, or all of a shorter text (length). Of its shingles and the item's at least 4/9 of both counts together must be shared for SIMILAR, and no more are shared than the window has places whose shingle an item of that length holds; starts are all those with as many such places, so none is lost. lookup (hash, n, width): which shingles items of which length have. Every text is read once for all widths; shuffled are only numbers of the places that items share.
    """
    # one projection makes the arrays, the next only reads them; outer, else a filter on the size is pushed down that makes the words anew for each shingle
    rows = _read(docs).select("doc_id", "tkey", F.size("words").alias("size"), *(_shingles(F.col("words"), w).alias(f"h{w}") for w in widths))

    def placed(width: int) -> Column:
        return F.transform(f"h{width}", lambda h, i: F.struct(F.lit(width).alias("width"), i.alias("pos"), h.alias("hash")))

    each = rows.select("doc_id", "tkey", "size", F.explode_outer(F.flatten(F.array(*map(placed, widths)))).alias("x")).select("doc_id", "tkey", "size", "x.*")
    hits = each.join(lookup, ["hash", "width"])
    out = hits.groupBy("doc_id", "tkey", "size", "n", "width").agg(F.collect_set("pos").alias("hits"))
    length = F.least("n", "size")
    out = out.withColumn("length", length).withColumn("held", F.col("length") - F.col("width") + 1)
    out = out.withColumn("least", F.ceil(F.lit(4) * (F.col("held") + F.col("n") - F.col("width") + 1) / 9).cast("int")).filter(F.size("hits") >= F.col("least"))
    out = out.withColumn("hits", F.array_sort("hits")).withColumn("last", F.greatest(F.lit(0), F.col("size") - F.col("n")))
    hit = lambda i: F.element_at("hits", i)

    def stretch(i: Column) -> Column:
        """The starts of windows that hold hits i to i + least - 1, but for those that hold hits i - 1 and on."""
        low = F.greatest(F.lit(0), hit(i + F.col("least") - 1) - F.col("held") + 1, F.when(i > 1, F.least(hit(F.greatest(i - 1, F.lit(1))), F.col("last")) + 1).otherwise(F.lit(0)))
        high = F.least(hit(i), F.col("last"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    starts = F.flatten(F.transform(F.sequence(F.lit(1), F.size("hits") - F.col("least") + 1), stretch))
    return out.withColumn("starts", starts).filter(F.size("starts") > 0).select("doc_id", "tkey", "n", "width", "length", "starts")


def _shared(a: str, b: str) -> Column:
    """The sum of the least counts of the elements of two arrays. Where one of them holds each element once, that is the size of their intersection."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    common = F.array_intersect(a, b)
    single = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(single, F.size(common)).otherwise(F.aggregate(common, F.lit(0), lambda s, x: s + F.least(count(F.col(a), x), count(F.col(b), x))))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, at, n_windows): one row for each document and benchmark item that has a window of it at SIMILAR or more, at whatever start; a document shorter than the item is one window. The best similarity, the first word of the first such window, and how many windows reach SIMILAR.

    Words are runs of letters and digits in lower case. Null and empty texts have no windows; items without words leak nowhere; items shorter than a shingle are one shingle. Repeated rows of one doc_id are one document. Rows without doc_id cannot be named and are left out. Columns other than doc_id, item_id and text are ignored. Empty tables give no rows.
    """
    found = items(benchmark)
    widths = [r.width for r in found.select("width").distinct().orderBy("width").collect()]  # five values at most
    if not widths:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, at int, n_windows long")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).filter("doc_id is not null")
    lookup = small(staged(found.select(F.explode("shingles").alias("hash"), "n", "width").distinct()))
    starts = staged(places(docs, widths, lookup))
    named = small(staged(starts.select("doc_id", "tkey").distinct()))
    by_key = small(staged(index(found)))

    texts = _read(docs.withColumn("tkey", F.xxhash64("text")).join(named, ["doc_id", "tkey"], "left_semi")).dropDuplicates(["doc_id", "tkey"])
    hashes = F.coalesce(*(F.when(F.col("width") == w, _shingles(F.col("words"), w)) for w in widths))
    rows = texts.join(starts, ["doc_id", "tkey"]).select("doc_id", "tkey", "n", "width", "length", "starts", hashes.alias("hashes"))
    rows = rows.select("doc_id", "n", "width", "length", "hashes", F.explode("starts").alias("at"))
    rows = rows.select("doc_id", "n", "at", F.slice("hashes", F.col("at") + 1, F.col("length") - F.col("width") + 1).alias("a"))
    near = near_items(rows.withColumn("wfp", simhash("a")), by_key)
    near = near.join(small(found.select("item", "item_id", F.col("shingles").alias("b")), 10_000), "item")
    near = near.withColumn("shared", _shared("a", "b"))
    hits = near.withColumn("similarity", F.col("shared") / (F.size("a") + F.size("b") - F.col("shared"))).filter(F.col("similarity") >= SIMILAR)
    best = F.max(F.struct("similarity", (-F.col("at")).alias("neg"))).alias("best")
    return (
        hits.groupBy("doc_id", "item_id")
        .agg(best, F.count_distinct("at").alias("n_windows"))
        .select("doc_id", "item_id", "best.similarity", (-F.col("best.neg")).alias("at"), "n_windows")
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item. Rows without doc_id stay, as nothing names them; rows of one doc_id go together."""
    gone = staged(leaks(docs, benchmark).select("doc_id").distinct())
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_benchmark_decontamination": op6}
#: All windows that share a shingle with the item, without fingerprints.
ORACLE = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS dn FROM (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL) x),
b AS (SELECT row_number() OVER () AS i, item_id, w, len(w) AS n, least(5, len(w)) AS k FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark) x WHERE len(w) > 0),
ds AS (SELECT r, dn, k, p, array_to_string(w[p + 1:p + k], ' ') AS sh FROM (SELECT r, dn, w, k, unnest(range(0, dn - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM b) ks) x),
bs AS (SELECT i, n, k, sh, count(*) AS c FROM (SELECT i, n, k, array_to_string(w[o + 1:o + k], ' ') AS sh FROM (SELECT i, w, n, k, unnest(range(0, n - k + 1)) AS o FROM b) x) y GROUP BY ALL),
hit AS (SELECT r, dn, i, n, bs.k, p, sh, c, least(n, dn) - bs.k + 1 AS held FROM ds JOIN bs USING (k, sh)),
win AS (SELECT r, i, n, k, held, sh, c, unnest(range(greatest(0, p - held + 1), least(p, greatest(0, dn - n)) + 1)) AS pl FROM hit),
m AS (SELECT r, i, n, k, held, pl, sum(m) AS m FROM (SELECT r, i, n, k, held, pl, sh, least(count(*), any_value(c)) AS m FROM win GROUP BY r, i, n, k, held, pl, sh) x GROUP BY ALL),
s AS (SELECT doc_id, item_id, pl, m / CAST(held + n - k + 1 - m AS DOUBLE) AS similarity FROM m JOIN d USING (r) JOIN (SELECT i, item_id FROM b) USING (i))
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_max(pl, (similarity, -pl)) AS INT) AS "at", count(DISTINCT pl) AS n_windows FROM s WHERE similarity >= 0.8 GROUP BY doc_id, item_id"""
ORACLES = {"op6_benchmark_decontamination": ORACLE}
