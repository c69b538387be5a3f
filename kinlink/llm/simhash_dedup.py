"""SimHash near-duplicates by pivot distance tables.

Every fingerprint gets its Hamming distances to reference fingerprints: an origin, and for each of 16 blocks of four bits the origin with that block inverted. The difference of two such distances tells how many bits of the block differ from the origin, so the table is a vector of 16 numbers, of which one bit more or less moves one number by one. Every fingerprint is entered in the cell of its own vector and in the cells one step away; two that differ in RADIUS bits or less always share a cell. In a cell, pairs are discarded whose distances to any of 16 further, random references differ by more than the radius (the triangle bound), and survivors are verified bit by bit.

Cells of more than BUCKET members do not list pairs. Their members are told apart by the references that differ from the origin in one bit each: these distances determine a fingerprint, so a cell is a point, and members are entered in their own and the 64 points one step away. Those that share a point are at most two bits apart and no point has more than 65 owners, so a star around one owner holds all links that components need, in space linear in the fingerprints.

keep_first() also links texts of similar words whose fingerprints lie further apart than such tables can search; see near_links().
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Staged, components, passing, slices, small, staged, table

RADIUS = 2
WIDTH = 3  # words in a shingle
SEED = 42
BUCKET = 32  # members up to which a cell lists its pairs
BITS = 4  # in a block; the numbers of a vector are 0 to 4
BLOCKS = 64 // BITS
REFERENCES = 16  # random ones
_CHUNK = 1 << 14
_PAIRS = 1 << 20  # compared at a time
# of texts that are similar in their words, in keep_first()
NEAR_WIDTH, NEAR_PART, NEAR_OF = 5, 4, 5
NEAR_SIMILAR = NEAR_PART / NEAR_OF
NEAR_BITS = 512  # of the parities of a set's hashes
SAMPLED, MOST_SAMPLED, MOST_COMMON = 16, 25_000, 1 << 18  # one text of so many tells which shingles are common, of so many texts at most; how many of them workers know
BLOCK, MOST_BLOCKS = 256, 32  # members of a large cell that meet in one group, and groups that a member is sent to
LISTED, ROUNDS = 1000, 4  # open pairs for each member from which further stars come first, and how many
NEAREST, CLOSER = 4, 8  # members nearest to one that are verified first, and times as many in each next round
SLICED, MOST_SLICES = 10_000, 8  # pairs whose texts are shuffled at a time, unless that makes more slices


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of one text, over all its word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    join = b" ".join
    if len(words) < WIDTH:
        return digest(join(words), SEED)
    n = len(words) - WIDTH + 1
    grams = zip(*(words[i:] for i in range(WIDTH)))
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        m = min(_CHUNK, n - at)
        h = np.fromiter((digest(join(g), SEED) for _, g in zip(range(m), grams)), np.uint64, m)
        counts += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _batches(batches):
    for batch in slices(batches):
        prints = [_signed(fingerprint(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row for each row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_batches, "doc_id long, fp long")


def references() -> tuple[int, list[int]]:
    """The origin and the random reference fingerprints, seeded."""
    numbers = np.random.default_rng(SEED).integers(0, 1 << 32, (1 + REFERENCES, 2), dtype=np.uint64)
    origin, *others = (int(a) << 32 | int(b) for a, b in numbers)
    return origin, others


def _distance(ref: int) -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(ref))))


def vectors(prints: DataFrame) -> DataFrame:
    """prints with vector: for each block, by four bits of a long, how many of its bits differ from the origin, from the distances to the origin and to the origin with the block inverted."""
    origin, _ = references()
    value = F.lit(0).cast("long")
    for b in range(BLOCKS):
        inverted = origin ^ (((1 << BITS) - 1) << (b * BITS))
        # inverting the block turns the bits that differ into agreeing ones, and the others into differing ones
        number = F.shiftright(F.lit(BITS) + _distance(origin) - _distance(inverted), 1).cast("long")
        value = value.bitwiseOR(F.shiftleft(number, b * BITS))
    return prints.withColumn("vector", value)


def cells(prints: DataFrame) -> DataFrame:
    """(fp, cell): the vector of each fingerprint and all vectors one step away."""
    number = lambda b: F.shiftright("vector", b * BITS).bitwiseAND(F.lit(7))
    steps = [F.when(number(b) > 0, F.col("vector") - F.lit(1 << (b * BITS))) for b in range(BLOCKS)]
    steps += [F.when(number(b) < BITS, F.col("vector") + F.lit(1 << (b * BITS))) for b in range(BLOCKS)]
    return vectors(prints).select("fp", F.explode(F.array_compact(F.array(F.col("vector"), *steps))).alias("cell"))


def _with_distances(rows: DataFrame) -> DataFrame:
    """rows with the distances to the random references, one byte each, in two longs."""
    _, others = references()
    for name, refs in (("c0", others[:8]), ("c1", others[8:])):
        value = F.lit(0).cast("long")
        for i, ref in enumerate(refs):
            value = value.bitwiseOR(F.shiftleft(_distance(ref).cast("long"), 8 * i))
        rows = rows.withColumn(name, value)
    return rows


def _apart(a: str, b: str):
    """Whether no coordinate differs by more than the radius."""
    fine = F.lit(True)
    for c in ("c0", "c1"):
        for i in range(8):
            x, y = (F.shiftright(F.col(f"{s}.{c}"), 8 * i).bitwiseAND(F.lit(255)) for s in (a, b))
            fine = fine & (F.abs(x - y) <= RADIUS)
    return fine


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) between different fingerprints, prints holding each one once; they connect exactly what all pairs at RADIUS or less connect."""
    entered = cells(prints)
    sizes = staged(entered.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))

    cold = _with_distances(entered.join(sizes.filter(F.col("n") <= bucket).select("cell"), "cell"))
    # a hash of the cell: the join may then split a cell's rows without undoing this grouping
    group = cold.groupBy(F.xxhash64("cell", F.lit(1)).alias("k")).agg(F.collect_list(F.struct("fp", "c0", "c1")).alias("m"))
    listed = group.select("m", F.explode("m").alias("a")).select("a", F.explode("m").alias("b")).filter(F.col("a.fp") < F.col("b.fp"))
    close = listed.filter(_apart("a", "b")).filter(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS)
    near = close.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))

    hot = entered.join(sizes.filter(F.col("n") > bucket).select("cell"), "cell", "left_semi").select("fp").distinct()
    flips = [F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(64))]
    points = hot.select("fp", F.explode(F.transform(F.array(*flips), lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    shared = points.groupBy("point").agg(F.collect_list("fp").alias("m")).filter(F.size("m") > 1)
    star = shared.select(F.array_min("m").alias("u"), F.explode("m").alias("v")).filter("u < v")
    return near.unionByName(star).distinct()


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the different NEAR_WIDTH-word shingles of a text: lower-cased words joined by blanks, the whole sequence if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    width = min(NEAR_WIDTH, len(words))
    join, digest = b" ".join, xxhash.xxh64_intdigest
    grams = zip(*(words[i:] for i in range(width)))
    return np.unique(np.fromiter((digest(join(g), SEED) for g in grams), np.uint64, len(words) - width + 1))


def _common_counts(batches):
    for batch in slices(batches):
        found = [shingles(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], ["hash"])


def common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that two texts or more of a sample hold, in order, and in how many. They only order the shingles of a text: links are the same whatever is common, cells are smaller if it is known."""
    of = max(SAMPLED, -(-texts.count() // MOST_SAMPLED))
    sample = texts.filter(F.pmod(F.xxhash64("tkey", F.lit(SEED)), F.lit(of)) == 0).select("text")
    counts = staged(sample.mapInArrow(_common_counts, "hash long").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    least, room = 2, MOST_COMMON
    for row in sorted(counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            least = row["n"] + 1
            break
    kept = counts.filter(F.col("n") >= least).toArrow()
    hashes = kept.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], kept.column("n").to_numpy()[order]


def prefix(hashes: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of the shingles of a text, in order, the first that are not common, then the rarest: so many that any text at NEAR_SIMILAR has one of them among its own. The order is one for all texts, and the first shingle that two such texts share is among the first of both."""
    n, (frequent, counts) = len(hashes), known
    if len(frequent) and n:
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        hashes = hashes[np.argsort(np.where(frequent[at] == hashes, counts[at], 0), kind="stable")]
    return hashes[: n + 1 + (-n * NEAR_PART // NEAR_OF)] if n else hashes


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of NEAR_BITS classes of hashes whether their number is odd. Sets differ in at least as many shingles as parities."""
    odd = np.bincount((hashes % np.uint64(NEAR_BITS)).astype(np.int64), minlength=NEAR_BITS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


_SKETCH = "doc_id long, tkey long, fp long, skey long, size int, bits array<bigint>, keys array<bigint>"


def _sketched(known, batches):
    longs = pa.list_(pa.int64())
    for batch in slices(batches):
        fps, skeys, sizes, bits, keys = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            hashes = shingles(text)
            fps.append(_signed(fingerprint(text)))
            skeys.append(_signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)))
            sizes.append(len(hashes))
            bits.append(parities(hashes))
            keys.append(prefix(hashes, known).view(np.int64))
        columns = [pa.array(fps, pa.int64()), pa.array(skeys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, longs), pa.array(keys, longs)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), *columns], ["doc_id", "tkey", "fp", "skey", "size", "bits", "keys"])


def _linked(batches):
    sets = {}  # of the texts read last
    for batch in slices(batches):
        kept = []
        for u, v, x, y in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "x", "y"))):
            if len(sets) > 200:
                sets.clear()
            for skey, text in ((u, x), (v, y)):
                if skey not in sets:
                    sets[skey] = shingles(text)
            both = len(sets[u]) + len(sets[v])
            kept.append(_enough(both - len(np.union1d(sets[u], sets[v])), both))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(kept, pa.bool_()))


def _same_row():
    return F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tkey") == F.col("_key"))


def _enough(shared, both):
    """Whether of two sets with so many members in sum enough are shared for NEAR_SIMILAR."""
    return shared * (NEAR_PART + NEAR_OF) >= both * NEAR_PART


def _may_share(a: str, b: str):
    """Whether two sets may be at NEAR_SIMILAR whose first shared shingle is this cell's: no more are shared than either has from there on."""
    left = F.least(*(F.col(f"{s}.size") - F.col(f"{s}.at") for s in (a, b)))
    return _enough(left, F.col(f"{a}.size") + F.col(f"{b}.size"))


def _may_agree(a: str, b: str):
    """Whether two sets may be at NEAR_SIMILAR that differ in at least so many shingles as their parities."""
    apart = sum(F.bit_count(F.get(f"{a}.bits", F.lit(i)).bitwiseXOR(F.get(f"{b}.bits", F.lit(i)))) for i in range(NEAR_BITS // 64))
    both = F.col(f"{a}.size") + F.col(f"{b}.size")
    return _enough(both - apart, 2 * both)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a.skey", "b.skey").alias("u"), F.greatest("a.skey", "b.skey").alias("v"))


def verified(pairs: DataFrame, own: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (u, v) of sets that share NEAR_SIMILAR, by all their shingles. Texts are shuffled for a slice of the pairs at a time, so that less of them lies on disk at once."""
    marks = own.select("skey", "size", "bits")
    pairs = pairs.distinct().join(marks.alias("a"), F.col("u") == F.col("a.skey")).join(marks.alias("b"), F.col("v") == F.col("b.skey"))
    with passing(own.sparkSession) as put:
        pairs = put(pairs.filter(_may_agree("a", "b")).select("u", "v"))
        named = pairs.select(F.col("u").alias("skey")).unionByName(pairs.select(F.col("v").alias("skey"))).distinct()
        named = small(put(own.join(named, "skey", "left_semi").select("skey", F.col("place.doc_id").alias("_doc"), F.col("place.tkey").alias("_key"))))
        # of repeated rows one; texts are shuffled, as their shingles take some four times the space
        read = put(texts.join(named, _same_row()).groupBy("skey").agg(F.first("text").alias("text")))
        of, found = min(MOST_SLICES, 1 + pairs.count() // SLICED), []
        for i in range(of):
            mine = lambda c: F.pmod(F.xxhash64(c, F.lit(SEED)), F.lit(of)) == i  # noqa: B023, E731
            first = small(pairs.filter(mine("v"))).join(read.select(F.col("skey").alias("u"), F.col("text").alias("x")), "u")
            both = first.join(read.filter(mine("skey")).select(F.col("skey").alias("v"), F.col("text").alias("y")), "v")
            found.append(staged(both.select("u", "v", "x", "y").mapInArrow(_linked, "u long, v long")))
        return reduce(DataFrame.unionByName, found)


def _star(members: DataFrame, centres: DataFrame) -> DataFrame:
    """Pairs of each member with the centres (cell, skey, size, at) of its cell."""
    return _ordered(members.alias("a").join(small(staged(centres)).alias("b"), "cell").filter(F.col("a.skey") != F.col("b.skey")).filter(_may_share("a", "b")))


def _centres(members: DataFrame, seed) -> DataFrame:
    """Two of each cell: one by hash, and the one with the fewest shingles before the cell's, so with the fewest of its own; copies of a text with changes of their own are near that one, if near to any."""
    by = (F.struct(F.xxhash64("skey", seed), "skey", "size", "at"), F.struct(F.col("at") / F.col("size"), F.xxhash64("skey", seed), "skey", "size", "at"))
    least = members.groupBy("cell").agg(*(F.min(x).alias(k) for k, x in zip("xy", by)))
    rows = least.select("cell", F.explode(F.array(*(F.struct(f"{k}.skey", f"{k}.size", f"{k}.at") for k in "xy"))).alias("x"))
    return rows.select("cell", "x.*").distinct()


def _nearest_of(most: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """For each member of left the most members of right of another root that are nearest by their parities, of those that may be at NEAR_SIMILAR; more: whether there are others."""
    (us, m, am, ru, xs), (vs, n, an, rv, ys) = ([t.column(c).to_numpy() for c in ("skey", "size", "at", "root")] + [t.column("bits").combine_chunks().flatten().to_numpy().reshape(t.num_rows, NEAR_BITS // 64)] for t in (left, right))
    found, step = [], max(1, _PAIRS // max(1, len(vs)))
    for at in range(0, len(us) if len(vs) else 0, step):
        rows = slice(at, at + step)
        both = m[rows, None].astype(np.int64) + n[None]
        apart = np.zeros(both.shape, np.int64)
        for i in range(xs.shape[1]):
            apart += np.bitwise_count((xs[rows, i, None] ^ ys[None, :, i]).view(np.uint64))
        fine = (ru[rows, None] != rv[None]) & _enough(np.minimum((m - am)[rows, None], (n - an)[None]), both) & _enough(both - apart, 2 * both)
        for i in np.flatnonzero(fine.any(axis=1)):
            j = np.flatnonzero(fine[i])
            far, more = apart[i, j] / both[i, j], len(j) > most
            if more:
                kept = np.argpartition(far, most - 1)[:most]
                j, far = j[kept], far[kept]
            found.append((np.full(len(j), us[at + i]), vs[j], far, np.full(len(j), more)))
    columns = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool)]
    return pa.table(columns, names=["u", "v", "far", "more"])


def _nearest(members: DataFrame, own: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """Pairs of each member that is not of its cell's largest root with the most members nearest to it, of those in its cells that have another root and may be at NEAR_SIMILAR; and whether any member has more such. members (cell, skey, size, at, root, n, few, major). The few meet all of a cell in groups by hash, so no cell is one task; what leaves a group, and what is verified, grows with the members and not with their pairs."""
    with passing(own.sparkSession) as put:
        members = put(members.join(own.select("skey", "bits"), "skey"))
        blocks = lambda n: F.least(F.lit(MOST_BLOCKS), F.ceil(n / BLOCK)).cast("int")
        parts = lambda n: F.pmod(F.xxhash64("skey"), blocks(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
        few, all_ = F.col("few"), F.col("n")
        columns = ("cell", "p", "q", "skey", "size", "at", "root", "bits")
        left = members.filter("root != major").withColumn("p", parts(few)).withColumn("q", every(all_)).select(*columns)
        right = members.withColumn("q", parts(all_)).withColumn("p", every(few)).select(*columns)
        met = left.groupBy("cell", "p", "q").cogroup(right.groupBy("cell", "p", "q"))
        near = met.applyInArrow(lambda x, y: _nearest_of(most, x, y), "u long, v long, far double, more boolean")
        # a pair may meet in several cells, and each group has its own nearest
        near = near.groupBy("u").agg(F.array_sort(F.collect_set(F.struct("far", "v"))).alias("m"), F.max("more").alias("more"))
        near = staged(near.select("u", F.slice("m", 1, most).alias("m"), (F.col("more") | (F.size("m") > most)).alias("more")))
    pairs = near.select("u", F.explode("m.v").alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return pairs, near.filter("more").limit(1).count() > 0


def near_links(own: DataFrame, texts: DataFrame, bucket: int = BUCKET, listed: int = LISTED) -> DataFrame:
    """Links (u, v) between fingerprints that connect exactly what all pairs of texts connect that share at least NEAR_SIMILAR of their different NEAR_WIDTH-word shingles. own (skey, fp, size, place, bits, keys) has each set of shingles once, with one of its fingerprints; texts (doc_id, tkey, text) what stands at the places.

    At that similarity fingerprints are some ten bits apart, and up to twenty; nearly all pairs are that close in all distances to references, so tables of these discard nothing. Candidates are therefore sets that share a shingle of both prefixes (keys), which any two at NEAR_SIMILAR do. What their sizes, the place of the shingle and their parities rule out goes, the others are verified by all their shingles.

    A cell of more than bucket members first compares them with two of them. What is then connected needs no more pairs. Where members of a cell still have different roots, those that are not of its largest root are compared with all others in workers, after further stars around members of its largest root if there are very many pairs; of what may be at NEAR_SIMILAR the NEAREST are verified, what they link is one root, and of the rest CLOSER times as many, until no member has more. So neither pairs within a family nor all of a member's links are listed, and no pair is left out that could connect two.
    """
    spark = own.sparkSession
    with passing(spark) as put:
        entered = own.select("skey", "size", F.posexplode("keys").alias("at", "cell"))
        held = put(entered.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cell"))).filter("n > 1"))
        cold, hot = held.filter(F.col("n") <= bucket), held.filter(F.col("n") > bucket).drop("n")
        a, b = cold.alias("a"), cold.alias("b")
        pairs = _ordered(a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.skey") < F.col("b.skey")) & _may_share("a", "b")))
        found = verified(pairs.unionByName(_star(hot, _centres(hot, F.pmod("cell", F.lit(4))))), own, texts)
        turn, most = 0, NEAREST
        while True:
            roots = components(found)
            with passing(spark) as at_once:
                members = at_once(hot.join(roots.select(F.col("node").alias("skey"), "root"), "skey", "left").withColumn("root", F.coalesce("root", "skey")))
                of = members.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("cell")
                of = of.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"), F.max(F.struct("c", "root")).alias("most"))
                of = of.filter("n > most.c").select("cell", "n", ((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs"), (F.col("n") - F.col("most.c")).alias("few"), F.col("most.root").alias("major"))
                still = at_once(of)
                left = still.agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n")).first()
                if not left.n:
                    break
                members = members.join(small(still), "cell")
                if turn == ROUNDS or left.pairs <= listed * left.n:
                    turn = ROUNDS
                    near, more = _nearest(members, own, most)
                    found = staged(found.unionByName(verified(near, own, texts)))
                    if not more:
                        break
                    most *= CLOSER
                    continue
                turn += 1
                star = _star(members.filter("root != major"), _centres(members.filter("root = major"), F.pmod("cell", F.lit(4)) + 4 * turn))
                found = staged(found.unionByName(verified(star, own, texts)))
    name = own.select("skey", "fp")
    found = found.join(name.select(F.col("skey").alias("u"), F.col("fp").alias("x")), "u").join(name.select(F.col("skey").alias("v"), F.col("fp").alias("y")), "v")
    return found.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).filter("u < v").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    Null or empty texts and texts of white space have fingerprint zero and are linked like any other. Texts of any length are read whole. Repeated rows come out as often as they come in. Rows without doc_id take part; a component of only such rows has a null id. Columns other than doc_id and text are ignored. An empty table gives no rows.
    """
    prints = staged(fingerprints(docs))
    own = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(own.select("fp")))
    joined = own.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    of = joined.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row for each group of near-duplicates: that of the smallest doc_id, rows without doc_id last.

    Texts are linked as classes() links them, and where they share NEAR_SIMILAR of their NEAR_WIDTH-word shingles (near_links). Rows are told apart by doc_id and a hash of the text: of several texts of one doc_id in a group the smallest hash stays, and of rows equal in both the least one, compared by all columns (which must have an order); so reruns keep the same row, and no text goes but for one that is linked to it. Null, empty and white texts are one group. Texts of any length are read whole. An empty table gives no rows.
    """
    tkey = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("own"), F.col("doc_id").cast("long").alias("doc_id"), tkey.alias("tkey"), F.col("text").cast("string").alias("text"))
    texts = keyed.select("doc_id", "tkey", "text")
    place = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("tkey"))).alias("place")
    store = Staged(docs.sparkSession)
    with passing(docs.sparkSession) as put:
        sketches, at = store.put(texts.mapInArrow(partial(_sketched, common(texts)), _SKETCH))
        # texts of one set have the same size, parities and prefix; those without words share fingerprint zero
        own = put(sketches.filter("size > 0").groupBy("skey").agg(place, F.min("fp").alias("fp"), *(F.first(c).alias(c) for c in ("size", "bits", "keys"))))
        prints = put(sketches.select("doc_id", "tkey", "fp", "skey"))
        store.drop(at)
        points = put(prints.groupBy("fp").agg(place))
        alike = prints.select("skey", F.col("fp").alias("v")).distinct().join(own.select("skey", F.col("fp").alias("u")), "skey").filter("u < v").select("u", "v")
        roots = components(links(points.select("fp")).unionByName(near_links(own, texts)).unionByName(alike))
        joined = points.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
        kept = joined.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("place").alias("place"))
        kept = kept.select(F.col("place.doc_id").alias("_doc"), F.col("place.tkey").alias("_key"), F.lit(True).alias("kept"))
        copies = prints.groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("n"))
        # what stays and stands once needs no more ado
        told = copies.join(kept, _same_row(), "left").filter("kept is null or n > 1")
        told = staged(told.select(F.col("doc_id").alias("_doc"), F.col("tkey").alias("_key"), "kept", "n"))
    told = small(told)
    marked = keyed.drop("text").join(told, _same_row(), "left")
    again = marked.filter("kept").groupBy("doc_id", "tkey").agg(F.min("own").alias("own"))
    return marked.filter("n is null").select("own.*").unionByName(again.select("own.*"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash_near_dedup": op1}
ORACLES: dict[str, str] = {}
