"""Removal of repeated 50-byte strings by suffix arrays over shards.

Equal strings must meet, so text is cut by content: every LENGTH-byte window has a minimizer, the smallest hash of its GRAM-byte grams, and a maximal run of windows with one minimizer is a piece. Pieces go to shards by their minimizer; equal windows have equal minimizers, so all places of a string reach one shard. What a task has already seen under a smaller doc_id is settled there and not sent, so a passage that very many documents share arrives once per task.

No shard grows with the corpus. Before anything is sent, the bytes of pieces are counted by minimizer. Windows whose minimizer has more than HOT bytes (a gram that is common all over the corpus) are keyed by a second, independent minimizer as well, and where such a pair still has more than HOT, by a hash of the whole window. All three are functions of the window, so equal windows still meet.

In a shard, windows whose hash occurs in one document only are set aside. Over the rest a suffix array is built by Larsson-Sadakane refinement (sorting only the groups that are still tied, by the ranks a doubled distance ahead), common prefixes follow in Kasai's text order, and a run of suffixes with common prefixes of LENGTH bytes is one string; its smallest doc_id keeps it. A shard that outgrows a chunk sets windows aside over all of it first; what is left is one chunk in most cases, and else is cut into chunks with a suffix array each, whose strings are merged by binary search.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

LENGTH = 50
GRAM = 8
SPREAD = LENGTH - GRAM + 1  # grams in a window
CHUNK = (1 << 21) - 64  # bytes in a suffix array
ROUTE = 8 << 20  # bytes of pieces that are sent to one group, about
SUBS = 16  # shards in a group
FINE = 64  # parts of a route that are counted each
HOT = ROUTE  # bytes of pieces in such a part from which its windows are keyed more finely; so there is no more than one hot part for HOT bytes
FLUSH = 14 << 20  # bytes of pieces that a task holds back
BLOCK = 1 << 19  # bytes of documents cut at once
MOST_BROADCAST = 1_000_000  # touched documents up to which their ids are broadcast
GROWTH = 3.3  # bytes of pieces for a byte of text


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def words(buf: np.ndarray) -> np.ndarray:
    """The big-endian 8-byte word at each place; buf must have 7 bytes beyond the last place asked for."""
    x = buf.astype(np.uint64)
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    return (x[:-4] << np.uint64(32)) | x[4:]


def minimizers(w: np.ndarray) -> np.ndarray:
    """For each window the smallest hash among its grams, from the words at all places."""
    m = (_mix(w) >> np.uint64(32)).astype(np.uint32)
    width = 1
    while 2 * width <= SPREAD:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = SPREAD - width
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def _hashes(w: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """A hash of the LENGTH bytes of the windows at these places, from the words at all places."""
    n = len(w) - LENGTH + GRAM
    h = w[:n][at].copy()
    for i in (*range(8, LENGTH - 8, 8), LENGTH - 8):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= w[i : i + n][at]
    return _mix(h)


class Keys:
    """How windows are keyed: by their minimizer, those in a hot part by two, those in a part that is still hot by all of their bytes. hot has the hot parts of each step, ascending."""

    def __init__(self, parts: int, hot: list[np.ndarray]):
        self.parts, self.hot = np.uint64(parts), hot

    def part(self, keys: np.ndarray) -> np.ndarray:
        return keys % self.parts

    def _hot(self, keys: np.ndarray, step: int) -> np.ndarray:
        found = self.part(keys)
        at = np.minimum(np.searchsorted(self.hot[step], found), len(self.hot[step]) - 1)
        return self.hot[step][at] == found

    def of(self, w: np.ndarray) -> np.ndarray:
        keys = _mix(minimizers(w).astype(np.uint64) + np.uint64(1))
        if self.hot:
            at = np.flatnonzero(self._hot(keys, 0))
            if len(at):
                # only over the grams of these windows, side by side
                edge = np.zeros(len(w) + 1, np.int32)
                edge[at] += 1
                edge[at + SPREAD] -= 1
                held = np.cumsum(edge[:-1]) > 0
                second = minimizers(w[held] ^ np.uint64(0xD6E8FEB86659FD93))[(np.cumsum(held) - 1)[at]]
                keys[at] = _mix(keys[at] ^ _mix(second.astype(np.uint64) + np.uint64(1)))
                if len(self.hot) > 1:
                    at = at[self._hot(keys[at], 1)]
                    keys[at] = _hashes(w, at)
        return keys


def cut(texts: list[bytes], by: Keys) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of texts: (number of the text, start in it, bytes, key, a hash of the first and last window). Texts shorter than a window have none."""
    sizes = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if len(buf) < LENGTH:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    w = words(buf)
    m = by.of(w)
    whole = np.zeros(len(m) + 1, np.int8)  # windows that cross no end of a text
    has = sizes >= LENGTH
    np.add.at(whole, starts[has], 1)
    np.add.at(whole, ends[has] - LENGTH + 1, -1)
    whole = np.cumsum(whole[:-1], dtype=np.int8) > 0
    fresh = whole.copy()
    fresh[1:] &= ~(whole[:-1] & (m[1:] == m[:-1]))
    fresh[starts[has]] = True
    first = np.flatnonzero(fresh)
    stop = whole.copy()
    stop[:-1] &= fresh[1:] | ~whole[1:]
    last = np.flatnonzero(stop)
    text = np.searchsorted(ends, first, side="right")
    both = _hashes(w, first) ^ _mix(_hashes(w, last) + (last - first).astype(np.uint64))
    return text, first - starts[text], last - first + LENGTH, m[first], both


def _blocks(batch) -> Iterator[list[tuple[int, bytes]]]:
    """(doc_id, text) of the rows with an id and a window, by doc_id in a batch, some BLOCK bytes at once."""
    rows = sorted((d, t) for d, t in zip(batch.column("doc_id").to_pylist(), map(_encode, batch.column("text").to_pylist())) if d is not None and len(t) >= LENGTH)
    at = 0
    while at < len(rows):
        stop, n = at, 0
        while stop < len(rows) and (n == 0 or n + len(rows[stop][1]) <= BLOCK):
            n += len(rows[stop][1])
            stop += 1
        yield rows[at:stop]
        at = stop


def _summed(parts: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(parts), return_inverse=True)
    return found, np.bincount(at, np.concatenate(sizes), len(found)).astype(np.int64)


def _weigh(by: Keys):
    """(part, bytes): bytes of pieces in each part, of those that a task would send."""

    def run(batches):
        seen: set[int] = set()
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for rows in _blocks(batch):
                _, _, lens, keys, both = cut([t for _, t in rows], by)
                codes, at = np.unique(both, return_index=True)
                fresh = at[np.fromiter((c not in seen for c in codes.tolist()), bool, len(codes))]
                seen.update(codes.tolist())
                parts.append(by.part(keys[fresh]).astype(np.int64))
                sizes.append(lens[fresh])
                held += int(lens[fresh].sum())
                if held >= FLUSH:
                    seen.clear()
                    held = 0
                    together = _summed(parts, sizes)
                    parts, sizes = [together[0]], [together[1]]
        if parts:
            found, n = _summed(parts, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["part", "bytes"])

    return run


def keyed(docs: DataFrame, routes: int, hot: int = HOT) -> Keys:
    """How the windows of docs are to be keyed. The driver gets the hot parts alone, at most one for hot bytes of pieces, a long each."""
    by = Keys(routes * FINE, [])
    for _ in range(2):
        weights = docs.mapInArrow(_weigh(by), "part long, bytes long").groupBy("part").agg(F.sum("bytes").alias("bytes"))
        found = weights.filter(F.col("bytes") > hot).select("part").toPandas()["part"].to_numpy(np.uint64)
        if not len(found):
            break
        by = Keys(routes * FINE, [*by.hot, np.sort(found)])
    return by


def _pack(pieces: list[bytes], docs: np.ndarray, crcs: np.ndarray, offs: np.ndarray, sizes: np.ndarray, subs: np.ndarray) -> bytes:
    """Pieces, which are in the order of their shard and document, in one run of bytes; doc_ids as differences."""
    parts = [
        struct.pack("<I", len(pieces)),
        np.bincount(subs, minlength=SUBS).astype("<u4").tobytes(),
        np.diff(docs, prepend=np.int64(0)).tobytes(),
        crcs.tobytes(),
        offs.tobytes(),
        sizes.tobytes(),
        *pieces,
    ]
    return b"".join(parts)


class Pieces:
    """Pieces of a shard: bytes one after another, and for each its bytes, doc_id, checksum of its text and place in it."""

    def __init__(self, data: bytes, sizes, docs, crcs, offs):
        self.data, self.sizes, self.docs, self.crcs, self.offs = data, sizes, docs, crcs, offs

    def part(self, a: int, b: int) -> Pieces:
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        return Pieces(self.data[ends[a] : ends[b]], *(getattr(self, n)[a:b] for n in ("sizes", "docs", "crcs", "offs")))


def _unpack(blobs: list[bytes]) -> Iterator[Pieces]:
    """The pieces of each shard in the blobs, those of all blobs together."""
    texts: list[list[bytes]] = [[] for _ in range(SUBS)]
    many, columns = [], []
    expand = zstandard.ZstdDecompressor().decompress
    for blob in blobs:
        data = expand(blob)
        n = struct.unpack_from("<I", data)[0]
        at = 4
        arrays = []
        for kind, count in (("<u4", SUBS), ("<i8", n), ("<u4", n), ("<i8", n), ("<u4", n)):
            a = np.frombuffer(data, kind, count, at)
            arrays.append(a)
            at += a.nbytes
        counts, ids, crcs, offs, sizes = arrays
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])] + at
        for own, s, e in zip(texts, ends[:-1].tolist(), ends[1:].tolist()):
            if e > s:
                own.append(data[s:e])
        many.append(counts)
        # copies, as views would hold the bytes of all pieces
        columns.append((sizes.astype(np.int64), np.cumsum(ids), crcs.copy(), offs.copy()))
    if not many:
        return
    shard = np.repeat(np.tile(np.arange(SUBS), len(many)), np.concatenate(many))
    order = np.argsort(shard, kind="stable")
    every = [np.concatenate(c)[order] for c in zip(*columns)]
    stops = np.cumsum(np.bincount(shard, minlength=SUBS))
    for sub, (s, e) in enumerate(zip([0, *stops[:-1].tolist()], stops.tolist())):
        if e > s:
            data, texts[sub] = b"".join(texts[sub]), []
            yield Pieces(data, *(c[s:e] for c in every))


def suffix_array(buf: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of buf in the order of their first depth bytes or more, and the rank of each place.

    Ranks start from the first 8 bytes; each round sorts the places of tied groups by the rank as far ahead as is sorted already, and doubles that distance. Beyond the end everything is smaller.
    """
    n = len(buf)
    first = words(np.concatenate([buf, np.zeros(8, np.uint8)]))[:n]
    order = np.argsort(first, kind="stable")
    key = first[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = heads
    packed = n < (1 << 21) - 1
    ahead = 8
    while ahead < depth:
        alone = new & np.concatenate([new[1:], [True]])
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        at = order[slots]
        further = np.where(at + ahead < n, rank[np.minimum(at + ahead, n - 1)] + 1, 0)
        own = rank[at]
        if packed:
            k = np.sort(own << 42 | further << 21 | at)
            at, pair = k & ((1 << 21) - 1), k >> 21
            changed = np.concatenate([[True], pair[1:] != pair[:-1]])
        else:
            by = np.lexsort((at, further, own))
            at, own, further = at[by], own[by], further[by]
            changed = np.concatenate([[True], (own[1:] != own[:-1]) | (further[1:] != further[:-1])])
        order[slots] = at
        new[slots] = changed
        heads = np.maximum.accumulate(np.where(changed, np.arange(len(slots)), 0))
        rank[at] = slots[heads]
        ahead *= 2
    return order, rank


def common_prefixes(buf: np.ndarray, order: np.ndarray, cap: int = LENGTH) -> np.ndarray:
    """For each slot of the suffix array the common prefix with the slot before, up to cap.

    In text order, as Kasai does: a place shares at least one byte less with its neighbour in the array than the place before it shares with its own. Every eighth place is compared from its first byte, the others from that bound. Where the place before reached the cap, its order may rest on bytes beyond the array's depth, so the bound isn't used.
    """
    n = len(buf)
    w = words(np.concatenate([buf, np.zeros(cap + 16, np.uint8)]))
    prior = np.full(n, -1, np.int64)
    prior[order[1:]] = order[:-1]
    plcp = np.zeros(n, np.int64)
    for phase in range(8):
        at = np.arange(phase, n, 8)
        if phase:
            plcp[at] = np.where(plcp[at - 1] < cap, np.maximum(plcp[at - 1] - 1, 0), 0)
        at = at[prior[at] >= 0]
        while len(at):
            at = at[plcp[at] < cap]
            a, b = at + plcp[at], prior[at] + plcp[at]
            diff = w[np.minimum(a, len(w) - 1)] ^ w[np.minimum(b, len(w) - 1)]
            same = diff == 0
            lead = diff[~same]
            # bytes that agree ahead of the first that differs
            more = np.zeros(len(lead), np.int64)
            for i in range(1, 8):
                more += (lead >> np.uint64(64 - 8 * i)) == 0
            plcp[at[~same]] += more
            plcp[at[same]] += 8
            at = at[same]
    # past the end of the buffer there is nothing to share
    room = n - np.maximum(np.arange(n), prior)
    plcp = np.minimum(np.minimum(plcp, cap), room)
    plcp[prior < 0] = 0
    return plcp[order]


class Shard:
    """One chunk with its windows, their owners and, after solve(), the strings among them: reps, the first place of each, in order, and least, the smallest doc_id that has it."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.buf = np.frombuffer(pieces.data, np.uint8)
        ends = np.cumsum(pieces.sizes)
        self.starts = ends - pieces.sizes

    def windows(self) -> np.ndarray:
        """The places at which windows start, ascending."""
        many = self.pieces.sizes - LENGTH + 1
        return np.repeat(self.starts - np.cumsum(many) + many, many) + np.arange(many.sum())

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1

    def solve(self, places: np.ndarray) -> None:
        """Groups the windows at places (ascending) by their string."""
        self.places = places
        cover = np.zeros(len(self.buf) + 1, np.int32)
        np.add.at(cover, places, 1)
        np.add.at(cover, places + LENGTH, -1)
        held = np.cumsum(cover[:-1]) > 0
        text = self.buf[held]
        at = (np.cumsum(held) - 1)[places]
        back = np.full(len(text), -1, np.int64)
        back[at] = np.arange(len(places))
        order, _ = suffix_array(text)
        lcp = common_prefixes(text, order)
        run = np.cumsum(lcp < LENGTH)
        mine = back[order]
        use = mine >= 0
        which, run = mine[use], run[use]
        new = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.empty(0, bool)
        doc = self.pieces.docs[self.owner(places)]
        self.string = np.empty(len(places), np.int64)
        self.string[which] = np.cumsum(new) - 1
        self.reps = places[which[new]]
        self.least = np.minimum.reduceat(doc[which], np.flatnonzero(new)) if len(new) else np.empty(0, np.int64)
        self.doc = doc

    def keys(self) -> np.ndarray:
        """The strings of reps as rows of words, in their order."""
        w = words(np.concatenate([self.buf, np.zeros(8, np.uint8)]))
        return np.stack([w[self.reps + i] for i in (*range(0, LENGTH - 8, 8), LENGTH - 8)], axis=1) if len(self.reps) else np.empty((0, 7), np.uint64)

    def spans(self) -> list[tuple[int, int, int, int]]:
        """(doc_id, checksum, start, end) of what goes: strings that a smaller doc_id has."""
        gone = self.places[self.least[self.string] < self.doc] if len(self.places) else self.places
        if not len(gone):
            return []
        piece = self.owner(gone)
        begins = np.concatenate([[True], (piece[1:] != piece[:-1]) | (gone[1:] > gone[:-1] + LENGTH)])
        first = np.flatnonzero(begins)
        last = np.concatenate([first[1:] - 1, [len(gone) - 1]])
        p = piece[first]
        shift = self.pieces.offs[p] - self.starts[p]
        return list(zip(self.pieces.docs[p].tolist(), self.pieces.crcs[p].tolist(), (gone[first] + shift).tolist(), (gone[last] + LENGTH + shift).tolist()))


def search(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The row of among (ascending) that equals each row of keys, or -1, by binary search over all keys at once."""
    if not len(among):
        return np.full(len(keys), -1, np.int64)
    lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(among), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        probe = among[np.minimum(mid, len(among) - 1)]
        differ = probe != keys
        col = differ.argmax(axis=1)
        row = np.arange(len(keys))
        less = differ[row, col] & (probe[row, col] < keys[row, col])
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    at = np.minimum(lo, len(among) - 1)
    return np.where((lo < len(among)) & (among[at] == keys).all(axis=1), at, -1)


def _cuts(sizes: np.ndarray, chunk: int) -> list[tuple[int, int]]:
    """Stretches of items of chunk together, or of one that is larger."""
    ends = np.cumsum(sizes)
    cuts = [0]
    while cuts[-1] < len(ends):
        done = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, done + chunk, side="right"))))
    return list(zip(cuts, cuts[1:]))


def doubtful(pieces: Pieces, chunk: int = CHUNK) -> np.ndarray:
    """Places of the windows whose hash occurs in two documents or more, ascending; hashes are made of a chunk at a time, twice."""
    parts = [(Shard(pieces.part(a, b)), int(pieces.sizes[:a].sum())) for a, b in _cuts(pieces.sizes, chunk)]
    bits = max(21, (len(pieces.data) - 1).bit_length())
    held = np.zeros(1 << bits, np.int64)

    def hashed(shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places = shard.windows()
        h = _hashes(words(np.concatenate([shard.buf, np.zeros(8, np.uint8)])), places)
        return places, h, (h >> np.uint64(64 - bits)).astype(np.int64)

    last = None
    for shard, _ in parts:
        last = hashed(shard)
        held += np.bincount(last[2], minlength=1 << bits)
    keys, docs, at = [], [], []
    for shard, base in parts:
        places, h, cell = last if len(parts) == 1 else hashed(shard)
        some = np.flatnonzero(held[cell] > 1)
        keys.append(h[some])
        docs.append(shard.pieces.docs[shard.owner(places[some])])
        at.append(places[some] + base)
    key, doc, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, docs, at))
    if not len(key):
        return np.empty(0, np.int64)
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    heads = np.flatnonzero(new)
    mixed = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
    return np.sort(place[order[mixed[np.cumsum(new) - 1]]])


def resolve(pieces: Pieces, chunk: int = CHUNK) -> list[tuple[int, int, int, int]]:
    """What goes from the pieces of one shard. Windows that no other document has are set aside over the whole of it. If what the others cover fits a chunk it is solved at once; else chunks get a suffix array each and are merged."""
    places = doubtful(pieces, chunk)
    if not len(places):
        return []
    ends = np.cumsum(pieces.sizes)
    # bytes that are covered, by piece
    fresh = np.minimum(np.diff(places, prepend=np.int64(-LENGTH)), LENGTH)
    covered = np.bincount(np.searchsorted(ends, places, side="right"), fresh, len(ends)).astype(np.int64)
    if covered.sum() <= chunk or len(ends) < 2:
        whole = Shard(pieces)
        whole.solve(places)
        return whole.spans()
    shards = []
    for a, b in _cuts(covered, chunk):
        base = int(ends[a - 1]) if a else 0
        s = Shard(pieces.part(a, b))
        s.solve(places[np.searchsorted(places, base) : np.searchsorted(places, int(ends[b - 1]))] - base)
        shards.append(s)
    own = [s.least for s in shards]
    for i, a in enumerate(shards):
        keys, least = a.keys(), own[i].copy()
        for j, b in enumerate(shards):
            if i != j:
                found = search(keys, b.keys())
                has = found >= 0
                least[has] = np.minimum(least[has], own[j][found[has]])
        a.least = least
    return [x for s in shards for x in s.spans()]


_SENT = pa.schema([("route", pa.int32()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])
_SENT_SQL = "route int, blob binary, doc_id long, crc long, s long, e long"
_SPAN = pa.schema([("doc_id", pa.int64()), ("crc", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])
_SPAN_SQL = "doc_id long, crc long, s long, e long"


def _encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


class Outbox:
    """What a task holds back: pieces that are new to it, and spans of pieces that it has seen under a smaller doc_id."""

    def __init__(self, routes: int, by: Keys):
        self.routes, self.by = routes, by
        self.clear()

    def clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.pieces: list[bytes] = []
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.spans: list[list[int]] = []
        self.size = 0

    def take(self, rows: list[tuple[int, bytes]]) -> None:
        """rows (doc_id, text); the next ones may have smaller ids, as what is settled here needs only a smaller one before."""
        texts = [t for _, t in rows]
        which, offs, lens, keys, _ = cut(texts, self.by)
        docs = np.array([d for d, _ in rows], np.int64)[which]
        crcs = np.array([zlib.crc32(t) for t in texts], np.int64)[which]
        kept = np.ones(len(which), bool)
        seen, pieces, spans = self.seen, self.pieces, self.spans
        for k, (i, a, n, doc) in enumerate(zip(which.tolist(), offs.tolist(), lens.tolist(), docs.tolist())):
            piece = texts[i][a : a + n]
            if seen.setdefault(piece, doc) < doc:
                kept[k] = False
                if spans and spans[-1][0] == doc and spans[-1][1] == crcs[k] and spans[-1][2] <= a <= spans[-1][3]:
                    spans[-1][3] = max(spans[-1][3], a + n)
                else:
                    spans.append([doc, int(crcs[k]), a, a + n])
            else:
                seen[piece] = doc
                pieces.append(piece)
        keys = keys[kept]
        self.columns.append((docs[kept], crcs[kept].astype("<u4"), offs[kept], lens[kept].astype("<u4"), (keys >> np.uint64(60)).astype(np.int64), (keys % np.uint64(self.routes)).astype(np.int64)))
        self.size += int(lens[kept].sum()) + 60 * int(kept.sum())

    def batches(self):
        if self.pieces:
            docs, crcs, offs, sizes, subs, routes = (np.concatenate(c) for c in zip(*self.columns))
            order = np.lexsort((offs, docs, subs, routes))
            docs, crcs, offs, sizes, subs, routes = (c[order] for c in (docs, crcs, offs, sizes, subs, routes))
            pieces = [self.pieces[i] for i in order.tolist()]
            cuts = np.flatnonzero(np.diff(routes, prepend=-1, append=-1)).tolist()
            squeeze = zstandard.ZstdCompressor(level=3).compress
            blobs = [squeeze(_pack(pieces[a:b], docs[a:b], crcs[a:b], offs[a:b], sizes[a:b], subs[a:b])) for a, b in zip(cuts, cuts[1:])]
            none = pa.nulls(len(blobs), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(routes[cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary()), none, none, none, none], schema=_SENT)
        if self.spans:
            doc, crc, s, e = zip(*self.spans)
            yield pa.RecordBatch.from_pydict({"route": [d % self.routes for d in doc], "blob": [None] * len(doc), "doc_id": doc, "crc": crc, "s": s, "e": e}, schema=_SENT)
        self.clear()


def _spread(routes: int, by: Keys | None = None):
    """Blobs of pieces by route, and spans that the task settles itself, dealt by doc_id."""

    def run(batches):
        box = Outbox(routes, by or Keys(routes * FINE, []))
        for batch in batches:
            for rows in _blocks(batch):
                box.take(rows)
                if box.size >= FLUSH:
                    yield from box.batches()
        yield from box.batches()

    return run


def distinct(pieces: Pieces) -> tuple[Pieces, list[tuple[int, int, int, int]]]:
    """The pieces with each byte string once, under its smallest doc_id (and all rows of that id), and the spans of the others, which go whole."""
    order = np.argsort(pieces.docs, kind="stable")
    starts = np.cumsum(pieces.sizes) - pieces.sizes
    seen: dict[bytes, int] = {}
    kept, parts, gone = [], [], []
    for i, a, n, doc in zip(order.tolist(), starts[order].tolist(), pieces.sizes[order].tolist(), pieces.docs[order].tolist()):
        piece = pieces.data[a : a + n]
        if seen.setdefault(piece, doc) < doc:
            gone.append(i)
        else:
            kept.append(i)
            parts.append(piece)
    rest = Pieces(b"".join(parts), *(getattr(pieces, n)[kept] for n in ("sizes", "docs", "crcs", "offs")))
    offs = pieces.offs[gone]
    return rest, list(zip(pieces.docs[gone].tolist(), pieces.crcs[gone].tolist(), offs.tolist(), (offs + pieces.sizes[gone]).tolist()))


def _gather(table: pa.Table) -> pa.Table:
    sent = table.filter(pc.is_valid(table.column("blob")))
    settled = table.filter(pc.is_null(table.column("blob"))).select(["doc_id", "crc", "s", "e"])
    rows: list[tuple[int, int, int, int]] = []
    for shard in _unpack(sent.column("blob").to_pylist()):
        pieces, gone = distinct(shard)
        rows += gone
        rows += resolve(pieces)
    pa.default_memory_pool().release_unused()
    met = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, _SPAN.types)], schema=_SPAN)
    return pa.concat_tables([met, settled.cast(_SPAN)])


def spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, crc, s, e): stretches of bytes that go, which may overlap; crc is the CRC-32 of the text's bytes and tells texts of one doc_id apart."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routes = max(1, round(total * GROWTH / ROUTE))
    return docs.mapInArrow(_spread(routes, keyed(docs, routes, hot)), _SENT_SQL).groupBy("route").applyInArrow(_gather, _SPAN_SQL)


def merge(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _apply(batches):
    for batch in batches:
        rows = []
        for doc, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            data = _encode(text)
            runs = merge([(x["s"], x["e"]) for x in found or []])
            digest, at = hashlib.sha256(), 0
            for s, e in runs:
                digest.update(data[at:s])
                at = e
            digest.update(data[at:])
            rows.append((doc, len(data), sum(e - s for s, e in runs), len(runs), digest.hexdigest()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs.

    A null text is empty. Rows of one doc_id never remove from each other; each is judged by its own text, and repeated rows alike. A row without doc_id has no place in the order: it keeps everything and removes nothing. Texts of any length are taken whole. Columns other than doc_id and text are ignored. An empty table gives no rows. Ids of touched documents are broadcast only up to MOST_BROADCAST; beyond, the tables are joined by a shuffle.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = staged(spans(docs, hot).groupBy("doc_id", "crc").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    ids = marks.select("doc_id").distinct()
    if ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    whole = docs.join(ids, "doc_id", "left_anti").select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
    touched = docs.join(ids, "doc_id", "left_semi").withColumn("crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).join(marks, ["doc_id", "crc"], "left")
    return whole.unionByName(touched.select("doc_id", "text", "spans").mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))


QUERIES = {"op4_substring_dedup": op4}
#: All windows by their bytes, runs of removed ones, and what stands between them.
ORACLE = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), e AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, i, array_slice(b, i, i + 49) AS s FROM e, LATERAL (SELECT unnest(range(1, n - 48)) AS i) t),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT w.doc_id, w.i FROM w JOIN f ON f.s = w.s WHERE f.m < w.doc_id),
r AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM g),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS z FROM k GROUP BY doc_id, run),
cut AS (SELECT doc_id, a AS stop, z + 1 AS next FROM sp UNION ALL SELECT doc_id, n + 1, NULL FROM e),
part AS (SELECT doc_id, stop, coalesce(lag(next) OVER (PARTITION BY doc_id ORDER BY stop), 1) AS start FROM cut),
kept AS (SELECT e.doc_id, string_agg(CASE WHEN stop > start THEN hex(array_slice(b, start, stop - 1)) ELSE '' END, '' ORDER BY stop) AS h FROM part JOIN e ON e.doc_id = part.doc_id GROUP BY e.doc_id),
cnt AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM sp GROUP BY doc_id)
SELECT e.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256 FROM e JOIN kept ON kept.doc_id = e.doc_id LEFT JOIN cnt ON cnt.doc_id = e.doc_id"""
ORACLES = {"op4_substring_dedup": ORACLE}
