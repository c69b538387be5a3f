"""String similarities. What Catalyst can say stays there; the rest runs over Arrow batches on distinct calls.

Conventions at the edges: two empty texts score 100 and one empty text 0, but any empty side scores 0 in token_set_ratio.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of bits per step: a set bit stays until a match passes it."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    """200 * LCS / (len a + len b)."""
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total if total else 100.0


def partial_ratio_of(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer; windows hang over either end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    m = len(a)
    best = 0.0
    chars = set(a)
    for start in range(1 - m, len(b)):
        lo, hi = max(start, 0), min(start + m, len(b))
        # a window that begins without a character of a is no better than the next one, and one at the begin that ends so no better than a shorter one
        if b[lo] not in chars if lo else hi < len(b) and b[hi - 1] not in chars:
            continue
        best = max(best, ratio_of(a, b[lo:hi]))
        if best == 100.0:
            break
    return best


WORD = 63  # letters of the shorter text up to which partial_ratios() works on many pairs at once
TOGETHER = 1 << 16  # windows that it looks at in one step


def _letters(texts: list[str], pad: int) -> np.ndarray:
    """Code points of texts as rows, filled up with pad."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), max(1, int(sizes.max(initial=0)))), pad, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _partial_of_many(a: list[str], b: list[str]) -> np.ndarray:
    """partial_ratio_of() of pairs with 0 < len(a) <= len(b) and len(a) <= WORD: the rows of lcs() for all windows of all pairs, a machine word each."""
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    x, y = _letters(a, -1), _letters(b, -2)
    # for each letter of b the places in a that have it
    places = np.zeros(y.shape, np.uint64)
    for i in range(x.shape[1]):
        places |= np.where(y == x[:, i : i + 1], np.uint64(1) << np.uint64(i), np.uint64(0))
    many = m + n - 1
    pair = np.repeat(np.arange(len(a)), many)
    start = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + 1 - m[pair]
    lo, hi = np.maximum(start, 0), np.minimum(start + m[pair], n[pair])
    full = (np.uint64(1) << m[pair].astype(np.uint64)) - np.uint64(1)
    row = full.copy()
    for k in range(int(m.max())):
        at = lo + k
        hit = row & np.where(at < hi, places[pair, np.minimum(at, y.shape[1] - 1)], np.uint64(0))
        row = ((row + hit) | (row - hit)) & full
    score = 200.0 * (m[pair] - np.bitwise_count(row).astype(np.int64)) / (m[pair] + hi - lo)
    return np.maximum.reduceat(score, np.cumsum(many) - many)


def partial_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """partial_ratio_of() of each pair."""
    out = [0.0] * len(pairs)
    held: list[int] = []
    windows = 0

    def settle() -> None:
        a, b = zip(*(sorted(pairs[i], key=len) for i in held))
        for i, score in zip(held, _partial_of_many(list(a), list(b)).tolist()):
            out[i] = score

    for i, (a, b) in enumerate(pairs):
        if not a or not b or min(len(a), len(b)) > WORD:
            out[i] = partial_ratio_of(a, b)
            continue
        held.append(i)
        windows += len(a) + len(b)
        if windows >= TOGETHER:
            settle()
            held, windows = [], 0
    if held:
        settle()
    return out


def _ratio_of_many(a: list[str], b: list[str]) -> np.ndarray:
    """ratio_of() of pairs with 0 < len(a) <= len(b) and len(a) <= WORD, a machine word each."""
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    x, y = _letters(a, -1), _letters(b, -2)
    full = (np.uint64(1) << m.astype(np.uint64)) - np.uint64(1)
    row = full.copy()
    bits = np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64)
    for k in range(y.shape[1]):
        hit = row & np.where(x == y[:, k : k + 1], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (m - np.bitwise_count(row).astype(np.int64)) / (m + n)


def ratios(pairs: list[tuple[str, str]], together: int = 2048) -> list[float]:
    """ratio_of() of each pair; those of like length side by side."""
    short = [i for i, (a, b) in enumerate(pairs) if 0 < min(len(a), len(b)) <= WORD]
    out = dict.fromkeys(short, 0.0)
    short.sort(key=lambda i: max(map(len, pairs[i])))
    for at in range(0, len(short), together):
        some = short[at : at + together]
        a, b = zip(*(sorted(pairs[i], key=len) for i in some))
        out.update(zip(some, _ratio_of_many(list(a), list(b)).tolist()))
    return [out[i] if i in out else ratio_of(*p) for i, p in enumerate(pairs)]


def jaro_winkler_of(a: str, b: str, weight: float = 0.1) -> float:
    """0 to 1; the common prefix of up to four characters counts where the Jaro similarity exceeds 0.7."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    first = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, u in zip(b, used) if u]
    m, swapped = len(first), sum(x != y for x, y in zip(first, second)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


def _pairwise(function):
    @F.pandas_udf(T.FloatType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a, b):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in seen:
                if len(seen) > 50_000:
                    seen.clear()
                seen[pair] = function(*pair)
            out.append(seen[pair])
        return pd.Series(out, dtype="float32")

    return run


def _distinct(function):
    """function, which takes a list of pairs, over the distinct pairs of a batch."""

    @F.pandas_udf(T.FloatType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        both = list(zip(a, b))
        found = list({p for p in both if p[0] is not None and p[1] is not None})
        scores = dict(zip(found, function(found)))
        return pd.Series([scores.get(p) for p in both], dtype="float32")

    return run


_ratio, _partial, _jaro = _distinct(ratios), _distinct(partial_ratios), _pairwise(jaro_winkler_of)


def _settled(run, a: Column, b: Column, same: float) -> Column:
    """run(a, b), but equal sides score same and an empty one 0 without being sent."""
    open_ = (a != b) & (a != "") & (b != "")
    return F.when(a == b, F.lit(same).cast("float")).when((a == "") | (b == ""), F.lit(0.0).cast("float")).otherwise(run(F.when(open_, a), F.when(open_, b)))


def ratio(a: Column, b: Column) -> Column:
    return _settled(_ratio, a, b, 100.0)


def partial_ratio(a: Column, b: Column) -> Column:
    return _settled(_partial, a, b, 100.0)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _settled(_jaro, a, b, 1.0)


def _sorted(x: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(x, " "), lambda t: t != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """ratio of the texts with their tokens sorted."""
    return ratio(_sorted(a), _sorted(b))


def set_ratio_of(a: str, b: str) -> float:
    """token_set_ratio of two texts, in Python: for learning and tests."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    joined = lambda *parts: " ".join(t for p in parts for t in p)
    best = ratio_of(joined(both, left), joined(both, right)) if both else ratio_of(joined(left), joined(right))
    if both:
        base = joined(both)
        best = max(best, ratio_of(base, joined(both, left)), ratio_of(base, joined(both, right)))
    return best


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best of the ratios among common tokens, common plus left and common plus right ones; 100 if one side's tokens are all common, 0 if a side is empty. Sets, these cases and the ratios with the common tokens, which are a prefix, are made in place; only the ratio of the two fuller texts is sent."""
    tokens = lambda x: F.array_sort(F.array_distinct(F.filter(F.split(x, " "), lambda t: t != "")))
    x, y = tokens(a), tokens(b)
    both = F.array_join(F.array_intersect(x, y), " ")
    left, right = (F.array_join(F.array_except(p, q), " ") for p, q in ((x, y), (y, x)))
    fuller = lambda rest: F.when(both == "", rest).otherwise(F.concat(both, F.lit(" "), rest))
    ab, ba, n = fuller(left), fuller(right), F.length(both)
    prefix = lambda z: F.when(n > 0, 200.0 * n / (n + F.length(z))).otherwise(0.0)
    open_ = (F.size(x) > 0) & (F.size(y) > 0) & (left != "") & (right != "")
    best = F.greatest(_ratio(F.when(open_, ab), F.when(open_, ba)).cast("double"), prefix(ab), prefix(ba))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).when((left == "") | (right == ""), F.when(n > 0, 100.0).otherwise(0.0)).otherwise(best).cast("float")
