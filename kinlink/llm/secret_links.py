"""Secret scans with multipart credential linking.

Certain findings (the base kinds) are reported on sight. Weak ones (an access identifier named as such, a random-looking key, an endpoint) are reported only when complementary parts co-occur in a scope: an identifier needs a secret, a secret an identifier or an endpoint, an endpoint a secret. Scopes are the REACH characters around a part, from the end of one to the start of the other, and the section of settings (lines of one assignment each, without a blank or foreign line between) that both stand in, whatever its length.

Parts and sections are cut out of whole texts by regular expressions on the JVM, and the interval join runs as windows over the parts of a text, so no pairs are made.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

REACH = 200

_ASSIGN = "password|passwd|secret|token|api_?key"
_IDS = "access_?key_?id|key_?id|client_?id|account_?id|user_?name|login"
_ENDS = r"https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3"
#: Kind, the pattern, and the fewest characters (of group 2 for assign, else of the match). Patterns match without the bound and failing matches go afterwards, as a match that fails still uses up its text.
BASE = (
    ("assign", rf"""(?i:{_ASSIGN})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]{24,}", 24),
)
#: What stands before group 2 in an assign match.
ASSIGN_HEAD = rf"""^(?i:{_ASSIGN})["']?\x20*[:=]\x20*["']?"""

#: Weak parts: kind, pattern. A key must hold a digit, a capital and a small letter besides.
WEAK = (
    ("weak_id", rf"""(?i:{_IDS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{{4,}}"""),
    ("weak_key", r"[A-Za-z0-9+/_-]{20,}={0,2}"),
    ("weak_end", rf"""(?i:{_ENDS})://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]{{4,}}"""),
)
#: What a text must hold before a pattern is tried on it; cheaper than the pattern, and true wherever it matches.
GUARDS = {"assign": r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]", "access": "AKIA", "weak_id": r"[:=]\x20*[\"']?[A-Za-z0-9_.@-]", "weak_end": "://"}
GUARDS["weak_key"] = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{20})(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])"
KINDS = tuple(k for k, *_ in BASE) + tuple(k for k, _ in WEAK)
IDS, KEYS, ENDS = ([KINDS.index(x) for x in names] for names in (("access", "weak_id"), ("assign", "hex", "weak_key"), ("weak_end",)))
#: A line of a section: one name with one value, quoted or without blanks; or brackets alone; or a comment.
LINE = r"""[ \t]*(?:(?:export[ \t]+)?["']?[A-Za-z0-9_.-]+["']?[ \t]*[:=][ \t]*(?:"[^"\n]*"|'[^'\n]*'|[^\s"']*)[,;]?|[{}()\[\],;]+|#[^\n]*)[ \t\r]*"""
#: Possessive, so that Java runs through the lines without recursion.
SECTION = rf"(?md)(?:^{LINE}(?:\n|\z))++"
SECTION_KIND = len(KINDS)

_BLOCK = 256  # elements that one fold runs through
_SPAN = "array<struct<s:int,e:int,k:int,m:string>>"


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, add: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """The running sums (by add, from 0 on) of an array of numbers. A fold copies what it has so far at each element, so it runs through blocks only; the blocks' totals are summed in the same way, a level up."""

    def fold(block: Column) -> Column:
        # the first element of the result is the 0 it starts from
        return F.aggregate(block, F.array(F.lit(0)), lambda out, x: F.concat(out, F.array(add(F.element_at(out, -1), x))))

    if not levels:
        return F.slice(fold(values), 2, F.size(values))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))
    inner = F.transform(blocks, lambda x: F.slice(fold(x), 2, F.size(x)))

    def joined(parts: Column) -> Column:
        def shifted(befores: Column) -> Column:
            return F.flatten(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda v: add(F.element_at(befores, F.greatest(i, F.lit(1))), v)))))

        return _with(running(F.transform(parts, lambda x: F.element_at(x, -1)), add, levels - 1), shifted)

    return F.when(F.size(values) > 0, _with(inner, joined)).otherwise(F.array().cast("array<int>"))


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<s, e, k, m>> of all leftmost non-overlapping matches, by code points. The pieces between matches and the matches give the ends."""

    def placed(m: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(m)), m, lambda p, x: F.length(p) + F.length(x))
        ends = _with(lengths, lambda x: running(x, lambda a, b: a + b))
        return F.zip_with(ends, m, lambda e, x: F.struct((e - F.length(x)).alias("s"), e.alias("e"), F.lit(kind).alias("k"), x.alias("m")))

    return _with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _none() -> Column:
    return F.array().cast(_SPAN)


def _holds(text: Column, kind: str, pattern: str) -> Column:
    guard = GUARDS.get(kind)
    return text.rlike(pattern) if guard is None else text.rlike(guard) & text.rlike(pattern)


def _base(text: Column) -> list[Column]:
    out = []
    for i, (kind, pattern, least) in enumerate(BASE):
        kept = F.filter(_spans(text, pattern, i), _long_enough(kind, least))
        out.append(F.when(_holds(text, kind, pattern), kept).otherwise(_none()))
    return out


def _long_enough(kind: str, least: int):
    def test(x: Column) -> Column:
        return F.length(F.regexp_replace(x["m"], ASSIGN_HEAD, "") if kind == "assign" else x["m"]) >= least

    return test


def _random_looking(x: Column) -> Column:
    return (x["k"] != KINDS.index("weak_key")) | (x["m"].rlike("[0-9]") & x["m"].rlike("[A-Z]") & x["m"].rlike("[a-z]"))


def _weak(text: Column) -> Column:
    found = reduce(F.concat, [F.when(_holds(text, k, p), _spans(text, p, len(BASE) + i)).otherwise(_none()) for i, (k, p) in enumerate(WEAK)])
    return F.filter(found, _random_looking)


def _digest(spans: Column) -> Column:
    """'kind:start:end' by start, then by kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    plain = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return F.array_join(F.transform(plain, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _clear(parts: DataFrame, kinds: list[int], of: list[int]) -> DataFrame:
    """parts (doc_id, tkey, s, e, k) without those of kinds that overlap one of the kinds of."""
    by = Window.partitionBy("doc_id", "tkey")
    other, own = F.col("k").isin(of), F.col("k").isin(kinds)
    ends = F.max(F.when(other, F.col("e"))).over(by.orderBy("s", "k").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.min(F.when(other, F.col("s"))).over(by.orderBy(F.desc("s"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1))
    over = F.coalesce(ends > F.col("s"), F.lit(False)) | F.coalesce(starts < F.col("e"), F.lit(False))
    return parts.withColumn("_over", over).filter(~own | ~F.col("_over")).drop("_over")


def linked(parts: DataFrame) -> DataFrame:
    """(doc_id, tkey, s, e, k) of the weak parts that hold together with complementary ones, from the parts and sections of texts (doc_id, tkey, s, e, k).

    A weak part that overlaps a base finding is reported already; a key that overlaps an identifier or an endpoint is that one's own value. Both are no parts. A part's own length does not use up REACH: the gap runs from the latest end of the parts of a kind that start before it, and to the earliest start of those that follow. A part is in the section in which it starts.
    """
    weak = list(range(len(BASE), len(KINDS)))
    parts = _clear(parts, weak, list(range(len(BASE))))
    parts = _clear(parts, [KINDS.index("weak_key")], [KINDS.index("weak_id"), KINDS.index("weak_end")])
    by = Window.partitionBy("doc_id", "tkey")
    # sections do not overlap, so the last one that starts at or before a part is the only one that may hold it
    so_far = by.orderBy("s", F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.col("k") == SECTION_KIND
    rows = parts.withColumns({"_from": F.max(F.when(section, F.col("s"))).over(so_far), "_to": F.max(F.when(section, F.col("e"))).over(so_far)})
    rows = rows.filter(F.col("k") < SECTION_KIND).withColumn("_from", F.when(F.col("s") < F.col("_to"), F.col("_from")))
    before = by.orderBy("s", "e", "k").rowsBetween(Window.unboundedPreceding, -1)
    after = by.orderBy(F.desc("s"), F.desc("e"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("doc_id", "tkey", "_from")
    sides = {}
    for name, kinds in {"id": IDS, "key": KEYS, "end": ENDS}.items():
        of = F.col("k").isin(kinds)
        sides[f"_{name}_before"], sides[f"_{name}_after"] = F.max(F.when(of, F.col("e"))).over(before), F.min(F.when(of, F.col("s"))).over(after)
        sides[f"_{name}_within"] = F.max(of & F.col("_from").isNotNull()).over(within)
    rows = rows.withColumns(sides)

    def near(n: str) -> Column:
        behind, ahead = F.col("s") - F.col(f"_{n}_before") <= REACH, F.col(f"_{n}_after") - F.col("e") <= REACH
        return F.coalesce(behind, F.lit(False)) | F.coalesce(ahead, F.lit(False)) | F.col(f"_{n}_within")

    k = F.col("k")
    rule = (
        F.when(k == KINDS.index("weak_id"), near("key"))
        .when(k == KINDS.index("weak_key"), near("id") | near("end"))
        .when(k == KINDS.index("weak_end"), near("key"))
        .otherwise(F.lit(False))
    )
    return rows.filter(rule).select("doc_id", "tkey", "s", "e", "k")


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, n_assign, n_access, n_hex, base_sha256, spans, cuts) for each row of docs; cuts are the starts and ends of all spans, tkey a hash of the text.

    Null texts count as empty. Texts of any length are scanned whole, parts read to their end, and time grows with their number. Repeated rows have the same findings, each its own; rows of one doc_id with different texts are told apart by tkey. Rows without doc_id are scanned too. Columns other than doc_id and text are ignored. An empty table gives no rows. Findings alone are shuffled, never texts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))
    # one projection makes the parts, the next reads them and looks for sections only where there are weak ones
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *(c.alias(f"_{k}") for c, (k, *_) in zip(_base(text), BASE)), _weak(text).alias("_weak"))
    rows = rows.select(
        "doc_id",
        F.xxhash64("text").alias("tkey"),
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k, *_ in BASE),
        F.transform(F.concat(*(f"_{k}" for k, *_ in BASE)), slim).alias("base"),
        F.transform("_weak", slim).alias("weak"),
        F.transform(F.when(F.size("_weak") > 0, _spans(F.col("text"), SECTION, SECTION_KIND)).otherwise(_none()), slim).alias("sections"),
    )
    rows = staged(rows)
    # rows of one doc_id and text have the same parts; they are taken once
    parts = rows.filter(F.size("weak") > 0).groupBy("doc_id", "tkey").agg(F.first(F.concat("base", "weak", "sections")).alias("parts"))
    parts = parts.select("doc_id", "tkey", F.explode("parts").alias("x")).select("doc_id", "tkey", "x.*")
    added = linked(parts).groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("s", "e", "k")).alias("added"))
    added = added.select(F.col("doc_id").alias("_doc"), F.col("tkey").alias("_key"), "added")
    rows = rows.join(added, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tkey") == F.col("_key")), "left")
    everything = F.concat("base", F.coalesce("added", F.array().cast("array<struct<s:int,e:int,k:int>>")))
    return rows.select(
        "doc_id",
        "tkey",
        *(f"n_{k}" for k, *_ in BASE),
        F.sha2(_digest(F.col("base")), 256).alias("base_sha256"),
        _digest(everything).alias("spans"),
        F.array_sort(F.transform(everything, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))).alias("cuts"),
    )


_STRETCH = 1024  # code points that are stepped through to find a place


def masked(text: Column, cuts: Column, mask: str) -> Column:
    """text with each of cuts (starts and ends, in order) masked; what overlaps is masked once. The text is taken in stretches, as a place in a long string is found by stepping through all before it."""
    stretches = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_STRETCH}}}"), F.lit(0))

    def cut_out(parts: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / _STRETCH).cast("int")
        some = F.slice(parts, first + 1, F.floor(b / _STRETCH).cast("int") - first + 1)
        return F.when(a < b, F.array_join(some, "").substr(a - first * _STRETCH + 1, b - a)).otherwise(F.lit(""))

    def put_together(parts: Column, ends: Column) -> Column:
        done = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(ends, F.greatest(i, F.lit(1))))
        pieces = F.transform(cuts, lambda x, i: F.when(x["s"] >= done(i), F.concat(cut_out(parts, done(i), x["s"]), F.lit(mask))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), cut_out(parts, F.element_at(ends, -1), F.length(text)))

    return _with(stretches, lambda p: _with(running(F.transform(cuts, lambda x: x["e"]), F.greatest), lambda e: put_together(p, e)))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every finding masked and n_chars counted anew; overlapping findings become one mask. Rows that no pattern matches pass through without a shuffle."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    any_part = reduce(lambda a, b: a | b, [_holds(text, k, p) for k, p, *_ in (*BASE, *WEAK)])
    some = docs.filter(any_part)
    cuts = found(some).filter(F.size("cuts") > 0).select(F.col("doc_id").alias("_doc"), F.col("tkey").alias("_key"), F.col("cuts").alias("_cuts")).dropDuplicates(["_doc", "_key"])
    rows = some.join(cuts, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_key")), "left")

    done = masked(text, F.col("_cuts"), mask)
    rows = rows.withColumn("text", F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(done))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return docs.filter(~any_part).unionByName(rows.select(*docs.columns))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


QUERIES = {"op10_secret_links": op10}


def _oracle() -> str:
    """The same in SQL: positions by running sums over the pieces between matches, co-occurrence by comparing all parts of a text."""

    def plain(pattern: str) -> str:
        """Without what the other engine's expressions lack; letters in either case as classes, as its own switch takes in letters beyond ASCII."""
        for names in (_ASSIGN, _IDS, _ENDS):
            pattern = pattern.replace(f"(?i:{names})", "(?:" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in names) + ")")
        return pattern.replace("(?md)", "(?m)").replace("))++", "))+").replace("'", "''")

    patterns = [*((p, least) for _, p, least in BASE), *((p, 0) for _, p in WEAK), (SECTION, 0)]
    spans = " UNION ALL ".join(f"SELECT r, {k} AS k, regexp_extract_all(t, '{plain(p)}') AS ms, string_split_regex(t, '{plain(p)}') AS ps FROM d" for k, (p, _) in enumerate(patterns))
    head, named = plain(ASSIGN_HEAD), "CASE k " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(KINDS)) + " END"
    kinds = lambda ks: "(" + ", ".join(map(str, ks)) + ")"
    near = lambda ks: f"EXISTS (SELECT 1 FROM x y WHERE y.r = x.r AND y.k IN {kinds(ks)} AND (y.s, y.e, y.k) <> (x.s, x.e, x.k) AND (CASE WHEN (y.s, y.e, y.k) < (x.s, x.e, x.k) THEN x.s - y.e ELSE y.s - x.e END <= {REACH} OR y.sec = x.sec))"
    base, weak_id, weak_key, weak_end = len(BASE), *(KINDS.index(f"weak_{n}") for n in ("id", "key", "end"))
    said = f"string_agg({named} || ':' || s || ':' || e, ',' ORDER BY s, k, e)"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({spans}), u AS (SELECT r, k, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM a WHERE len(ms) > 0),
l AS (SELECT r, k, ms[i] AS m, CAST(sum(length(ps[i]) + length(ms[i])) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS e FROM u),
p AS (SELECT r, k, e - length(m) AS s, e FROM l WHERE CASE k WHEN 0 THEN length(regexp_replace(m, '{head}', '')) >= {BASE[0][2]} WHEN 1 THEN length(m) >= {BASE[1][2]} WHEN 2 THEN length(m) >= {BASE[2][2]}
  WHEN {weak_key} THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') ELSE true END),
c AS (SELECT * FROM p WHERE k < {SECTION_KIND} AND (k < {base} OR NOT EXISTS (SELECT 1 FROM p q WHERE q.r = p.r AND q.k < {base} AND q.s < p.e AND p.s < q.e))),
x AS (SELECT c.r, c.k, c.s, c.e, g.s AS sec FROM c LEFT JOIN p g ON g.r = c.r AND g.k = {SECTION_KIND} AND g.s <= c.s AND c.s < g.e WHERE c.k <> {weak_key} OR NOT EXISTS (SELECT 1 FROM c q WHERE q.r = c.r AND q.k IN ({weak_id}, {weak_end}) AND q.s < c.e AND c.s < q.e)),
z AS (SELECT r, k, s, e FROM x WHERE k < {base} OR (k = {weak_id} AND {near(KEYS)}) OR (k = {weak_key} AND ({near(IDS)} OR {near(ENDS)})) OR (k = {weak_end} AND {near(KEYS)})),
b AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg({named} || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < {base}) AS bs, {said} AS spans FROM z GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN b ON b.r = d.r"""


ORACLES = {"op10_secret_links": _oracle()}
