"""Queries over the normaliser and the record files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, similarity, text, translit
from ..operators import normalize
from ..sources import tsv
from .views import view, view_sql, with_views

Q, O = {}, {}


def query(name: str, oracle: str | None = None):
    def add(function):
        Q[name] = function
        if oracle is not None:
            O[name] = oracle
        return function

    return add


KEYS = ["country", "src", "idx"]


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- DuckDB forms of the normaliser, written apart from the Spark ones --------------------------------------------

PLAIN = "trim(regexp_replace(strip_accents(lower({x})), '[\\p{{P}}\\p{{S}}\\s]+', ' ', 'g'))"


def sql_plain(x: str) -> str:
    return PLAIN.format(x=x)


def sql_clean(x: str, address: bool = False) -> str:
    """The cleaning, for Latin text; dotted initials of four letters down to two."""
    x = f"regexp_replace(replace(replace(replace(strip_accents(lower({x})), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss'), '[&+]', ' and ', 'g')"
    for n in (4, 3, 2):
        letters = "\\.".join(["([a-z])"] * n)
        groups = "".join(f"\\{i + 2}" for i in range(n))
        x = f"regexp_replace({x}, '(^|[^a-z0-9_.]){letters}(?:\\.|$)', '\\1{groups}', 'g')"
    x = f"regexp_replace({x}, '(^|[^\\p{{L}}\\p{{N}}])(l|d|qu)[''’]', '\\1\\2 ', 'g')"
    x = f"regexp_replace({x}, '[''’‘`´]', '', 'g')"
    if address:
        x = f"replace(regexp_replace({x}, '<null>|(^|[^\\p{{L}}])n/a([^\\p{{L}}]|$)', '\\1 \\2', 'g'), '#', '')"
        x = f"regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\s,]+', ' ', 'g'), '\\s*,\\s*', ',', 'g')"
    else:
        x = f"regexp_replace({x}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\s]+', ' ', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


TAGS = "regexp_replace(name_raw, '(?i)\\(?\\bid\\s*:?\\s*[0-9]+\\)?|#\\s*[0-9]+|\\+?(?:[0-9][ ().-]{0,2}){6,}[0-9]', ' ', 'g')"
UNLEET = "CASE WHEN length(t) >= 3 AND regexp_matches(t, '[0-9]') AND regexp_matches(t, '[a-z]') AND NOT regexp_matches(t, '^[0-9]+(st|nd|rd|th|[a-z])?$|^[a-z][0-9]+$') THEN translate(t, '0134578', 'oleastb') ELSE t END"
DROPPED = quoted(text._DROP)
MARKER_RE = "^(.*? |)(?:" + "|".join(sorted(rules.MARKERS, key=lambda m: -len(m.split()))) + ")( .*|)$"

#: toks: a token t with its phonetic key ph, step by step over distinct tokens
PHON = """p1 AS (SELECT t, replace(translate(replace(replace(replace(replace(replace(replace(replace(t, 'aa', 'a'), 'ee', 'i'), 'ii', 'i'), 'oo', 'u'), 'uu', 'u'), 'ph', 'f'), 'ck', 'k'), 'wzq', 'vjk'), 'x', 'ks') AS x FROM toks),
p2 AS (SELECT t, regexp_replace(x, '([bcdfgjklmnpqrstvxyz])h', '\\1', 'g') AS x FROM p1),
p3 AS (SELECT t, substr(x, 1, 1) || regexp_replace(substr(x, 2), '[aeiou]', '', 'g') AS x FROM p2),
p4 AS (SELECT t, x, array_to_string([substr(x, i, 1) for i in range(1, length(x) + 1) if i = 1 OR substr(x, i, 1) <> substr(x, i - 1, 1)], '') AS y FROM p3),
phons AS (SELECT t, CASE WHEN y = '' THEN t ELSE y END AS ph FROM p4)"""


@query(
    "tn01_plain_names",
    with_views(
        f"""n AS (SELECT src, idx, name_raw, {sql_plain('name_raw')} AS plain_name, {sql_plain('addr_raw')} AS a FROM raw)
SELECT src, idx, plain_name, array_to_string([t for t in string_split(plain_name, ' ') if t NOT IN ({quoted(rules.PLAIN_LEGAL)}) AND t <> ''], ' ') AS stripped,
nullif(regexp_extract(regexp_replace(a, '(^|[^0-9])([0-9]{{3}}) ([0-9]{{3}})([^0-9]|$)', '\\1\\2\\3\\4', 'g'), '^.*(?:^|[^0-9])([0-9]{{5,6}})(?:[^0-9]|$)', 1), '') AS postal,
nullif(regexp_extract(a, '(?:^|[^0-9])([0-9]{{1,4}})(?:[^0-9]|$)', 1), '') AS house,
regexp_matches(a, '(?:^| )(?:near|nr|opp|opposite|behind|beside|next to|adjacent|in front of|above)(?: |$)') AS landmark,
regexp_matches(lower(name_raw), '{rules.TRADE_MARKER}') AS trade_marker FROM n""",
        "raw",
    ),
)
def plain_names(spark, sf) -> DataFrame:
    """TN1 to TN5: plain form, legal words off, postal code, house number, landmark and trade-name flags."""
    name, addr = text.plain(F.col("name_raw")), text.plain(F.col("addr_raw"))
    rows = view(spark, sf, "raw").withColumns({"plain_name": name, "a": addr})
    return rows.select(
        "src", "idx", "plain_name", text.strip_legal(F.col("plain_name")).alias("stripped"), text.postal_like(F.col("a")).alias("postal"), text.house_number(F.col("a")).alias("house"),
        text.has_landmark(F.col("a")).alias("landmark"), text.has_trade_marker(F.col("name_raw")).alias("trade_marker"),
    )


@query(
    "tn06_clean_text",
    with_views(f"SELECT src, idx, {sql_clean('name_raw')} AS name_clean, {sql_clean('addr_raw', True)} AS addr_clean, regexp_matches(name_raw, '[\\x{{0900}}-\\x{{0D7F}}]') AS name_has_indic, regexp_matches(name_raw, '(?i)www\\.|https?://|@|\\.(?:com|net|org|in|co|fr|io|biz|info|us)\\b') AS name_is_web FROM raw", "raw"),
)
def clean_text(spark, sf) -> DataFrame:
    """TN6 to TN9 and TN19: cleaned names and addresses, dotted initials, script and web flags."""
    return view(spark, sf, "raw").select("src", "idx", text.clean(F.col("name_raw")).alias("name_clean"), text.clean(F.col("addr_raw"), True).alias("addr_clean"), text.has_indic(F.col("name_raw")).alias("name_has_indic"), text.is_web(F.col("name_raw")).alias("name_is_web"))


@query(
    "tn17_phonetic_keys",
    with_views(f"toks AS (SELECT DISTINCT unnest(string_split({sql_clean('name_raw')}, ' ')) AS t FROM raw), {PHON} SELECT t AS tok, ph, {UNLEET} AS unleet FROM phons WHERE t <> ''", "raw"),
)
def phonetic_keys(spark, sf) -> DataFrame:
    """TN11 and TN17 on every distinct token."""
    toks = view(spark, sf, "raw").select(F.explode(text.tokens(text.clean(F.col("name_raw")))).alias("tok")).distinct()
    return toks.select("tok", text.phon(F.col("tok")).alias("ph"), text.unleet(F.col("tok")).alias("unleet"))


@query("tn20_unicode_forms")
def unicode_forms(spark, sf) -> DataFrame:
    """TN20 and TN24: normal forms over Arrow, and the scripts of each name."""
    rows = view(spark, sf, "raw")
    return rows.select("src", "idx", text.unicode_form("NFKD")(F.col("name_raw")).alias("nfkd"), text.unicode_form("NFKC")(F.col("name_raw")).alias("nfkc"), text.scripts(F.col("name_raw")).alias("scripts"))


NAME_SQL = with_views(
    f"""n0 AS (SELECT country, src, idx, name_raw, {sql_clean('name_raw')} AS name_clean, [{UNLEET} for t in string_split({sql_clean(TAGS)}, ' ') if t <> ''] AS ts FROM raw),
n1 AS (SELECT *, array_to_string(ts, ' ') AS s FROM n0),
n2 AS (SELECT *, regexp_matches(s, '{MARKER_RE}') AS mk, trim(regexp_extract(s, '{MARKER_RE}', 1)) AS b, trim(regexp_extract(s, '{MARKER_RE}', 2)) AS a FROM n1),
n3 AS (SELECT *, CASE WHEN mk THEN trim(b || ' ' || a) ELSE s END AS main, CASE WHEN mk THEN a ELSE '' END AS after FROM n2),
n4 AS (SELECT *, [t for t in string_split(regexp_replace(main, '(^| )m s( |$)', '\\1\\2', 'g'), ' ') if t <> '' AND t NOT IN ({DROPPED}) AND NOT regexp_matches(t, '^[0-9]{{7,}}$')] AS k,
 [t for t in string_split(regexp_replace(after, '(^| )m s( |$)', '\\1\\2', 'g'), ' ') if t <> '' AND t NOT IN ({DROPPED}) AND NOT regexp_matches(t, '^[0-9]{{7,}}$')] AS ka,
 [t for t in string_split(main, ' ') if t <> '' AND t NOT IN ({quoted(rules.HONORIFICS)})] AS kh FROM n3),
n5 AS (SELECT *, [k[i] for i in range(1, len(k) + 1) if i = 1 OR k[i] <> k[i - 1]] AS c, [ka[i] for i in range(1, len(ka) + 1) if i = 1 OR ka[i] <> ka[i - 1]] AS ca FROM n4),
n6 AS (SELECT *, CASE WHEN len(c) > 0 THEN c WHEN len(kh) > 0 THEN kh ELSE [t for t in string_split(main, ' ') if t <> ''] END AS core FROM n5),
toks AS (SELECT DISTINCT unnest(core) AS t FROM n6), {PHON},
ps AS (SELECT src, idx, string_agg(ph, ' ' ORDER BY i) AS name_phon FROM (SELECT src, idx, unnest(core) AS t, generate_subscripts(core, 1) AS i FROM n6) u JOIN phons USING (t) GROUP BY src, idx)
SELECT n6.country, n6.src, n6.idx, name_clean, array_to_string(core, ' ') AS name_core, array_to_string(ca, ' ') AS name_alt, array_to_string(core, '') AS name_concat, coalesce(name_phon, '') AS name_phon, mk AS name_has_marker
FROM n6 LEFT JOIN ps ON ps.src = n6.src AND ps.idx = n6.idx""",
    "raw",
)


@query("tn16_name_fields", NAME_SQL)
def name_fields(spark, sf) -> DataFrame:
    """TN10 to TN13, TN16 and TN17: the fields of a name, without segmentation."""
    return normalize.name_fields(view(spark, sf, "raw")).select(*KEYS, "name_clean", "name_core", "name_alt", "name_concat", "name_phon", "name_has_marker")


@query("tn15_segmented_names")
def segmented_names(spark, sf) -> DataFrame:
    """TN14 and TN15: glued tokens cut by the first source's vocabulary."""
    return normalize.records(view(spark, sf, "raw")).select(*KEYS, "name_core", "name_alt", "name_phon")


@query(
    "tn22_vocabulary",
    with_views(f"SELECT country, t AS tok, count(*) AS n FROM (SELECT country, unnest(string_split({sql_clean('name_raw')}, ' ')) AS t FROM raw WHERE src = 1) x WHERE t <> '' GROUP BY country, t", "raw"),
)
def vocabulary(spark, sf) -> DataFrame:
    """TN22: token counts of cleaned first-source names."""
    return normalize.vocabulary(view(spark, sf, "raw").withColumn("name_clean", text.clean(F.col("name_raw"))))


def _table(values: dict[str, dict[str, str]]) -> str:
    rows = [(c, k, v) for c in rules.COUNTRIES for k, v in values[c].items()]
    return "(VALUES " + ", ".join(f"('{c}', '{k}', '{v}')" for c, k, v in rows) + ")"


ADDRESS_SQL = with_views(
    f"""st(c, k, v) AS (SELECT * FROM {_table(rules.STATES)}), ab(c, k, v) AS (SELECT * FROM {_table(rules.ABBREVIATIONS)}),
c0 AS (SELECT country, src, idx, string_split({sql_clean('addr_raw', True)}, ',') AS cs FROM raw),
c1 AS (SELECT country, src, idx, [array_to_string([t for t in string_split(c, ' ') if t <> 'null' AND t <> ''], ' ') for c in cs] AS cs FROM c0),
c2 AS (SELECT country, src, idx, [c for c in cs if c <> '' AND c NOT IN ({quoted(rules.PLACEHOLDERS)})] AS cs FROM c1),
lst AS (SELECT src, idx, max(i) AS i, arg_max(v, i) AS state FROM (SELECT country, src, idx, unnest(cs) AS comp, generate_subscripts(cs, 1) AS i FROM c2) u JOIN st ON st.c = u.country AND st.k = u.comp GROUP BY src, idx),
c3 AS (SELECT c2.country, c2.src, c2.idx, array_to_string(cs, ' ') AS addr_clean, coalesce(state, '') AS state, array_to_string([cs[j] for j in range(1, len(cs) + 1) if lst.i IS NULL OR j <> lst.i], ' ') AS rawt FROM c2 LEFT JOIN lst ON lst.src = c2.src AND lst.idx = c2.idx),
c4 AS (SELECT *, [t for t in string_split(CASE WHEN country = 'India' THEN trim(regexp_replace(' ' || rawt || ' ', ' h no ', ' house@no ', 'g')) ELSE rawt END, ' ') if t <> ''] AS ts FROM c3),
ex AS (SELECT src, idx, string_agg(coalesce(ab.v, replace(t, '@', ' ')), ' ' ORDER BY i) AS addr_core FROM (SELECT country, src, idx, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM c4) u LEFT JOIN ab ON ab.c = u.country AND ab.k = u.t GROUP BY src, idx),
c5 AS (SELECT c4.*, coalesce(addr_core, '') AS addr_core FROM c4 LEFT JOIN ex ON ex.src = c4.src AND ex.idx = c4.idx),
c6 AS (SELECT *, [regexp_replace(d, '^0+([0-9])', '\\1') for d in regexp_extract_all(addr_core, '[0-9]+')] AS ns FROM c5)
SELECT country, src, idx, addr_clean, addr_core, state, array_to_string(ns, ' ') AS addr_nums, CASE WHEN len(ns) > 0 THEN ns[1] END AS house_num, addr_clean = '' AS addr_empty,
regexp_matches(' ' || rawt || ' ' || addr_core || ' ', ' (?:{"|".join(rules.LANDMARK_WORDS)}) ') OR regexp_matches(' ' || addr_core || ' ', ' (?:{"|".join(rules.LANDMARK_PHRASES)}) ') AS addr_has_landmark,
regexp_matches(' ' || rawt || ' ', ' (?:{"|".join(rules.POBOX_PHRASES)}) ') AS addr_has_pobox FROM c6""",
    "raw",
)


@query("tn18_address_fields", ADDRESS_SQL)
def address_fields(spark, sf) -> DataFrame:
    """TN7 and TN18: the fields of an address."""
    cols = ["addr_clean", "addr_core", "state", "addr_nums", "house_num", "addr_empty", "addr_has_landmark", "addr_has_pobox"]
    return normalize.address_fields(view(spark, sf, "raw")).select(*KEYS, *cols)


@query(
    "tn21_prepared_text",
    with_views("SELECT src, idx, array_to_string([t for t in string_split(regexp_replace(name_core, '\\b0+([0-9])', '\\1', 'g'), ' ') if t <> 'cie' AND t <> ''], ' ') AS pname, regexp_replace(addr_core, '\\b0+([0-9])', '\\1', 'g') AS paddr FROM rec", "rec"),
)
def prepared_text(spark, sf) -> DataFrame:
    """TN21."""
    return view(spark, sf, "rec").select("src", "idx", text.prepared_name(F.col("name_core")).alias("pname"), text.prepared_address(F.col("addr_core")).alias("paddr"))


@query("tr01_romanized_names")
def romanized_names(spark, sf) -> DataFrame:
    """TR1 to TR5 on names written in Devanagari letters."""
    deva = F.translate(F.lower("name_raw"), "abcdefghijklmnoprstuvwy", "अबचदएफगहइजकलमनओपरसतउववय")
    return view(spark, sf, "raw").select("src", "idx", deva.alias("native"), translit.romanized(deva, {"रेद": "red"}).alias("latin"))


# --- files ----------------------------------------------------------------------------------------------------------

LIST_SQL = "SELECT l.idx, l.s1_id, coalesce(string_agg(DISTINCT t.rec_id, ',' ORDER BY t.rec_id), '') AS ids FROM lists l LEFT JOIN {t} t ON t.s1_id = l.s1_id GROUP BY l.idx, l.s1_id"


@query("sk03_id_lists", with_views(LIST_SQL.format(t="true_ids"), "lists", "true_ids"))
def id_lists(spark, sf) -> DataFrame:
    """SK3: every first-source record with its sorted ids."""
    return tsv.id_lists(view(spark, sf, "lists"), view(spark, sf, "true_ids"))


@query("sk07_empty_lists", with_views("SELECT idx, s1_id, '' AS ids FROM lists", "lists"))
def empty_lists(spark, sf) -> DataFrame:
    """SK7: the all-empty baseline."""
    return view(spark, sf, "lists").select("idx", "s1_id", F.lit("").alias("ids"))


@query("sc05_parsed_ids", with_views("a AS (SELECT s1_id, ' ' || string_agg(rec_id, ' , ' ORDER BY rec_id) || ',,' AS v FROM pred_ids GROUP BY s1_id) SELECT s1_id, len(list_distinct([trim(x) for x in string_split(v, ',') if trim(x) <> ''])) AS n FROM a", "pred_ids"))
def parsed_ids(spark, sf) -> DataFrame:
    """SC4, SC5 and RP4: lists parsed with their blanks."""
    lists = view(spark, sf, "pred_ids").groupBy("s1_id").agg(F.concat(F.lit(" "), F.array_join(F.array_sort(F.collect_list("rec_id")), " , "), F.lit(",,")).alias("v"))
    return lists.select("s1_id", F.size(tsv.parse_ids(F.col("v"))).cast("long").alias("n"))


@query("sc04_ground_truth", with_views("SELECT s1_id, array_to_string(list_sort(list_distinct(list(rec_id))), ',') AS ids FROM true_ids GROUP BY s1_id", "true_ids"))
def ground_truth(spark, sf) -> DataFrame:
    """SC4: repeated rows of a first-source record united."""
    rows = view(spark, sf, "true_ids").select(F.col("s1_id").alias(tsv.TRUTH[0]), F.col("rec_id").alias(tsv.TRUTH[1]))
    return tsv.ground_truth(rows).select("s1_id", F.array_join("ids", ",").alias("ids"))


@query("sc06_truth_pairs", f"SELECT s1, src, idx, country FROM ({view_sql('truth')}) t")
def truth_pairs(spark, sf) -> DataFrame:
    """SC6: truth by ids resolved to record keys."""
    rec = view(spark, sf, "rec").select("entity_id", "src", "idx", "country")
    named = view(spark, sf, "truth").join(rec.filter("src = 1").select(F.col("idx").alias("s1"), F.col("entity_id").alias("s1_id")), "s1").join(rec.select("src", "idx", F.col("entity_id").alias("rec_id")), ["src", "idx"])
    return tsv.truth_pairs(named.groupBy("s1_id").agg(F.collect_list("rec_id").alias("ids")), rec)


@query("sc07_filtered_records", "SELECT p_partkey, p_name FROM part WHERE p_type = 'SMALL' AND p_size > 10")
def filtered_records(spark, sf) -> DataFrame:
    """SC7: columns and filters that reach the scan."""
    return spark.read.parquet(f"{sf}/part.parquet").filter("p_type = 'SMALL' and p_size > 10").select("p_partkey", "p_name")


@query(
    "sc11_file_scan",
    with_views(
        "SELECT count(*) AS n_lines, count(*) FILTER (trim(v) = '') AS n_blank, count(*) FILTER (contains(v, chr(13))) AS n_cr, count(*) FILTER (starts_with(v, chr(65279))) AS n_bom, count(*) FILTER (length(v) - length(replace(v, chr(9), '')) <> 3) AS n_bad_tabs, count(*) FILTER (contains(v, '\"')) AS n_quotes FROM (SELECT CASE WHEN idx % 97 = 0 THEN ' ' WHEN idx % 89 = 0 THEN name_raw ELSE entity_id || chr(9) || name_raw || chr(9) || addr_raw || chr(9) || country END AS v FROM raw) x",
        "raw",
    ),
)
def file_scan(spark, sf) -> DataFrame:
    """SC11: anomalies of raw lines."""
    line = F.when(F.col("idx") % 97 == 0, " ").when(F.col("idx") % 89 == 0, F.col("name_raw")).otherwise(F.concat_ws("\t", "entity_id", "name_raw", "addr_raw", "country"))
    return tsv.file_scan(view(spark, sf, "raw").select(line.alias("value")))


# --- similarities ---------------------------------------------------------------------------------------------------

NAMES = "SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM {part} a JOIN {part} b ON a.p_type = b.p_type AND a.p_brand = b.p_brand WHERE a.p_partkey < b.p_partkey"


def _name_pairs(spark, sf) -> DataFrame:
    return spark.sql(NAMES.format(part=f"parquet.`{sf}/part.parquet`"))


def _distinct_name_pairs(spark, sf) -> DataFrame:
    """The same pairs without joining all parts: of a type and brand two names are a pair if the least key of one is below the largest key of the other, so each name stands once."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    names = part.groupBy("p_type", "p_brand", "p_name").agg(F.min("p_partkey").alias("low"), F.max("p_partkey").alias("high"))
    a = names.select("p_type", "p_brand", F.col("p_name").alias("a"), "low")
    b = names.select("p_type", "p_brand", F.col("p_name").alias("b"), "high")
    return a.join(b, ["p_type", "p_brand"]).filter("low < high").select("a", "b").distinct()


@query("sim05_jaro_winkler", f"SELECT a, b, round(jaro_winkler_similarity(a, b), 4) AS jw FROM ({NAMES.format(part='part')}) n")
def jaro_winkler(spark, sf) -> DataFrame:
    """SIM5."""
    return _distinct_name_pairs(spark, sf).select("a", "b", F.round(similarity.jaro_winkler(F.col("a"), F.col("b")).cast("double"), 4).alias("jw"))


#: us: pairs of texts (u, v), to lc: the same with n, the length of their longest common subsequence, a row of the table for each letter of v
LCS = """uc AS (SELECT u, v, [unicode(z) for z in string_split(u, '')] AS x, [unicode(z) for z in string_split(v, '')] AS y FROM (SELECT DISTINCT u, v FROM us WHERE u <> '' AND v <> '') d),
lc AS (SELECT u, v, list_reduce(list_concat([[0 for z in x]], [[z] for z in y]), lambda acc, c: [greatest(acc[j], coalesce(list_max([CASE WHEN x[i] = c[1] THEN coalesce(acc[i - 1], 0) + 1 ELSE 0 END for i in range(1, j + 1)]), 0)) for j in range(1, len(acc) + 1)])[-1] AS n FROM uc)"""
RATIO = "CASE WHEN {u} = {v} THEN 100 WHEN {u} = '' OR {v} = '' THEN 0 ELSE 200.0 * {n} / (length({u}) + length({v})) END"


#: tp: pairs of texts (a, b), to ts: the same with ratio, tsort and tset
SIMS = f"""zw AS (SELECT a, b, list_sort(list_distinct(string_split(a, ' '))) AS x, list_sort(list_distinct(string_split(b, ' '))) AS y, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb FROM (SELECT DISTINCT a, b FROM tp) d),
zs AS (SELECT a, b, sa, sb, array_to_string([t for t in x if list_contains(y, t)], ' ') AS z, array_to_string([t for t in x if NOT list_contains(y, t)], ' ') AS l, array_to_string([t for t in y if NOT list_contains(x, t)], ' ') AS r FROM zw),
zf AS (SELECT *, trim(z || ' ' || l) AS ab, trim(z || ' ' || r) AS ba FROM zs), us AS (SELECT a AS u, b AS v FROM zf UNION ALL SELECT sa, sb FROM zf UNION ALL SELECT ab, ba FROM zf), {LCS},
ts AS (SELECT zf.a, zf.b, round({RATIO.format(u='zf.a', v='zf.b', n='l1.n')}, 3) AS ratio, round({RATIO.format(u='sa', v='sb', n='l2.n')}, 3) AS tsort,
round(CASE WHEN l = '' OR r = '' THEN CASE WHEN z <> '' THEN 100 ELSE 0 END ELSE greatest(200.0 * l3.n / (length(ab) + length(ba)), CASE WHEN z <> '' THEN greatest(200.0 * length(z) / (length(z) + length(ab)), 200.0 * length(z) / (length(z) + length(ba))) ELSE 0 END) END, 3) AS tset
FROM zf LEFT JOIN lc l1 ON l1.u = zf.a AND l1.v = zf.b LEFT JOIN lc l2 ON l2.u = sa AND l2.v = sb LEFT JOIN lc l3 ON l3.u = ab AND l3.v = ba)"""


@query("sim01_ratios", f"WITH tp AS ({NAMES.format(part='part')}), {SIMS} SELECT a, b, ratio, tsort, tset FROM ts")
def ratios(spark, sf) -> DataFrame:
    """SIM1 to SIM3."""
    a, b = F.col("a"), F.col("b")
    found = {"ratio": similarity.ratio(a, b), "tsort": similarity.token_sort_ratio(a, b), "tset": similarity.token_set_ratio(a, b)}
    return _distinct_name_pairs(spark, sf).select("a", "b", *(F.round(c.cast("double"), 3).alias(n) for n, c in found.items()))


@query("sim04_partial_ratio")
def partial_ratio(spark, sf) -> DataFrame:
    """SIM4: rows only; held against all windows in the tests."""
    return _distinct_name_pairs(spark, sf).select("a", "b", similarity.partial_ratio(F.col("a"), F.col("b")).alias("partial"))


@query("sim06_best_match", f"WITH us AS (SELECT a AS u, b AS v FROM ({NAMES.format(part='part')}) n), {LCS}, r AS (SELECT u, v, {RATIO.format(u='u', v='v', n='n')} AS r FROM lc) SELECT u AS a, arg_max(v, (round(r, 4), v)) AS best FROM r WHERE r >= 50 GROUP BY u")
def best_match(spark, sf) -> DataFrame:
    """SIM6: the most similar name at a ratio of 50 or more."""
    rows = _distinct_name_pairs(spark, sf).withColumn("r", similarity.ratio(F.col("a"), F.col("b")))
    # no filter on r ahead of the grouping: it would be moved below the distinct, and compare every pair that the join gives
    return rows.groupBy("a").agg(F.max_by("b", F.when(F.col("r") >= 50, F.struct("r", "b"))).alias("best")).filter("best is not null")
