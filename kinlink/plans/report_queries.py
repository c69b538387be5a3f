"""Queries over whole searches and reports: all configurations, link rules, link tokens, seeded samples, second-stage learning, and cleaning of scripts beyond Latin."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import audit, decide, learning, metrics, translit_learn
from .blocking_queries import F05
from .pair_queries import DECIDED, LEARNED, NATIVE, ODDS, PAIR, PRANKS, SIZES, _decided, _pairs, _rounded, _scored, _sizes
from .pair_queries import PAIR_SQL as KEY
from .text_queries import query, sql_clean
from .views import view, with_views

# --- decisions ------------------------------------------------------------------------------------------------------

PMF = "list_reduce(list_concat([[CAST(1 AS DOUBLE)]], [[z] for z in {x}]), lambda acc, y: [coalesce(acc[k], 0) * (1 - y[1]) + CASE WHEN k > 1 THEN acc[k - 1] * y[1] ELSE 0 END for k in range(1, len(acc) + 2)])"


def best_counts(lists: str) -> str:
    """SQL (.., j): of lists (.., qs), q in descending order, the smallest number to accept of the largest expected score, by the two counts' distributions."""
    hits, rest = PMF.format(x="qs[1:j]"), PMF.format(x="qs[j + 1:]")
    return f"""SELECT * EXCLUDE (qs, e, top) FROM (SELECT *, row_number() OVER (PARTITION BY * EXCLUDE (qs, j, e) ORDER BY e DESC, j) AS top FROM (
SELECT * EXCLUDE (hits, rest), round(CASE WHEN j = 0 THEN rest[1] ELSE list_sum([list_sum([hits[a + 1] * rest[b + 1] * 1.25 * a / (j + 0.25 * (a + b)) for b in range(0, len(rest))]) for a in range(0, len(hits))]) END, 12) AS e FROM (
SELECT *, {hits} AS hits, {rest} AS rest FROM (SELECT *, unnest(range(0, len(qs) + 1)) AS j FROM ({lists}) l0) l1) l2) l3) l4 WHERE top = 1"""


def _partitioned(sql: str, keys: str) -> str:
    return sql.replace("PARTITION BY * EXCLUDE (qs, j, e)", f"PARTITION BY {keys}")


SEEN = "(SELECT country, s1, list(pow(q, {g}) ORDER BY rn) AS qs{more} FROM {r} WHERE rn <= 15 AND q >= 0.01 GROUP BY country, s1{by})"


@query(
    "dc08_expected_choice",
    with_views(
        f"{ODDS}, r AS (SELECT *, row_number() OVER (PARTITION BY country, s1 ORDER BY q DESC, src, idx) AS rn FROM q), c AS ({_partitioned(best_counts(SEEN.format(g="CASE WHEN country = 'F' THEN 1.5 ELSE 1 END", r='r', more='', by='')), 'country, s1')}) SELECT r.country, r.s1, r.src, r.idx, round(q, 8) AS q, coalesce(rn <= j AND rn <= 15 AND q >= 0.01, false) AS accepted FROM r LEFT JOIN c ON c.country = r.country AND c.s1 = r.s1",
        "pairs",
    ),
)
def expected_choice(spark, sf) -> DataFrame:
    """DC7, DC8 and DC10: the optimiser's matches, gamma by country."""
    return decide.expected_choice(decide.odds(_pairs(spark, sf)), decide.country_gamma(1.0, {"F": 1.5})).select(*PAIR, F.round("q", 8).alias("q"), "accepted")


_ONE = ", ".join(f"('one {t:.2f}', {t})" for t in decide.THRESHOLDS)
_TWO = ", ".join(f"('two {a:.2f} {b:.2f}', {a}, {b})" for a, b in product(decide.TWO, decide.TWO))
_GAMMA = ", ".join(f"('expected {g:.2f}', {g})" for g in decide.GAMMAS)
CONFIGURATIONS = f"""{SIZES}, {ODDS},
homes AS (SELECT 'none' AS home, country, s1, src, idx, label, p AS q FROM pairs UNION ALL SELECT 'odds', country, s1, src, idx, label, q FROM q UNION ALL SELECT 'argmax', country, s1, src, idx, label, CASE WHEN row_number() OVER (PARTITION BY country, src, idx ORDER BY p DESC, s1) = 1 THEN p ELSE 0 END FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY home, country, s1 ORDER BY q DESC, src, idx) AS rn, max(q) OVER (PARTITION BY home, country, s1) AS bq FROM homes),
g1(name, t) AS (VALUES {_ONE}), g2(name, a, b) AS (VALUES {_TWO}), g3(name, g) AS (VALUES {_GAMMA}),
l AS (SELECT home, country, s1, name, list(pow(q, g) ORDER BY rn) AS qs FROM r CROSS JOIN g3 WHERE rn <= 15 AND q >= 0.01 GROUP BY home, country, s1, name),
c AS ({_partitioned(best_counts('SELECT * FROM l'), 'home, country, s1, name')}),
h AS (SELECT home, name, country, s1, count(*) AS n, sum(label) AS tp FROM r JOIN g1 ON q >= t GROUP BY ALL
UNION ALL SELECT home, name, country, s1, count(*), sum(label) FROM r JOIN g2 ON bq >= a AND (rn = 1 OR q >= b) GROUP BY ALL
UNION ALL SELECT r.home, c.name, r.country, r.s1, count(*), sum(label) FROM r JOIN c ON c.home = r.home AND c.country = r.country AND c.s1 = r.s1 AND rn <= j AND rn <= 15 AND q >= 0.01 GROUP BY ALL),
names AS (SELECT home, name FROM (SELECT name FROM g1 UNION ALL SELECT name FROM g2 UNION ALL SELECT name FROM g3) a CROSS JOIN (VALUES ('none'), ('odds'), ('argmax')) b(home)),
scores AS (SELECT names.home, names.name, round(avg({F05.format(p='coalesce(n, 0)', t='t', tp='tp')}), 8) AS score FROM sizes CROSS JOIN names LEFT JOIN h ON h.home = names.home AND h.name = names.name AND h.country = sizes.country AND h.s1 = sizes.s1 GROUP BY names.home, names.name)"""
SIZED = ("pairs", "ones", "pair_truth")


def _all_scores(spark, sf, whole: bool = False) -> DataFrame:
    return _rounded(decide.configuration_scores(_pairs(spark, sf), _sizes(spark, sf), whole=whole), "score", to=8)


#: the optimiser sees all candidates, not the 15 best of 0.01
WHOLE = CONFIGURATIONS.replace("WHERE rn <= 15 AND q >= 0.01 GROUP", "WHERE q > 0 GROUP").replace("AND rn <= j AND rn <= 15 AND q >= 0.01 GROUP", "AND rn <= j GROUP")


@query("dc09_all_configurations", with_views(f"{WHOLE} SELECT home, name, score FROM scores", *SIZED))
def all_configurations(spark, sf) -> DataFrame:
    """DC9 and MT3: the macro scores of all 297 configurations, the optimiser seeing all candidates of a record."""
    return _all_scores(spark, sf, whole=True)


@query("rp05_best_configuration", with_views(f"{CONFIGURATIONS} SELECT home, family, name, score FROM (SELECT *, split_part(name, ' ', 1) AS family, row_number() OVER (PARTITION BY home, split_part(name, ' ', 1) ORDER BY score DESC, name) AS rn FROM scores) x WHERE rn = 1", *SIZED))
def best_configuration(spark, sf) -> DataFrame:
    """RP5: the best configuration of each ownership and family of rules."""
    return metrics.best_per_group(_all_scores(spark, sf).withColumn("family", F.split("name", " ")[0]), ["home", "family"])


VARIANTS = [("04_s1_g15", 0.9727, 2), ("03", 0.9773, 5), ("05_slim", 0.9770, 1), ("D2_filter", 0.9790, 1), ("02", 0.9769, 1)]


@query("dc15_chosen_variant", f"SELECT name FROM (VALUES {', '.join(map(str, VARIANTS))}) v(name, score, complexity) WHERE NOT starts_with(name, 'D2') AND score >= (SELECT max(score) FROM (VALUES {', '.join(map(str, VARIANTS))}) w(name, score, complexity) WHERE NOT starts_with(name, 'D2')) - 0.0005 ORDER BY complexity, score DESC, name LIMIT 1")
def chosen_variant(spark, sf) -> DataFrame:
    """DC15: within the tolerance of the best that may be taken the simplest, then the best; banned variants are out of the race."""
    return spark.createDataFrame([(metrics.choose_variant(VARIANTS, 0.0005, ("D2",)),)], "name string")


RAW_KEYS = "'R' || CAST(idx % 23 AS STRING) AS name_raw, CASE WHEN idx % 3 = 0 THEN '' ELSE 'A' || CAST(idx % 29 AS STRING) END AS addr_raw, name AS name_core, addr AS addr_core"


def _rule_sql(rule: str) -> str:
    parts, empty = decide.LINK_RULES[rule]
    good = " AND ".join([f"{c} <> ''" for c in parts] + [f"{c} = ''" for c in empty])
    return f"CASE WHEN {good} THEN {" || '|' || ".join(parts)} END"


@query(
    "dc14_all_link_rules",
    with_views(
        f"x AS (SELECT {KEY}, {RAW_KEYS} FROM pairs WHERE s1 % 4 = 1), k AS ({' UNION ALL '.join(f"SELECT country, s1, src, idx, '{r}|' || ({_rule_sql(r)}) AS key FROM x" for r in decide.LINK_RULES)}), e AS (SELECT DISTINCT a.country, a.s1, a.src, a.idx AS u, b.idx AS v FROM k a JOIN k b ON a.country = b.country AND a.s1 = b.s1 AND a.src = b.src AND a.key = b.key), "
        "t AS (SELECT country, s1, src, idx AS u, idx AS v FROM x UNION SELECT t.country, t.s1, t.src, t.u, e.v FROM t JOIN e ON e.country = t.country AND e.s1 = t.s1 AND e.src = t.src AND e.u = t.v) SELECT country, s1, src, u AS idx, min(v) AS component FROM t GROUP BY country, s1, src, u",
        "pairs",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def all_link_rules(spark, sf) -> DataFrame:
    """DC13 and DC14 over all four rules, for a quarter of the first-source records, as a matcher would ask for those it is in doubt of."""
    rows = _pairs(spark, sf).filter("s1 % 4 = 1").selectExpr(*PAIR, "'R' || CAST(idx % 23 AS STRING) AS name_raw", "CASE WHEN idx % 3 = 0 THEN '' ELSE 'A' || CAST(idx % 29 AS STRING) END AS addr_raw", "name AS name_core", "addr AS addr_core")
    return decide.link_components(decide.link_keys(rows)).select(*PAIR, "component")


# --- audits ---------------------------------------------------------------------------------------------------------

TAGGED = """SELECT src, idx, country, CASE WHEN idx % 11 = 0 THEN CAST(-idx - 1 AS BIGINT) ELSE CAST(idx % 50 AS BIGINT) END AS entity, name_raw || CASE idx % 8 WHEN 0 THEN ' (ID: ' || CAST(idx % 40 AS STRING) || ')' WHEN 1 THEN ' #Tag' || CAST(idx % 30 AS STRING) WHEN 2 THEN ' @user.' || CAST(idx % 25 AS STRING)
WHEN 3 THEN ' +1 (555) 010-' || CAST(1000 + idx % 60 AS STRING) WHEN 4 THEN ' Shop' || CAST(idx % 20 AS STRING) || '.COM' ELSE '' END AS name_raw, CASE WHEN idx % 9 = 0 THEN '555 010 ' || CAST(1000 + idx % 60 AS STRING) ELSE addr_raw END AS addr_raw, name_core, addr_core
FROM (SELECT raw.src, raw.idx, raw.country, raw.name_raw, raw.addr_raw, rec.name_core, rec.addr_core FROM raw JOIN rec ON rec.src = raw.src AND rec.idx = raw.idx) j"""


def _tagged(spark, sf) -> DataFrame:
    rows = view(spark, sf, "raw").join(view(spark, sf, "rec").select("src", "idx", "name_core", "addr_core"), ["src", "idx"])
    return rows.selectExpr("src", "idx", "country", *_TAGGED_COLUMNS)


_TAGGED_COLUMNS = [
    "CASE WHEN idx % 11 = 0 THEN CAST(-idx - 1 AS BIGINT) ELSE CAST(idx % 50 AS BIGINT) END AS entity",
    TAGGED[TAGGED.index("name_raw || CASE") : TAGGED.index(" AS name_raw, CASE")] + " AS name_raw",
    TAGGED[TAGGED.index("CASE WHEN idx % 9") : TAGGED.index(" AS addr_raw, name_core")] + " AS addr_raw",
    "name_core",
    "addr_core",
]


def _token_sql(kind: str) -> str:
    pattern, group = rules.LINK_TOKENS[kind]
    pattern = pattern.replace("'", "''")
    if kind == "phone":
        return f"[t for t in [regexp_replace(z, '[^0-9]', '', 'g') for z in regexp_extract_all(name_raw || ' ' || addr_raw, '{pattern}')] if length(t) >= 7]"
    found = f"regexp_extract_all(name_raw, '{pattern}', {group})"
    return f"[lower(z) for z in {found}]" if kind == "domain" else found


@query(
    "au02_link_tokens",
    with_views(
        f"g AS ({TAGGED}), x AS ({' UNION ALL '.join(f"SELECT '{k}' AS kind, src, idx, country, entity, unnest(list_distinct({_token_sql(k)})) AS tok FROM g" for k in rules.LINK_TOKENS)}), "
        "m AS (SELECT kind, country, tok, entity, count(*) AS m FROM x GROUP BY ALL), w AS (SELECT kind, country, tok, sum(m) AS n, sum(m * (m - 1) / 2) AS same FROM m GROUP BY ALL), "
        "a AS (SELECT kind, count(DISTINCT (src, idx)) AS n_records FROM x GROUP BY kind), b AS (SELECT kind, CAST(sum(n * (n - 1) / 2) AS DOUBLE) AS n_pairs, CAST(sum(same) AS DOUBLE) AS n_true_pairs FROM w GROUP BY kind), c AS (SELECT kind, count(DISTINCT entity) AS n_covered FROM m WHERE entity >= 0 AND m > 1 GROUP BY kind) "
        "SELECT a.kind, n_records, n_pairs, n_true_pairs, round(CASE WHEN n_pairs > 0 THEN n_true_pairs / n_pairs END, 8) AS precision, coalesce(n_covered, 0) AS n_covered FROM a JOIN b ON b.kind = a.kind LEFT JOIN c ON c.kind = a.kind",
        "raw",
        "rec",
    ),
)
def link_tokens(spark, sf) -> DataFrame:
    """AU2 and AU3: what each kind of link token links, how often rightly, and how many entities it covers."""
    return _rounded(audit.token_report(_tagged(spark, sf)), "precision", to=8)


@query(
    "au03_link_rules",
    with_views(
        f"g AS ({TAGGED}), x AS ({' UNION ALL '.join(f"SELECT '{r}' AS rule, src, country, entity, {_rule_sql(r)} AS key FROM g WHERE src > 1" for r in decide.LINK_RULES)}), m AS (SELECT rule, src, country, key, entity, count(*) AS m FROM x WHERE key IS NOT NULL GROUP BY ALL), "
        "w AS (SELECT rule, src, country, key, sum(m) AS n, sum(CASE WHEN entity >= 0 THEN m * (m - 1) / 2 ELSE 0 END) AS same FROM m GROUP BY ALL), d AS (SELECT sum(m * (m - 1) / 2) AS every FROM (SELECT src, entity, count(*) AS m FROM g WHERE src > 1 AND entity >= 0 GROUP BY src, entity) y) "
        "SELECT rule, CAST(sum(n * (n - 1) / 2) AS DOUBLE) AS n_pairs, CAST(sum(same) AS DOUBLE) AS n_true_pairs, round(CASE WHEN sum(n * (n - 1) / 2) > 0 THEN sum(same) / sum(n * (n - 1) / 2) END, 8) AS precision, round(sum(same) / any_value(every), 8) AS coverage FROM w, d GROUP BY rule",
        "raw",
        "rec",
    ),
)
def link_rules(spark, sf) -> DataFrame:
    """AU3: what each rule links within a source, and how often rightly."""
    return _rounded(audit.rule_report(_tagged(spark, sf), tuple(decide.LINK_RULES)), "precision", "coverage", to=8)


def _md5(keys: str, seed: str) -> str:
    return f"md5({" || '|' || ".join(f'CAST({k} AS STRING)' for k in keys.split(', '))} || '|{seed}')"


def _first32(keys: str, seed: str) -> str:
    return f"CAST('0x' || substr({_md5(keys, seed)}, 1, 8) AS BIGINT)"


@query("ed12_sample_listing", with_views(f"{DECIDED} SELECT {KEY} FROM d WHERE accepted AND label = 0 ORDER BY {_md5(KEY, '42')}, {KEY} LIMIT 15", "pairs"))
def sample_listing(spark, sf) -> DataFrame:
    """ED12 and RP6: a seeded sample for a report, which is a listing of a few by nature."""
    return metrics.mistakes(_decided(spark, sf), "fp").select(*PAIR)


@query("ed11_bernoulli", with_views(f"SELECT {KEY} FROM pairs WHERE {_first32(KEY, '7')} < {int(0.1 * 2**32)}", "pairs"))
def bernoulli(spark, sf) -> DataFrame:
    """ED11's Bernoulli sample of pairs, which is a sample by feature."""
    return audit.bernoulli(_pairs(spark, sf), PAIR, 0.1, 7).select(*PAIR)


TEST_LIKE = f"w AS (SELECT country, s1, src, idx, score, p AS pscore FROM pairs WHERE NOT {_first32('country, s1', '42')} < {int(0.19 * 2**32)})"


@query(
    "tl01_test_like",
    with_views(
        f"{TEST_LIKE} SELECT {KEY}, row_number() OVER (PARTITION BY country, s1 ORDER BY score DESC, src, idx) AS rank_s, row_number() OVER (PARTITION BY country, src, idx ORDER BY score DESC, s1) AS rank_r, row_number() OVER (PARTITION BY country, s1 ORDER BY pscore DESC, src, idx) AS prank_s, row_number() OVER (PARTITION BY country, src, idx ORDER BY pscore DESC, s1) AS prank_r, count(*) OVER (PARTITION BY country, s1) AS n_cand_s1, count(*) OVER (PARTITION BY country, src, idx) AS n_cand_rec FROM w",
        "pairs",
    ),
)
def test_like(spark, sf) -> DataFrame:
    """TL1: a fifth of the first-source records gone, candidates ranked and counted anew by score and pscore."""
    return audit.test_like(_scored(spark, sf)).select(*PAIR, "rank_s", "rank_r", "prank_s", "prank_r", "n_cand_s1", "n_cand_rec")


CITY = "array_to_string(string_split(p_name, ' ')[1:2], ' ')"


@query(
    "rg02_found_runs",
    with_views(
        f"ct AS (SELECT DISTINCT {CITY} AS city FROM rec), cp AS (SELECT country, src, idx, addr_core || ' ' || p_name || ' ' || lower(p_brand) AS comp FROM rec), m AS (SELECT cp.country, cp.src, cp.idx, city, dense_rank() OVER (PARTITION BY cp.country, cp.src, cp.idx ORDER BY length(city) DESC) AS r FROM cp JOIN ct ON contains(' ' || comp || ' ', ' ' || city || ' ')), b AS (SELECT country, src, idx, count(DISTINCT city) AS k, min(city) AS city FROM m WHERE r = 1 GROUP BY country, src, idx) "
        "SELECT cp.country, cp.src, cp.idx, CASE WHEN k = 1 THEN b.city ELSE '' END AS region_found FROM cp LEFT JOIN b ON b.country = cp.country AND b.src = cp.src AND b.idx = cp.idx",
        "rec",
    ),
)
def found_runs(spark, sf) -> DataFrame:
    """RG2: cities of several tokens inside longer components, the longest one."""
    rec = view(spark, sf, "rec")
    city = F.array_join(F.slice(F.split("p_name", " "), 1, 2), " ")
    rows = rec.select("country", "src", "idx", F.array(F.concat_ws(" ", "addr_core", "p_name", F.lower("p_brand"))).alias("components"))
    return audit.find_region(rows, rec.select(city.alias("city"), city.alias("region")).distinct()).select("country", "src", "idx", "region_found")


# --- learning -------------------------------------------------------------------------------------------------------


@query("ml08_area", with_views("c AS (SELECT country, p, sum(label) AS a, sum(1 - label) AS b FROM pairs GROUP BY country, p), w AS (SELECT *, a * (coalesce(sum(b) OVER (PARTITION BY country ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + b / 2.0) AS won FROM c) SELECT country, CAST(sum(a) + sum(b) AS BIGINT) AS n, round(sum(won) / (CAST(sum(a) AS DOUBLE) * sum(b)), 8) AS auc FROM w GROUP BY country", "pairs"))
def area(spark, sf) -> DataFrame:
    """ML8: the area under the ROC curve by country."""
    return _rounded(learning.area_by(_pairs(spark, sf), ["country"]), "auc", to=8)


@query("ml10_pseudo_labels", with_views(f"SELECT {KEY}, p, CAST(CASE WHEN p >= 0.9 THEN 1 ELSE 0 END AS TINYINT) AS label FROM pairs WHERE {_first32('country, s1', 'pseudo')} < {int(0.3 * 2**32)} AND (p >= 0.9 OR p <= 0.1)", "pairs"))
def pseudo_labels(spark, sf) -> DataFrame:
    """ML10's labels: confident pairs of a share of the first-source records."""
    return learning.pseudo_labels(_pairs(spark, sf), high=0.9, low=0.1).select(*PAIR, "p", "label")


def _learnable(spark, sf) -> tuple[DataFrame, list[str]]:
    return learning.filled(_pairs(spark, sf).withColumn("label", F.col("label").cast("int")), LEARNED, [])


@query("ml10_refit")
def refit(spark, sf) -> DataFrame:
    """ML10: a model of one country and another's confident pairs scores that other."""
    rows, cols = _learnable(spark, sf)
    return learning.refit_with_pseudo(rows.drop("p"), _pairs(spark, sf), cols, "F", "O", 3, 0.9, 0.1).select(*PAIR, "p")


@query("ml05_averaged")
def averaged(spark, sf) -> DataFrame:
    """ML5: the mean of the folds' models."""
    ids = view(spark, sf, "ones").withColumn("entity_id", F.concat_ws("-", "country", F.col("s1").cast("string")))
    rows, cols = _learnable(spark, sf)
    _, models = learning.out_of_fold(learning.folds(rows.drop("p"), ids), cols, rounds=3, depth=3)
    return learning.averaged(rows.drop("p"), models).select(*PAIR, "p_m0", "p_m1", "p")


@query("ml11_adversarial")
def adversarial(spark, sf) -> DataFrame:
    """ML11: how well a model tells two splits apart, and by which columns."""
    rows, cols = _learnable(spark, sf)
    score, top = learning.adversarial(rows.filter("country = 'F'"), rows.filter("country = 'O'"), cols, 3)
    return spark.createDataFrame([(score, *x) for x in top], "auc double, column string, gain double, mean_a double, mean_b double")


@query("ml13_augmented", with_views(f"SELECT p.country, p.s1, p.src, p.idx, p.score, round(x.s, 6) AS s_sum FROM pairs p LEFT JOIN (SELECT {KEY}, sum(p) OVER (PARTITION BY country, s1) AS s, p AS q FROM pairs) x ON x.country = p.country AND x.s1 = p.s1 AND x.src = p.src AND x.idx = p.idx AND x.q >= 0.5", "pairs"))
def augmented(spark, sf) -> DataFrame:
    """ML13: the columns of a later stage beside the earlier ones, by pair."""
    from pyspark.sql import Window

    more = _pairs(spark, sf).withColumn("s_sum", F.sum("p").over(Window.partitionBy("country", "s1"))).filter("p >= 0.5").select(*PAIR, "score", "s_sum")
    return learning.augmented(_pairs(spark, sf).select(*PAIR, "score"), more).withColumn("s_sum", F.round("s_sum", 6))


GRID = ", ".join(f"({k}, {b})" for k in learning.PRUNER_GRID_K for b in learning.PRUNER_GRID_BIG_K)


@query(
    "pr05_budget_grid",
    with_views(
        f"{PRANKS}, {SIZES}, g(k, big_k) AS (VALUES {GRID}), h AS (SELECT k, big_k, country, s1, count(*) AS n, sum(label) AS tp FROM rk JOIN g ON pr <= k OR ps <= big_k GROUP BY ALL), r AS (SELECT g.k, g.big_k, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_pairs, avg({F05.format(p='coalesce(tp, 0)', t='t', tp='tp')}) AS oracle FROM sizes CROSS JOIN g LEFT JOIN h ON h.k = g.k AND h.big_k = g.big_k AND h.country = sizes.country AND h.s1 = sizes.s1 GROUP BY g.k, g.big_k), "
        "b AS (SELECT k, big_k FROM r WHERE n_pairs <= 4000 AND oracle >= (SELECT max(oracle) FROM r WHERE n_pairs <= 4000) - 0.001 ORDER BY n_pairs, k, big_k LIMIT 1) SELECT r.k, r.big_k, n_pairs, round(oracle, 8) AS oracle, b.k IS NOT NULL AS chosen FROM r LEFT JOIN b ON b.k = r.k AND b.big_k = r.big_k",
        *SIZED,
    ),
)
def budget_grid(spark, sf) -> DataFrame:
    """PR5: the pruner's choice of ranks within a budget of pairs."""
    return _rounded(learning.pruner_grid(_scored(spark, sf), _sizes(spark, sf), 4000), "oracle", to=8)


# --- scripts beyond Latin -------------------------------------------------------------------------------------------

WIDE = "translate(lower(name_raw), 'abcdefghijklmnopqrstuvwxyz0123456789', 'ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９')"


@query("tn06_wide_names", with_views(f"SELECT src, idx, {sql_clean('lower(name_raw)')} AS name_clean FROM raw", "raw"))
def wide_names(spark, sf) -> DataFrame:
    """TN6 and TN20: names in full-width letters and with ligatures are cleaned as their plain forms are."""
    wide = F.expr(WIDE)
    wide = F.when(F.col("idx") % 2 == 0, F.replace(F.replace(F.lower("name_raw"), F.lit("fi"), F.lit("ﬁ")), F.lit("ff"), F.lit("ﬀ"))).otherwise(wide)
    return view(spark, sf, "raw").select("src", "idx", text.clean(wide).alias("name_clean"))


NATIVE_PAIRS = f"v AS (SELECT unnest(string_split({NATIVE.format(x='p_name')}, ' ')) AS key, unnest(string_split(p_name, ' ')) AS value FROM rec), vc AS (SELECT key, value, count(*) AS n FROM v GROUP BY key, value), vr AS (SELECT *, sum(n) OVER (PARTITION BY key) AS total, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS rn FROM vc), dict AS (SELECT key, value FROM vr WHERE rn = 1 AND n >= 3 AND n / CAST(total AS DOUBLE) >= 0.6)"


@query(
    "tr03_native_names",
    with_views(
        f"{NATIVE_PAIRS}, t AS (SELECT src, idx, unnest(string_split({NATIVE.format(x='p_name')}, ' ')) AS key, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM rec), w AS (SELECT src, idx, string_agg(value, ' ' ORDER BY i) AS name_clean, count(*) AS n, count(value) AS k, string_agg(t.key, '') AS letters FROM t LEFT JOIN dict ON dict.key = t.key GROUP BY src, idx) SELECT src, idx, CASE WHEN n = k AND NOT regexp_matches(letters, '[a-z]') THEN name_clean END AS name_clean FROM w",
        "rec",
    ),
)
def native_names(spark, sf) -> DataFrame:
    """TR2 and TR3 within the cleaning: names in Devanagari letters by a learned dictionary, where it has all of a name's words."""
    rec = view(spark, sf, "rec").withColumn("native", F.expr(NATIVE.format(x="p_name")))
    learned = translit_learn.learn_tokens(rec.select(F.col("native").alias("noisy"), F.col("p_name").alias("s1")))
    known = {r["key"]: r["value"] for r in learned.collect()}  # a dictionary: a word each
    whole = F.forall(F.split("native", " "), lambda t: F.array_contains(F.array(*map(F.lit, known)), t))
    return rec.select("src", "idx", F.when(whole & ~F.col("native").rlike("[a-z]"), text.clean(F.col("native"), known=known)).alias("name_clean"))


@query(
    "tr08_learned_states",
    with_views(f"a AS (SELECT {NATIVE.format(x='lower(state)')} || ',' || {NATIVE.format(x="string_split(p_name, ' ')[1]")} AS noisy, state FROM rec WHERE state <> ''), v AS (SELECT unnest(string_split(noisy, ',')) AS key, state AS value FROM a), c AS (SELECT key, value, count(*) AS n FROM v GROUP BY key, value), r AS (SELECT *, sum(n) OVER (PARTITION BY key) AS total, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS rn FROM c) SELECT key, value, n FROM r WHERE rn = 1 AND n >= 3 AND n / CAST(total AS DOUBLE) >= 0.6", "rec"),
)
def learned_states(spark, sf) -> DataFrame:
    """TR4 and TR8: which native components of addresses stand for which state."""
    native = lambda x: F.expr(NATIVE.format(x=x))
    rows = view(spark, sf, "rec").select(F.concat_ws(",", native("lower(state)"), native("split(p_name, ' ')[0]")).alias("noisy_addr"), F.array(F.lit("zzzzzz")).alias("s1_components"), "state")
    return translit_learn.learn_states(rows)

