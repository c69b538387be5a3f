"""Queries over candidate pairs: features, consistency, decisions, metrics, audits and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import audit, blocking, consistency, decide, features, learning, metrics
from .blocking_queries import F05, records
from .blocking_queries import PAIR_SQL as BLOCKED
from .text_queries import SIMS, query
from .views import view, with_views

PAIR = ["country", "s1", "src", "idx"]
PAIR_SQL = "country, s1, src, idx"


def _pairs(spark, sf) -> DataFrame:
    return view(spark, sf, "pairs")


def _rounded(df: DataFrame, *cols: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), to) for c in cols})


# --- features -------------------------------------------------------------------------------------------------------

#: blocked candidates, of which there are as many as records allow, in common tables that end with ps
NEAR = "SELECT country, s1, src, idx FROM ps"


def _near(spark, sf) -> DataFrame:
    keys = blocking.keys(records(spark, sf))
    return blocking.candidate_pairs(keys, blocking.blocks(keys)).select(*PAIR)


def _joined(spark, sf, *parts: str) -> DataFrame:
    return features.pair_rows(_near(spark, sf), records(spark, sf), parts)


IDF = """t AS (SELECT DISTINCT country, src, idx, unnest(string_split({c}, ' ')) AS tok FROM rec WHERE {c} <> ''),
n AS (SELECT country, count(*) AS n FROM rec GROUP BY country), w AS (SELECT t.country, tok, ln(any_value(n.n) / CAST(count(*) AS DOUBLE)) AS idf FROM t JOIN n ON n.country = t.country GROUP BY t.country, tok)"""


@query("fe24_idf", with_views(IDF.format(c="name_core") + " SELECT country, tok, round(idf, 6) AS idf FROM w", "rec"))
def idf(spark, sf) -> DataFrame:
    """FE24."""
    return _rounded(features.idf(features.prepared(records(spark, sf)), "nt"), "idf")


COVER = IDF + """, near AS ({near}), m AS (SELECT t.country, t.src, t.idx, sum(w.idf) AS mass FROM t JOIN w ON w.country = t.country AND w.tok = t.tok GROUP BY t.country, t.src, t.idx),
i AS (SELECT near.country, near.s1, near.src, near.idx, sum(w.idf) AS hit, count(*) AS k FROM near JOIN t a ON a.country = near.country AND a.src = 1 AND a.idx = near.s1 JOIN t b ON b.country = near.country AND b.src = near.src AND b.idx = near.idx AND b.tok = a.tok JOIN w ON w.country = a.country AND w.tok = a.tok GROUP BY near.country, near.s1, near.src, near.idx)"""


@query(
    "fe05_token_features",
    with_views(
        BLOCKED + ", " + COVER.format(c="name_core", near=NEAR)
        + """, rare AS (SELECT t.country, t.src, t.idx, arg_max(t.tok, (w.idf, t.tok)) AS tok FROM t JOIN w ON w.country = t.country AND w.tok = t.tok GROUP BY t.country, t.src, t.idx)
SELECT near.country, near.s1, near.src, near.idx, round(coalesce(k, 0) / CAST(len(list_distinct(list_concat(string_split(a.name_core, ' '), string_split(b.name_core, ' ')))) AS DOUBLE), 6) AS name_jaccard,
round(CASE WHEN ma.mass = 0 THEN 0 ELSE coalesce(hit, 0) / ma.mass END, 6) AS name_cov_s, round(CASE WHEN mb.mass = 0 THEN 0 ELSE coalesce(hit, 0) / mb.mass END, 6) AS name_cov_r,
CASE WHEN split_part(a.name_core, ' ', 1) = split_part(b.name_core, ' ', 1) THEN 1 ELSE 0 END AS name_first_tok, CASE WHEN list_contains(string_split(b.name_core, ' '), rare.tok) THEN 1 ELSE 0 END AS name_rarest_in_r,
CASE WHEN a.name_core = b.name_core THEN 1 ELSE 0 END AS name_exact, CASE WHEN contains(a.name_concat, b.name_concat) OR contains(b.name_concat, a.name_concat) THEN 1 ELSE 0 END AS concat_contain
FROM near JOIN rec a ON a.src = 1 AND a.country = near.country AND a.idx = near.s1 JOIN rec b ON b.country = near.country AND b.src = near.src AND b.idx = near.idx
JOIN m ma ON ma.country = near.country AND ma.src = 1 AND ma.idx = near.s1 JOIN m mb ON mb.country = near.country AND mb.src = near.src AND mb.idx = near.idx JOIN rare ON rare.country = near.country AND rare.src = 1 AND rare.idx = near.s1
LEFT JOIN i ON i.country = near.country AND i.s1 = near.s1 AND i.src = near.src AND i.idx = near.idx""",
        "rec",
    ),
)
def token_features(spark, sf) -> DataFrame:
    """FE5 to FE7 and FE25."""
    s, r = (lambda c: F.col(f"s_{c}")), (lambda c: F.col(f"r_{c}"))
    cols = features.token_features(s("nt"), r("nt"), s("nw"), r("nw"), s("pname"), r("pname"), s("pconcat"), r("pconcat"))
    return _rounded(_joined(spark, sf, "name").select(*PAIR, *(c.alias(n) for n, c in cols.items())), "name_jaccard", "name_cov_s", "name_cov_r")


@query(
    "fe08_address_cover",
    with_views(
        BLOCKED + ", " + COVER.format(c="addr_core", near=NEAR)
        + """ SELECT near.country, near.s1, near.src, near.idx, round(CASE WHEN ma.mass > 0 AND mb.mass > 0 THEN coalesce(hit, 0) / ma.mass ELSE 0 END, 6) AS addr_cov_s, round(CASE WHEN ma.mass > 0 AND mb.mass > 0 THEN coalesce(hit, 0) / mb.mass ELSE 0 END, 6) AS addr_cov_r
FROM near LEFT JOIN m ma ON ma.country = near.country AND ma.src = 1 AND ma.idx = near.s1 LEFT JOIN m mb ON mb.country = near.country AND mb.src = near.src AND mb.idx = near.idx LEFT JOIN i ON i.country = near.country AND i.s1 = near.s1 AND i.src = near.src AND i.idx = near.idx""",
        "rec",
    ),
)
def address_cover(spark, sf) -> DataFrame:
    """FE8."""
    cols = features.address_features(F.col("s_at"), F.col("r_at"), F.col("s_aw"), F.col("r_aw"))
    return _rounded(_joined(spark, sf, "address").select(*PAIR, *(c.alias(n) for n, c in cols.items())), "addr_cov_s", "addr_cov_r")


@query(
    "fe09_number_features",
    with_views(
        f"""{BLOCKED}, near AS ({NEAR}), x AS (SELECT near.country, near.s1, near.src, near.idx, [t for t in string_split(a.addr_nums, ' ') if t <> ''] AS sn, [t for t in string_split(b.addr_nums, ' ') if t <> ''] AS rn, a.house_num AS sh, b.house_num AS rh, a.state AS ss, b.state AS rs,
string_split(a.name_core, ' ') AS snt, string_split(b.name_core, ' ') AS rnt, [t for t in string_split(a.addr_core, ' ') if t <> ''] AS sat, [t for t in string_split(b.addr_core, ' ') if t <> ''] AS rat, a.name_core AS sname, b.name_core AS rname
FROM near JOIN rec a ON a.src = 1 AND a.country = near.country AND a.idx = near.s1 JOIN rec b ON b.country = near.country AND b.src = near.src AND b.idx = near.idx)
SELECT country, s1, src, idx, round(CASE WHEN len(sn) = 0 AND len(rn) = 0 THEN 0 ELSE len(list_intersect(sn, rn)) / CAST(len(list_distinct(list_concat(sn, rn))) AS DOUBLE) END, 6) AS nums_jaccard,
round(CASE WHEN len(sn) = 0 THEN 0 ELSE len([t for t in sn if list_contains(rn, t)]) / CAST(len(sn) AS DOUBLE) END, 6) AS nums_frac_s_in_r,
CASE WHEN sh = rh THEN 1 ELSE 0 END AS house_eq, round(ln(1 + abs(CAST(sh AS BIGINT) - CAST(rh AS BIGINT))), 6) AS house_logdiff, CASE WHEN starts_with(sh, rh) OR starts_with(rh, sh) THEN 1 ELSE 0 END AS house_prefix, CASE WHEN sh IS NULL OR rh IS NULL THEN 1 ELSE 0 END AS house_missing,
len(snt) AS name_ntok_s, len(rnt) AS name_ntok_r, len(sat) AS addr_ntok_s, len(rat) AS addr_ntok_r, abs(length(sname) - length(rname)) AS name_len_diff, CASE WHEN ss = '' OR rs = '' THEN -1 WHEN ss = rs THEN 1 ELSE 0 END AS state_match, CASE WHEN src = 3 THEN 1 ELSE 0 END AS rec_src_s3 FROM x""",
        "rec",
    ),
)
def number_features(spark, sf) -> DataFrame:
    """FE9 to FE13."""
    s, r = (lambda c: F.col(f"s_{c}")), (lambda c: F.col(f"r_{c}"))
    cols = features.number_features(s("nums"), r("nums")) | features.house_features(s("house_num"), r("house_num")) | features.size_features(s("nt"), r("nt"), s("at"), r("at"), s("pname"), r("pname"))
    cols |= {"state_match": features.state_match(s("state"), r("state")), "rec_src_s3": (F.col("src") == 3).cast("int")}
    return _rounded(_joined(spark, sf).select(*PAIR, *(c.alias(n) for n, c in cols.items())), "nums_jaccard", "nums_frac_s_in_r", "house_logdiff")


@query(
    "fe14_chains_and_vocabulary",
    with_views(
        "c AS (SELECT country, name_core, count(*) AS chain FROM rec WHERE src = 1 GROUP BY country, name_core), v AS (SELECT DISTINCT country, unnest(string_split(name_core, ' ')) AS tok FROM rec WHERE src = 1), t AS (SELECT country, src, idx, unnest(string_split(name_core, ' ')) AS tok FROM rec), s AS (SELECT t.country, t.src, t.idx, avg(CASE WHEN v.tok IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM t LEFT JOIN v ON v.country = t.country AND v.tok = t.tok GROUP BY t.country, t.src, t.idx) SELECT rec.country, rec.src, rec.idx, coalesce(chain, 0) AS chain, round(share, 6) AS r_tok_in_s1_vocab FROM rec LEFT JOIN c ON c.country = rec.country AND c.name_core = rec.name_core JOIN s ON s.country = rec.country AND s.src = rec.src AND s.idx = rec.idx",
        "rec",
    ),
)
def chains_and_vocabulary(spark, sf) -> DataFrame:
    """FE14 and FE15."""
    rows = features.chains(features.prepared(records(spark, sf)))
    return _rounded(rows.select("country", "src", "idx", "chain").join(features.vocabulary_share(rows), ["country", "src", "idx"]), "r_tok_in_s1_vocab")


@query("fe16_key_bits", with_views(f"SELECT {PAIR_SQL}, " + ", ".join(f"(bits >> {i}) & 1 AS key_{n}" for i, n in enumerate(blocking.KEY_TYPES)) + " FROM pairs", "pairs"))
def key_bits(spark, sf) -> DataFrame:
    """FE16."""
    return _pairs(spark, sf).select(*PAIR, *(c.alias(n) for n, c in features.key_bits(F.col("bits")).items()))


def _other(c: str) -> str:
    return f"(SELECT max(o.{c}) FROM pairs o WHERE o.country = p.country AND o.src = p.src AND o.idx = p.idx AND o.s1 <> p.s1)"


@query(
    "fe18_competition",
    with_views(
        f"""x AS (SELECT p.*, {_other('sim_name')} AS r_oth_name, {_other('sim_addr')} AS r_oth_addr, {_other('score')} AS r_oth_score FROM pairs p)
SELECT {PAIR_SQL}, r_oth_name, r_oth_addr, r_oth_score, sim_name - coalesce(r_oth_name, 0) AS r_margin_name, sim_addr - coalesce(r_oth_addr, 0) AS r_margin_addr, score - coalesce(r_oth_score, 0) AS r_margin_score,
CAST(sum(CASE WHEN sim_name >= 90 THEN 1 ELSE 0 END) OVER (PARTITION BY country, src, idx) AS BIGINT) AS r_n_name90, rank() OVER (PARTITION BY country, s1 ORDER BY sim_name DESC) AS s_rank_name, rank() OVER (PARTITION BY country, s1 ORDER BY sim_addr DESC) AS s_rank_addr,
max(score) OVER (PARTITION BY country, s1) - score AS s_gap_best, CAST(sum(CASE WHEN sim_name >= 90 AND sim_addr >= 85 THEN 1 ELSE 0 END) OVER (PARTITION BY country, s1) AS BIGINT) AS s_n_near FROM x""",
        "pairs",
    ),
)
def competition(spark, sf) -> DataFrame:
    """FE18 to FE22."""
    rows = features.competition(_pairs(spark, sf))
    return rows.select(*PAIR, *(f"r_{k}_{c}" for k in ("oth", "margin") for c in ("name", "addr", "score")), "r_n_name90", "s_rank_name", "s_rank_addr", "s_gap_best", "s_n_near")


SIDES = f"{BLOCKED}, nx AS (SELECT ps.country, ps.s1, ps.src, ps.idx, a.name_core AS sn, b.name_core AS rn, b.name_alt AS ra, a.name_concat AS sc, b.name_concat AS rc, a.name_phon AS sp, b.name_phon AS rp, a.addr_core AS sa, b.addr_core AS rd FROM ps JOIN r a ON a.src = 1 AND a.country = ps.country AND a.idx = ps.s1 JOIN r b ON b.country = ps.country AND b.src = ps.src AND b.idx = ps.idx)"
FIVE = "tp AS (SELECT sn AS a, rn AS b FROM nx UNION SELECT sn, ra FROM nx UNION SELECT sc, rc FROM nx UNION SELECT sp, rp FROM nx UNION SELECT sa, rd FROM nx)"
PARTIAL = ("name_partial", "addr_partial")


@query(
    "fe01_similarity_features",
    with_views(
        f"""{SIDES}, {FIVE}, {SIMS} SELECT country, s1, src, idx, n.tset AS name_tsr, n.tsort AS name_tsort, n.ratio AS name_ratio, round(jaro_winkler_similarity(sn, rn), 4) AS name_jw, CASE WHEN ra <> '' THEN l.tset ELSE 0 END AS name_alt_tsr, c.ratio AS concat_ratio, p.tset AS phon_tsr, d.tset AS addr_tsr, d.tsort AS addr_tsort, d.ratio AS addr_ratio
FROM nx JOIN ts n ON n.a = sn AND n.b = rn JOIN ts l ON l.a = sn AND l.b = ra JOIN ts c ON c.a = sc AND c.b = rc JOIN ts p ON p.a = sp AND p.b = rp JOIN ts d ON d.a = sa AND d.b = rd""",
        "rec",
    ),
)
def similarity_features(spark, sf) -> DataFrame:
    """FE1 to FE4, but for partial ratios."""
    cols = {n: c for n, c in features.similarity_features().items() if n not in PARTIAL}
    rows = _joined(spark, sf).select(*PAIR, *(c.cast("double").alias(n) for n, c in cols.items()))
    return rows.withColumns({n: F.round(n, 4 if n == "name_jw" else 3) for n in cols})


@query("fe03_partial_ratios")
def partial_ratios(spark, sf) -> DataFrame:
    """The partial ratios among FE1 to FE4: rows only."""
    return _joined(spark, sf).select(*PAIR, *(c.alias(n) for n, c in features.similarity_features().items() if n in PARTIAL))


@query("fe00_all_features")
def all_features(spark, sf) -> DataFrame:
    """The whole feature relation of blocked pairs."""
    rec = records(spark, sf)
    keys = blocking.keys(rec)
    pairs = blocking.with_counts(blocking.with_ranks(blocking.quick_scores(blocking.candidate_pairs(keys, blocking.blocks(keys)), rec)))
    return features.features(pairs, rec)


@query("fe27_uncovered", with_views(f"SELECT {PAIR_SQL} FROM pairs WHERE p < 0.5", "pairs"))
def uncovered(spark, sf) -> DataFrame:
    """FE27: pairs that a table of finished features lacks."""
    return features.uncovered(_pairs(spark, sf).select(*PAIR), _pairs(spark, sf).filter("p >= 0.5"))


# --- consistency ----------------------------------------------------------------------------------------------------


@query(
    "s21_side_features",
    with_views(
        f"SELECT {PAIR_SQL}, row_number() OVER (PARTITION BY country, s1 ORDER BY p DESC, src, idx) AS s_rank_p, round(max(p) OVER (PARTITION BY country, s1) - p, 6) AS s_gap_maxp, round(sum(p) OVER (PARTITION BY country, s1), 6) AS s_sum_p, CAST(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY country, s1) AS BIGINT) AS s_cnt_p50, {_other('p')} AS r_oth_maxp, CAST(sum(CASE WHEN p >= 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY country, src, idx) AS BIGINT) AS r_cnt_p10 FROM pairs p",
        "pairs",
    ),
)
def side_features(spark, sf) -> DataFrame:
    """S21 and S25."""
    return _rounded(consistency.side_features(_pairs(spark, sf)), "s_gap_maxp", "s_sum_p").select(*PAIR, "s_rank_p", "s_gap_maxp", "s_sum_p", "s_cnt_p50", "r_oth_maxp", "r_cnt_p10")


def _same(k: str) -> str:
    at = f"FROM pairs o WHERE o.country = p.country AND o.s1 = p.s1 AND o.{k} = p.{k} AND (o.src <> p.src OR o.idx <> p.idx)"
    has = f"p.{k} IS NOT NULL AND p.{k} <> ''"
    return f"CASE WHEN {has} THEN (SELECT count(*) {at}) END AS s_n_same_{k}, CASE WHEN {has} THEN round((SELECT coalesce(sum(o.p), 0) {at}), 6) END AS s_sum_same_{k}, CASE WHEN {has} THEN (SELECT max(o.p) {at}) END AS s_max_same_{k}"


@query("s22_shared_keys", with_views(f"SELECT {PAIR_SQL}, {', '.join(map(_same, ('house', 'name', 'addr')))} FROM pairs p", "pairs"))
def shared_keys(spark, sf) -> DataFrame:
    """S22."""
    names = [f"s_{f}_same_{k}" for k in ("house", "name", "addr") for f in ("n", "sum", "max")]
    rows = consistency.shared_key_features(_pairs(spark, sf)).select(*PAIR, *names)
    # a sum less its own part may be a rounding error below nothing
    return rows.withColumns({n: F.round(F.col(n), 6) + 0.0 for n in names if "_sum_" in n})


@query(
    "s23_modal_house",
    with_views(
        f"h AS (SELECT country, s1, house, sum(p) AS sp FROM pairs WHERE house IS NOT NULL GROUP BY country, s1, house), m AS (SELECT country, s1, house AS mode FROM (SELECT *, row_number() OVER (PARTITION BY country, s1 ORDER BY round(sp, 9) DESC, house DESC) AS rn FROM h) x WHERE rn = 1), t AS (SELECT country, s1, sum(p) AS total FROM pairs GROUP BY country, s1) SELECT p.country, p.s1, p.src, p.idx, CASE WHEN p.house = mode THEN 1 ELSE 0 END AS r_house_is_mode, round(CASE WHEN total <> 0 THEN sp / total END, 6) AS s_pshare_r_house FROM pairs p LEFT JOIN h ON h.country = p.country AND h.s1 = p.s1 AND h.house = p.house LEFT JOIN m ON m.country = p.country AND m.s1 = p.s1 JOIN t ON t.country = p.country AND t.s1 = p.s1",
        "pairs",
    ),
)
def modal_house(spark, sf) -> DataFrame:
    """S23 and S24."""
    return _rounded(consistency.modal_house(_pairs(spark, sf)), "s_pshare_r_house").select(*PAIR, "r_house_is_mode", "s_pshare_r_house")


GROUP_REC = "SELECT country, src, idx, p_name AS name, house_num AS house, addr_core AS addr FROM rec"


@query(
    "s26_group_sizes",
    with_views(
        f"{BLOCKED}, g AS ({GROUP_REC}), near AS ({NEAR}), nh AS (SELECT name, house, count(*) AS k FROM g WHERE src > 1 AND house IS NOT NULL AND name <> '' GROUP BY name, house), na AS (SELECT name, addr, count(*) AS k FROM g WHERE src > 1 AND addr <> '' AND name <> '' GROUP BY name, addr), sh AS (SELECT name, house, count(*) AS k FROM g WHERE src = 1 AND house IS NOT NULL GROUP BY name, house) SELECT near.country, near.s1, near.src, near.idx, coalesce(nh.k, 0) AS grp_r_name_house, coalesce(na.k, 0) AS grp_r_name_addr, coalesce(sh.k, 0) AS grp_s_name_house FROM near JOIN g r ON r.country = near.country AND r.src = near.src AND r.idx = near.idx JOIN g s ON s.country = near.country AND s.src = 1 AND s.idx = near.s1 LEFT JOIN nh ON nh.name = r.name AND nh.house = r.house LEFT JOIN na ON na.name = r.name AND na.addr = r.addr LEFT JOIN sh ON sh.name = s.name AND sh.house = s.house",
        "rec",
    ),
)
def group_sizes(spark, sf) -> DataFrame:
    """S26, over all countries."""
    rec = view(spark, sf, "rec").select("country", "src", "idx", F.col("p_name").alias("name"), F.col("house_num").alias("house"), F.col("addr_core").alias("addr"))
    return consistency.group_sizes(_near(spark, sf), rec)


# --- decisions ------------------------------------------------------------------------------------------------------

ODDS = "o AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6)) AS od FROM pairs), q AS (SELECT *, od / (1 + sum(od) OVER (PARTITION BY country, src, idx)) AS q FROM o)"


@query("dc01_odds", with_views(f"{ODDS} SELECT {PAIR_SQL}, round(q, 8) AS q FROM q", "pairs"))
def odds(spark, sf) -> DataFrame:
    """DC1."""
    return _rounded(decide.odds(_pairs(spark, sf)), "q", to=8).select(*PAIR, "q")


@query("dc02_no_home", with_views(f"SELECT {PAIR_SQL}, p AS q FROM pairs", "pairs"))
def no_home(spark, sf) -> DataFrame:
    """DC2."""
    return decide.one_home(_pairs(spark, sf), "none").select(*PAIR, "q")


@query("dc03_best_owner", with_views(f"SELECT {PAIR_SQL}, CASE WHEN row_number() OVER (PARTITION BY country, src, idx ORDER BY p DESC, s1) = 1 THEN p ELSE 0 END AS q FROM pairs", "pairs"))
def best_owner(spark, sf) -> DataFrame:
    """DC3."""
    return decide.best_owner(_pairs(spark, sf)).select(*PAIR, "q")


@query("dc04_threshold", with_views(f"SELECT {PAIR_SQL}, p >= 0.6 AS accepted FROM pairs", "pairs"))
def threshold(spark, sf) -> DataFrame:
    """DC4."""
    return decide.threshold(decide.one_home(_pairs(spark, sf), "none"), 0.6).select(*PAIR, "accepted")


@query("dc05_two_thresholds", with_views(f"r AS (SELECT *, row_number() OVER (PARTITION BY country, s1 ORDER BY p DESC, src, idx) AS rn, max(p) OVER (PARTITION BY country, s1) AS mp FROM pairs) SELECT {PAIR_SQL}, CASE WHEN rn = 1 THEN p >= 0.9 ELSE mp >= 0.9 AND p >= 0.7 END AS accepted FROM r", "pairs"))
def two_thresholds(spark, sf) -> DataFrame:
    """DC5."""
    return decide.two_thresholds(decide.one_home(_pairs(spark, sf), "none"), 0.9, 0.7).select(*PAIR, "accepted")


@query("dc06_pmf_of_three", with_views("r AS (SELECT country, s1, p, row_number() OVER (PARTITION BY country, s1 ORDER BY p DESC, src, idx) AS rn FROM pairs), t AS (SELECT country, s1, max(p) FILTER (rn = 1) AS a, max(p) FILTER (rn = 2) AS b, max(p) FILTER (rn = 3) AS c FROM r WHERE rn <= 3 GROUP BY country, s1) SELECT country, s1, round((1-a)*(1-b)*(1-c), 8) AS p0, round(a*(1-b)*(1-c)+b*(1-a)*(1-c)+c*(1-a)*(1-b), 8) AS p1, round(a*b*(1-c)+a*c*(1-b)+b*c*(1-a), 8) AS p2, round(a*b*c, 8) AS p3 FROM t", "pairs"))
def pmf_of_three(spark, sf) -> DataFrame:
    """DC6 for the three best candidates, against the closed form."""
    rank = F.row_number().over(Window.partitionBy("country", "s1").orderBy(F.desc("p"), "src", "idx"))
    best = _pairs(spark, sf).withColumn("rn", rank).filter("rn <= 3").groupBy("country", "s1").agg(F.array_sort(F.collect_list(F.struct("rn", "p"))).alias("x"))
    rows = best.withColumn("pmf", decide.poisson_binomial(F.col("x.p")))
    return rows.select("country", "s1", *(F.round(F.get("pmf", F.lit(i)), 8).alias(f"p{i}") for i in range(4)))


TWO = "r AS (SELECT country, s1, q, row_number() OVER (PARTITION BY country, s1 ORDER BY q DESC, src, idx) AS rn FROM q), t AS (SELECT country, s1, max(q) FILTER (rn = 1) AS a, max(q) FILTER (rn = 2) AS b FROM r WHERE rn <= 2 GROUP BY country, s1)"


@query(
    "dc07_expected_scores_of_two",
    with_views(f"{ODDS}, {TWO} SELECT country, s1, round((1-a)*(1-b), 8) AS e0, round(a*(1-b) * 1.25 / (1 + 0.25) + a*b * 1.25 / (1 + 0.5), 8) AS e1, round((a*(1-b) + b*(1-a)) * 1.25 / (2 + 0.25) + a*b * 2.5 / (2 + 0.5), 8) AS e2 FROM t", "pairs"),
)
def expected_scores_of_two(spark, sf) -> DataFrame:
    """DC7's expected scores for the two best candidates, against the closed form."""
    rows = decide.odds(_pairs(spark, sf))
    rank = F.row_number().over(Window.partitionBy("country", "s1").orderBy(F.desc("q"), "src", "idx"))
    best = rows.withColumn("rn", rank).filter("rn <= 2").groupBy("country", "s1").agg(F.array_sort(F.collect_list(F.struct("rn", "q"))).alias("x"))
    rows = best.withColumn("e", decide.expected_scores(F.col("x.q")))
    return rows.select("country", "s1", *(F.round(F.get("e", F.lit(i)), 8).alias(f"e{i}") for i in range(3)))


SIZES = "sizes AS (SELECT o.country, o.s1, count(t.idx) AS t FROM ones o LEFT JOIN pair_truth t ON t.country = o.country AND t.s1 = o.s1 GROUP BY o.country, o.s1)"


def _sizes(spark, sf) -> DataFrame:
    n = view(spark, sf, "pair_truth").groupBy("country", "s1").agg(F.count(F.lit(1)).alias("t"))
    return view(spark, sf, "ones").join(n, ["country", "s1"], "left").na.fill(0, ["t"])


THRS = "(VALUES " + ", ".join(f"({t})" for t in decide.THRESHOLDS) + ")"


@query(
    "dc09_threshold_grid",
    with_views(
        f"{SIZES}, g(thr) AS (SELECT * FROM {THRS}), h AS (SELECT g.thr, country, s1, count(*) AS n, sum(label) AS tp FROM pairs JOIN g ON p >= g.thr GROUP BY g.thr, country, s1) SELECT CAST(g.thr AS DOUBLE) AS thr, round(avg({F05.format(p='coalesce(n, 0)', t='t', tp='tp')}), 8) AS score FROM sizes CROSS JOIN g LEFT JOIN h ON h.thr = g.thr AND h.country = sizes.country AND h.s1 = sizes.s1 GROUP BY g.thr",
        "pairs",
        "ones",
        "pair_truth",
    ),
)
def threshold_grid(spark, sf) -> DataFrame:
    """DC9's single thresholds and MT3, all in one pass."""
    return _rounded(decide.threshold_grid(decide.one_home(_pairs(spark, sf), "none"), _sizes(spark, sf)), "score", to=8)


@query("dc11_rival_filter", with_views(f"SELECT {PAIR_SQL}, coalesce(house <> s_house AND count(house) OVER (PARTITION BY country, s1, house) >= 2, false) AS dropped FROM pairs", "pairs"))
def rival_filter(spark, sf) -> DataFrame:
    """DC11."""
    return decide.rival_filter(_pairs(spark, sf)).select(*PAIR, "dropped")


@query("dc12_smoothed", with_views(f"SELECT {PAIR_SQL}, round(avg(p) OVER w, 9) AS mean, round(median(p) OVER w, 9) AS median, round(CASE WHEN max(p) OVER w >= 0.9 THEN max(p) OVER w ELSE avg(p) OVER w END, 9) AS maxif FROM pairs WINDOW w AS (PARTITION BY country, s1, name)", "pairs"))
def smoothed(spark, sf) -> DataFrame:
    """DC12, with the name as the component."""
    rows = _pairs(spark, sf)
    for how in ("mean", "median", "maxif"):
        rows = decide.smoothed(rows, how, "name").withColumn(how, F.round("p_smooth", 9)).drop("p_smooth")
    return rows.select(*PAIR, "mean", "median", "maxif")


@query(
    "dc13_link_components",
    with_views(
        "lab AS (SELECT country, s1, src, idx, house, CASE WHEN house IS NOT NULL AND house <> '' THEN min(idx) OVER (PARTITION BY country, s1, src, name, house) ELSE idx END AS component FROM pairs) SELECT country, s1, src, idx, component FROM lab",
        "pairs",
    ),
)
def link_components(spark, sf) -> DataFrame:
    """DC13 and DC14 for one rule, name and house."""
    one = F.when(F.col("house").isNotNull() & (F.col("house") != ""), F.array(F.concat_ws("|", "name", "house"))).otherwise(F.array().cast("array<string>"))
    return decide.link_components(_pairs(spark, sf).withColumn("keys", one)).select(*PAIR, "component")


# --- metrics --------------------------------------------------------------------------------------------------------

SCORES = f"""t AS (SELECT l.s1_id, l.country, list(DISTINCT x.rec_id) FILTER (x.rec_id IS NOT NULL) AS tids FROM lists l LEFT JOIN true_ids x ON x.s1_id = l.s1_id GROUP BY l.s1_id, l.country),
p AS (SELECT s1_id, list(DISTINCT rec_id) AS pids FROM pred_ids GROUP BY s1_id),
c AS (SELECT t.s1_id, t.country, coalesce(len(tids), 0) AS n_true, coalesce(len(pids), 0) AS n_pred, coalesce(len(list_intersect(tids, pids)), 0) AS tp FROM t LEFT JOIN p ON p.s1_id = t.s1_id),
sc AS (SELECT *, {F05.format(p='n_pred', t='n_true', tp='tp')} AS f05 FROM c)"""
LISTED = ("lists", "true_ids", "pred_ids")


def _scores(spark, sf) -> DataFrame:
    ids = lambda v: view(spark, sf, v).groupBy("s1_id").agg(F.collect_set("rec_id").alias("ids"))
    truth = view(spark, sf, "lists").join(ids("true_ids"), "s1_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    return metrics.per_record(truth, ids("pred_ids"))


@query("mt01_entity_scores", with_views(f"{SCORES} SELECT s1_id, country, n_true, n_pred, tp, round(f05, 8) AS f05 FROM sc", *LISTED))
def entity_scores(spark, sf) -> DataFrame:
    """MT1."""
    return _rounded(_scores(spark, sf), "f05", to=8)


@query(
    "mt02_macro_scores",
    with_views(f"{SCORES} SELECT 'overall' AS slice, 'all' AS value, count(*) AS n, round(avg(f05), 8) AS score FROM sc UNION ALL SELECT 'type', CASE WHEN n_true = 0 THEN 'singleton' ELSE 'matched' END, count(*), round(avg(f05), 8) FROM sc GROUP BY 2 UNION ALL SELECT 'country', country, count(*), round(avg(f05), 8) FROM sc GROUP BY 2", *LISTED),
)
def macro_scores(spark, sf) -> DataFrame:
    """MT2."""
    return _rounded(metrics.macro(_scores(spark, sf)), "score", to=8)


BUCKET = "CASE WHEN {n} <= 5 THEN CAST({n} AS STRING) WHEN {n} <= 10 THEN '6-10' ELSE '>10' END"


@query("mt04_size_crosstab", with_views(f"{SCORES} SELECT {BUCKET.format(n='n_true')} AS true_size, {BUCKET.format(n='n_pred')} AS pred_size, count(*) AS n FROM sc GROUP BY 1, 2", *LISTED))
def size_crosstab(spark, sf) -> DataFrame:
    """MT4."""
    return metrics.size_crosstab(_scores(spark, sf))


def _decided(spark, sf) -> DataFrame:
    return decide.threshold(decide.odds(_pairs(spark, sf)), 0.1)


DECIDED = f"{ODDS}, d AS (SELECT *, q >= 0.1 AS accepted FROM q)"


@query("mt05_loss_split", with_views(f"{DECIDED} SELECT (SELECT count(*) FROM d WHERE accepted AND label = 0) AS false_accepts, (SELECT count(*) FROM d WHERE NOT accepted AND label = 1) AS refused, (SELECT count(*) FROM pair_truth t WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.country = t.country AND p.s1 = t.s1 AND p.src = t.src AND p.idx = t.idx)) AS not_candidates", "pairs", "pair_truth"))
def loss_split(spark, sf) -> DataFrame:
    """MT5."""
    return metrics.loss_split(_decided(spark, sf), view(spark, sf, "pair_truth"))


@query("mt06_sanity", with_views(f"{DECIDED}, n AS (SELECT country, s1, count(*) AS n, sum(q) AS sq FROM d WHERE accepted GROUP BY country, s1) SELECT country, round(avg(CASE WHEN n IS NULL THEN 1.0 ELSE 0.0 END), 8) AS share_empty, round(avg(coalesce(n, 0)), 8) AS mean_size, round(sum(sq) / sum(n), 6) AS mean_q FROM ones LEFT JOIN n USING (country, s1) GROUP BY country", "pairs", "ones"))
def sanity(spark, sf) -> DataFrame:
    """MT6 and RP3."""
    return _rounded(_rounded(metrics.sanity(_decided(spark, sf), view(spark, sf, "ones")), "share_empty", "mean_size", to=8), "mean_q")


@query("rp02_decision_report", with_views(f"{DECIDED}, r AS (SELECT *, row_number() OVER (PARTITION BY country, s1, accepted ORDER BY q DESC, src, idx) AS rn FROM d) SELECT {PAIR_SQL}, accepted, round(q, 8) AS q FROM r WHERE accepted OR rn <= 3", "pairs"))
def decision_report(spark, sf) -> DataFrame:
    """RP2: the accepted matches and the three best refused candidates of every first-source record."""
    rank = F.row_number().over(Window.partitionBy("country", "s1", "accepted").orderBy(F.desc("q"), "src", "idx"))
    return _decided(spark, sf).withColumn("rn", rank).filter("accepted or rn <= 3").select(*PAIR, "accepted", F.round("q", 8).alias("q"))


# --- audits ---------------------------------------------------------------------------------------------------------


@query("au01_overlap", with_views("SELECT (SELECT count(*) FROM rec WHERE src = 1) AS n, (SELECT count(*) FROM rec a WHERE src = 1 AND EXISTS (SELECT 1 FROM rec b WHERE b.src = 2 AND b.name_core = a.name_core AND b.state = a.state)) AS n_shared", "rec"))
def overlap(spark, sf) -> DataFrame:
    """AU1."""
    rec = view(spark, sf, "rec")
    return audit.overlap(rec.filter("src = 1"), rec.filter("src = 2"), ["name_core", "state"])


@query("au03_entities", with_views("SELECT r.src, r.idx, coalesce(CAST(t.s1 AS BIGINT), -(CAST(r.src AS BIGINT) * 1099511627776 + r.idx + 1)) AS entity FROM rec r LEFT JOIN (SELECT src, idx, min(s1) AS s1 FROM truth GROUP BY src, idx) t ON t.src = r.src AND t.idx = r.idx WHERE r.src > 1", "rec", "truth"))
def entities(spark, sf) -> DataFrame:
    """AU3: whose each record is; orphans are their own."""
    return audit.with_entities(view(spark, sf, "rec").filter("src > 1").select("src", "idx"), view(spark, sf, "truth")).select("src", "idx", "entity")


@query("au04_linked_misses", with_views(f"{DECIDED}, k AS (SELECT DISTINCT src, idx, name AS key FROM pairs), m AS (SELECT {PAIR_SQL} FROM d WHERE label = 1 AND NOT accepted), a AS (SELECT DISTINCT d.country, d.s1, k.key FROM d JOIN k ON k.src = d.src AND k.idx = d.idx WHERE accepted) SELECT (SELECT count(*) FROM m) AS n_missed, (SELECT count(*) FROM (SELECT DISTINCT m.* FROM m JOIN k ON k.src = m.src AND k.idx = m.idx JOIN a ON a.country = m.country AND a.s1 = m.s1 AND a.key = k.key) x) AS n_linked", "pairs"))
def linked_misses(spark, sf) -> DataFrame:
    """AU4."""
    keys = _pairs(spark, sf).select("src", "idx", F.col("name").alias("key")).distinct()
    return audit.linked_misses(_decided(spark, sf), keys)


def _integrity_sql(c: str) -> str:
    return f"count(*) FILTER ({c} IS NULL) AS {c}_null, count(*) FILTER ({c} = '') AS {c}_empty, count(*) FILTER ({c} <> trim({c})) AS {c}_untrimmed, count(*) FILTER (contains({c}, chr(9))) AS {c}_tab, count(*) FILTER (regexp_matches({c}, '[^\\x00-\\x7F]')) AS {c}_non_ascii, max(length({c})) AS {c}_longest"


@query("ed01_integrity", with_views(f"SELECT count(*) AS n, count(DISTINCT entity_id) AS n_ids, {_integrity_sql('name_raw')}, {_integrity_sql('addr_raw')} FROM raw", "raw"))
def integrity(spark, sf) -> DataFrame:
    """ED1."""
    return audit.integrity(view(spark, sf, "raw"), ["name_raw", "addr_raw"], "entity_id")


@query("ed02_truth_integrity", with_views("k AS (SELECT rec_id, count(DISTINCT s1_id) AS k FROM pred_ids GROUP BY rec_id) SELECT (SELECT count(DISTINCT s1_id) FROM pred_ids) AS n_rows, CAST((SELECT count(*) - count(DISTINCT (s1_id, rec_id)) FROM pred_ids) AS BIGINT) AS n_repeated, (SELECT count(*) FROM pred_ids WHERE rec_id NOT IN (SELECT rec_id FROM true_ids)) AS n_unknown, (SELECT count(*) FILTER (k > 1) FROM k) AS n_claimed_twice", "pred_ids", "true_ids"))
def truth_integrity(spark, sf) -> DataFrame:
    """ED2."""
    truth = view(spark, sf, "pred_ids").groupBy("s1_id").agg(F.collect_list("rec_id").alias("ids"))
    return audit.truth_integrity(truth, view(spark, sf, "true_ids").select(F.col("rec_id").alias("entity_id")))


@query("ed03_country_counts", with_views("SELECT country, count(*) FILTER (src = 1) AS n1, count(*) FILTER (src = 2) AS n2, count(*) FILTER (src = 3) AS n3, round(count(*) FILTER (src > 1) / CAST(nullif(count(*) FILTER (src = 1), 0) AS DOUBLE), 8) AS ratio FROM rec GROUP BY country", "rec"))
def country_counts(spark, sf) -> DataFrame:
    """ED3."""
    return _rounded(audit.country_counts(view(spark, sf, "rec")), "ratio", to=8)


@query("ed04_match_buckets", with_views(f"n AS (SELECT country, s1, count(*) AS n, count(*) FILTER (src = 2) AS k2, count(*) FILTER (src = 3) AS k3 FROM pair_truth GROUP BY country, s1) SELECT {BUCKET.format(n='n')} AS bucket, count(*) AS n_s1, count(*) FILTER (k2 > 1 OR k3 > 1) AS n_same_source FROM n GROUP BY 1", "pairs", "pair_truth"))
def match_buckets(spark, sf) -> DataFrame:
    """ED4."""
    return audit.match_buckets(view(spark, sf, "pair_truth"))


@query("ed05_one_home", with_views("SELECT src, idx, count(DISTINCT s1) AS n_homes FROM pair_truth GROUP BY src, idx HAVING count(DISTINCT s1) > 1", "pairs", "pair_truth"))
def one_home(spark, sf) -> DataFrame:
    """ED5: records that the truth gives to several."""
    return audit.one_home_violations(view(spark, sf, "pair_truth"))


@query("ed05_country_matrix", with_views("SELECT s.country AS s_country, r.country AS r_country, count(*) AS n FROM truth t JOIN rec s ON s.src = 1 AND s.idx = t.s1 JOIN rec r ON r.src = t.src AND r.idx = t.idx GROUP BY 1, 2", "rec", "truth"))
def country_matrix(spark, sf) -> DataFrame:
    """ED5: countries on both sides."""
    return audit.country_matrix(view(spark, sf, "truth"), view(spark, sf, "rec"))


@query("ed06_orphans", with_views("SELECT country, src, count(*) AS n, count(*) FILTER (NOT m) AS n_orphans, round(count(*) FILTER (NOT m) / CAST(count(*) AS DOUBLE), 8) AS rate FROM (SELECT country, src, EXISTS (SELECT 1 FROM truth t WHERE t.src = rec.src AND t.idx = rec.idx) AS m FROM rec WHERE src > 1) x GROUP BY country, src", "rec", "truth"))
def orphans(spark, sf) -> DataFrame:
    """ED6."""
    return _rounded(audit.orphans(view(spark, sf, "rec"), view(spark, sf, "truth")), "rate", to=8)


def _rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("ed07_rank_correlation", with_views(f"r AS (SELECT {_rank('s1')} AS a, {_rank('idx')} AS b FROM truth) SELECT round(corr(a, b), 6) AS rho FROM r", "truth"))
def rank_correlation(spark, sf) -> DataFrame:
    """ED7."""
    return _rounded(audit.spearman(view(spark, sf, "truth"), "s1", "idx"), "rho")


TRUE_NAMES = "tn AS (SELECT t.country, s.name_core AS a, r.name_core AS b, s.house_num AS sh, r.house_num AS rh FROM truth t JOIN rec s ON s.src = 1 AND s.country = t.country AND s.idx = t.s1 JOIN rec r ON r.country = t.country AND r.src = t.src AND r.idx = t.idx)"


def _true_names(spark, sf) -> DataFrame:
    rec = view(spark, sf, "rec")
    s = rec.filter("src = 1").select("country", F.col("idx").alias("s1"), F.col("name_core").alias("a"), F.col("house_num").alias("sh"))
    r = rec.filter("src > 1").select("country", "src", "idx", F.col("name_core").alias("b"), F.col("house_num").alias("rh"))
    return view(spark, sf, "truth").join(s, ["country", "s1"]).join(r, ["country", "src", "idx"])


@query("ed08_true_pairs", with_views(f"{TRUE_NAMES} SELECT country, count(*) AS n, count(*) FILTER (a = b) AS n_equal, count(*) FILTER (sh = rh) AS n_house, round(quantile_cont(len(list_intersect(string_split(a, ' '), string_split(b, ' '))), 0.5), 6) AS shared_p50 FROM tn GROUP BY country", "rec", "truth"))
def true_pairs(spark, sf) -> DataFrame:
    """ED8."""
    shared = F.size(F.array_intersect(F.split("a", " "), F.split("b", " ")))
    return _true_names(spark, sf).groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("n_equal"), F.count_if(F.col("sh") == F.col("rh")).alias("n_house"), F.round(F.percentile(shared, 0.5), 6).alias("shared_p50"))


@query(
    "ed09_substitutions",
    with_views(
        f"{TRUE_NAMES}, x AS (SELECT country, 's' AS side, unnest([t for t in list_distinct(string_split(a, ' ')) if NOT list_contains(string_split(b, ' '), t)]) AS tok FROM tn UNION ALL SELECT country, 'r', unnest([t for t in list_distinct(string_split(b, ' ')) if NOT list_contains(string_split(a, ' '), t)]) FROM tn), c AS (SELECT country, side, tok, count(*) AS n FROM x GROUP BY ALL) SELECT country, side, tok, n FROM (SELECT *, row_number() OVER (PARTITION BY country, side ORDER BY n DESC, tok) AS rn FROM c) y WHERE rn <= 25",
        "rec",
        "truth",
    ),
)
def substitutions(spark, sf) -> DataFrame:
    """ED9."""
    return audit.substitutions(_true_names(spark, sf), "a", "b")


@query("ed10_collisions", with_views("SELECT country, name_core AS value, count(*) AS n FROM rec WHERE src = 1 GROUP BY country, name_core HAVING count(*) > 1", "rec"))
def collisions(spark, sf) -> DataFrame:
    """ED10."""
    return audit.collisions(view(spark, sf, "rec"), "name_core")


@query("ed11_hard_negatives", with_views("f AS (SELECT country, p_name, count(*) FILTER (src = 1) AS a, count(*) FILTER (src > 1) AS b FROM rec GROUP BY country, p_name), n AS (SELECT country, CAST(sum(a * b) AS BIGINT) AS n_pairs FROM f GROUP BY country), t AS (SELECT country, count(*) AS n_true FROM truth GROUP BY country) SELECT n.country, n_pairs, coalesce(n_true, 0) AS n_true, round(coalesce(n_true, 0) / CAST(n_pairs AS DOUBLE), 8) AS precision FROM n LEFT JOIN t ON t.country = n.country", "rec", "truth"))
def hard_negatives(spark, sf) -> DataFrame:
    """ED11."""
    return _rounded(audit.hard_negatives(view(spark, sf, "rec"), view(spark, sf, "truth"), "p_name"), "precision", to=8)


@query(
    "vl01_validated_lists",
    with_views(
        "r AS (SELECT l.idx, l.s1_id, CASE WHEN l.idx % 7 = 0 THEN string_agg(p.rec_id, ', ' ORDER BY p.rec_id) ELSE string_agg(p.rec_id, ',' ORDER BY p.rec_id) END AS ids FROM lists l LEFT JOIN pred_ids p ON p.s1_id = l.s1_id WHERE l.idx % 11 <> 0 GROUP BY l.idx, l.s1_id), u AS (SELECT s1_id, unnest(string_split(ids, ',')) AS id FROM r WHERE ids IS NOT NULL) SELECT 'wrong prefix' AS rule, (SELECT count(*) FROM u WHERE NOT regexp_matches(id, '^S[123]-')) AS n UNION ALL SELECT 'missing row', (SELECT count(*) FROM lists WHERE idx % 11 = 0) UNION ALL SELECT 'unknown id', (SELECT count(*) FROM u WHERE id NOT IN (SELECT rec_id FROM true_ids)) UNION ALL SELECT x, 0 FROM (VALUES ('header without one tab'), ('wrong header'), ('row without one tab'), ('repeated row'), ('repeated id'), ('first-source id'), ('extra row')) t(x)",
        *LISTED,
    ),
)
def validated_lists(spark, sf) -> DataFrame:
    """VL1 on lists with blanks after commas, missing rows and unknown ids."""
    lists, pred = view(spark, sf, "lists"), view(spark, sf, "pred_ids").groupBy("s1_id").agg(F.array_sort(F.collect_list("rec_id")).alias("ids"))
    joined = F.when(F.col("idx") % 7 == 0, F.array_join("ids", ", ")).otherwise(F.array_join("ids", ","))
    rows = lists.filter(F.col("idx") % 11 != 0).join(pred, "s1_id", "left").select((F.col("idx") + 1).cast("long").alias("line"), F.concat(F.col("s1_id"), F.lit("\t"), F.coalesce(joined, F.lit(""))).alias("value"))
    head = spark.createDataFrame([(0, "source1_entity_id\tmatched_entity_ids")], "line long, value string")
    return audit.validate(head.unionByName(rows), lists, view(spark, sf, "true_ids").select(F.col("rec_id").alias("id")))


COMPONENTS = "cp AS (SELECT country, src, idx, state, p_name || CASE WHEN house_num IS NULL THEN '' ELSE ' ' || translate(house_num, '0123456789', 'abcdefghij') END AS component FROM rec)"


@query("rg01_region_cities", with_views(f"{COMPONENTS} SELECT component AS city, min(state) AS region FROM cp WHERE state <> '' GROUP BY component HAVING count(*) >= 2 AND count(DISTINCT state) = 1", "rec"))
def region_cities(spark, sf) -> DataFrame:
    """RG1, on names with their house numbers' letters as components."""
    component = F.concat_ws(" ", "p_name", F.translate("house_num", "0123456789", "abcdefghij"))
    return audit.region_cities(view(spark, sf, "rec").select(component.alias("component"), F.col("state").alias("region")), 2)


@query(
    "rg02_found_regions",
    with_views("ct AS (SELECT p_brand AS city, min(p_brand) AS region FROM rec GROUP BY p_brand) SELECT country, src, idx, coalesce(ct.region, '') AS region_found FROM rec LEFT JOIN ct ON ct.city = rec.p_brand", "rec"),
)
def found_regions(spark, sf) -> DataFrame:
    """RG2: whole components."""
    rec = view(spark, sf, "rec")
    cities = rec.select(F.col("p_brand").alias("city"), F.col("p_brand").alias("region")).distinct()
    return audit.find_region(rec.select("country", "src", "idx", F.array("p_brand").alias("components")), cities).select("country", "src", "idx", "region_found")


# --- learning -------------------------------------------------------------------------------------------------------


def _scored(spark, sf) -> DataFrame:
    return learning.pruner_ranks(blocking.with_ranks(_pairs(spark, sf).withColumn("pscore", F.col("p"))))


PRANKS = f"rk AS (SELECT {PAIR_SQL}, p AS pscore, score, label, row_number() OVER (PARTITION BY country, s1 ORDER BY p DESC, src, idx) AS ps, row_number() OVER (PARTITION BY country, src, idx ORDER BY p DESC, s1) AS pr FROM pairs)"
RERANK = "row_number() OVER (PARTITION BY country, s1 ORDER BY score DESC, src, idx) AS rank_s, row_number() OVER (PARTITION BY country, src, idx ORDER BY score DESC, s1) AS rank_r, row_number() OVER (PARTITION BY country, s1 ORDER BY pscore DESC, src, idx) AS prank_s, row_number() OVER (PARTITION BY country, src, idx ORDER BY pscore DESC, s1) AS prank_r, count(*) OVER (PARTITION BY country, s1) AS n_cand_s1, count(*) OVER (PARTITION BY country, src, idx) AS n_cand_rec"
RERANKED = [*PAIR, "rank_s", "rank_r", "prank_s", "prank_r", "n_cand_s1", "n_cand_rec"]


@query("pr06_learned_prune", with_views(f"{PRANKS}, kept AS (SELECT * FROM rk WHERE pr <= 2 OR ps <= 10) SELECT {PAIR_SQL}, {RERANK} FROM kept", "pairs"))
def learned_prune(spark, sf) -> DataFrame:
    """PR4 and PR6."""
    return learning.pruned(_scored(spark, sf), 2, 10).select(*RERANKED)


@query("sl01_slim", with_views(f"{PRANKS}, kept AS (SELECT * FROM rk WHERE pscore >= 0.3 AND ps <= 15 AND pr <= 3) SELECT {PAIR_SQL}, {RERANK} FROM kept", "pairs"))
def slim(spark, sf) -> DataFrame:
    """SL1, at a tau that cuts this data."""
    return learning.slim(_scored(spark, sf), 0.3).select(*RERANKED)


TAUS = "(VALUES (0.1), (0.3), (0.5), (0.7), (0.9))"


@query(
    "sl02_slim_curve",
    with_views(
        f"{PRANKS}, {SIZES}, g(tau) AS (SELECT * FROM {TAUS}), h AS (SELECT g.tau, country, s1, count(*) AS n, sum(label) AS tp FROM rk JOIN g ON pscore >= g.tau AND ps <= 15 AND pr <= 3 GROUP BY g.tau, country, s1), r AS (SELECT CAST(g.tau AS DOUBLE) AS tau, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_pairs, avg(coalesce(n, 0)) AS mean_cand, avg({F05.format(p='coalesce(tp, 0)', t='t', tp='tp')}) AS oracle FROM sizes CROSS JOIN g LEFT JOIN h ON h.tau = g.tau AND h.country = sizes.country AND h.s1 = sizes.s1 GROUP BY g.tau) SELECT tau, n_pairs, round(mean_cand, 6) AS mean_cand, round(oracle, 8) AS oracle, row_number() OVER (ORDER BY CASE WHEN oracle >= (SELECT max(oracle) FROM r) - 0.0007 THEN 0 ELSE 1 END, n_pairs, tau DESC) = 1 AS chosen FROM r",
        "pairs",
        "ones",
        "pair_truth",
    ),
)
def slim_curve(spark, sf) -> DataFrame:
    """SL2 and PR5, in one pass."""
    return _rounded(_rounded(learning.slim_curve(_scored(spark, sf), _sizes(spark, sf), (0.1, 0.3, 0.5, 0.7, 0.9)), "mean_cand"), "oracle", to=8)


@query("ml06_calibration_table", with_views("SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(label), 6) AS rate, round(abs(avg(p) - avg(label)), 6) AS gap FROM pairs GROUP BY 1", "pairs"))
def calibration_table(spark, sf) -> DataFrame:
    """ML6."""
    return _rounded(learning.calibration_table(_pairs(spark, sf)), "mean_p", "rate", "gap")


@query("ml08_log_loss", with_views("SELECT country, count(*) AS n, round(avg(CASE WHEN label = 1 THEN -ln(least(greatest(p, 1e-7), 1 - 1e-7)) ELSE -ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)) END), 6) AS logloss FROM pairs GROUP BY country", "pairs"))
def log_loss(spark, sf) -> DataFrame:
    """ML8."""
    return _rounded(learning.log_loss(_pairs(spark, sf), ["country"]), "logloss")


LEARNED = ["score", "sim_name", "sim_addr", "nkeys", "bits"]


@query("ml04_out_of_fold")
def out_of_fold(spark, sf) -> DataFrame:
    """ML1 to ML5: halves by CRC-32, a boosted model for each, predictions of the other half."""
    ids = view(spark, sf, "ones").withColumn("entity_id", F.concat_ws("-", "country", F.col("s1").cast("string")))
    rows, cols = learning.filled(learning.folds(_pairs(spark, sf).withColumn("label", F.col("label").cast("int")), ids), LEARNED, [])
    found, _ = learning.out_of_fold(rows.drop("p"), cols, rounds=4, depth=3)
    return found.select(*PAIR, "label", "fold", "model", "p")


@query("pr03_pruner_scores")
def pruner_scores(spark, sf) -> DataFrame:
    """PR1 to PR4: a model of a sample of first-source records scores every pair."""
    rows, cols = learning.filled(blocking.with_counts(blocking.with_ranks(_pairs(spark, sf))).withColumn("label", F.col("label").cast("int")), [*LEARNED, "rank_s", "rank_r", "n_cand_s1", "n_cand_rec"], [])
    model = learning.train_trees(learning.pruner_sample(rows, 0.2), cols, 4, 3)
    return learning.pruner_ranks(learning.predict(model, rows, "pscore")).select(*PAIR, "pscore", "prank_s", "prank_r")


@query("ml07_calibrated")
def calibrated(spark, sf) -> DataFrame:
    """ML7: isotonic where the table's worst gap asks for it."""
    return learning.calibrate(_pairs(spark, sf).withColumn("p", F.col("p").cast("float")))[0].select(*PAIR, "p")


@query("ml09_leave_country_out")
def leave_country_out(spark, sf) -> DataFrame:
    """ML9."""
    rows, cols = learning.filled(_pairs(spark, sf).drop("p").withColumn("label", F.col("label").cast("int")), LEARNED, [])
    return learning.leave_country_out(rows, cols, "F", "O", 3).select(*PAIR, "p")


@query(
    "pr08_recovery",
    with_views(
        "o AS (SELECT country, s1, src, idx FROM pairs WHERE p >= 0.5), n AS (SELECT country, s1, src, idx FROM pairs WHERE score >= 100), t AS (SELECT p.country, p.s1, p.src, p.idx, addr = '' AS addr_empty FROM pairs p WHERE label = 1) SELECT t.country, addr_empty, count(*) AS n_true, count(o.s1) AS in_old, count(n.s1) AS in_new, count(*) FILTER (n.s1 IS NOT NULL AND o.s1 IS NULL) AS recovered, count(*) FILTER (o.s1 IS NOT NULL AND n.s1 IS NULL) AS lost FROM t LEFT JOIN o ON o.country = t.country AND o.s1 = t.s1 AND o.src = t.src AND o.idx = t.idx LEFT JOIN n ON n.country = t.country AND n.s1 = t.s1 AND n.src = t.src AND n.idx = t.idx GROUP BY t.country, addr_empty",
        "pairs",
    ),
)
def recovery(spark, sf) -> DataFrame:
    """PR8, between candidates by p and by score."""
    rows = _pairs(spark, sf)
    flags = rows.select("country", "src", "idx", (F.col("addr") == "").alias("addr_empty")).distinct()
    return learning.recovery(rows.filter("label = 1").select(*PAIR), rows.filter("p >= 0.5"), rows.filter("score >= 100"), flags, "addr_empty")


@query("tl02_probe", with_views(f"{DECIDED} SELECT country, count(*) FILTER (accepted AND country <> 'O') AS n_accepted FROM d GROUP BY country", "pairs"))
def probe(spark, sf) -> DataFrame:
    """TL2: a country's matches taken back."""
    return metrics.probe(_decided(spark, sf), ["O"]).groupBy("country").agg(F.count_if("accepted").alias("n_accepted"))


@query(
    "rg03_refilled_states",
    with_views(
        f"{BLOCKED}, near AS ({NEAR}) SELECT near.country, near.s1, near.src, near.idx, CASE WHEN ss = '' OR rs = '' THEN -1 WHEN ss = rs THEN 1 ELSE 0 END AS state_match FROM (SELECT near.*, CASE WHEN near.country = 'US' AND a.state = '' THEN 'ny' ELSE a.state END AS ss, CASE WHEN near.country = 'US' AND b.state = '' THEN 'ny' ELSE b.state END AS rs FROM near JOIN rec a ON a.src = 1 AND a.country = near.country AND a.idx = near.s1 JOIN rec b ON b.country = near.country AND b.src = near.src AND b.idx = near.idx) near",
        "rec",
    ),
)
def refilled_states(spark, sf) -> DataFrame:
    """RG3: one country's empty states filled, everything else as it was."""
    rec = view(spark, sf, "rec")
    s = rec.filter("src = 1").select("country", F.col("idx").alias("s1"), F.col("state").alias("s_state"))
    r = rec.filter("src > 1").select("country", "src", "idx", F.col("state").alias("r_state"))
    rows = _near(spark, sf).join(s, ["country", "s1"]).join(r, ["country", "src", "idx"])
    rows = rows.withColumn("state_match", features.state_match(F.col("s_state"), F.col("r_state")))
    found = rec.select("country", "src", "idx", F.lit("ny").alias("region_found"))
    return audit.refilled_states(rows, found, "US").select(*PAIR, "state_match")


@query("ed13_before_after", with_views("SELECT t.country, count(*) AS n, count(*) FILTER (s.name_raw = r.name_raw) AS equal_before, count(*) FILTER (x.p_name = y.p_name) AS equal_after FROM truth t JOIN raw s ON s.src = 1 AND s.idx = t.s1 JOIN raw r ON r.src = t.src AND r.idx = t.idx JOIN rec x ON x.src = 1 AND x.idx = t.s1 JOIN rec y ON y.src = t.src AND y.idx = t.idx GROUP BY t.country", "raw", "rec", "truth"))
def before_after(spark, sf) -> DataFrame:
    """ED13."""
    raw, rec = view(spark, sf, "raw"), view(spark, sf, "rec")
    names = raw.select("src", "idx", "name_raw").join(rec.select("src", "idx", "p_name"), ["src", "idx"])
    s = names.filter("src = 1").select(F.col("idx").alias("s1"), F.col("name_raw").alias("a"), F.col("p_name").alias("c"))
    r = names.filter("src > 1").select("src", "idx", F.col("name_raw").alias("b"), F.col("p_name").alias("d"))
    return audit.before_after(view(spark, sf, "truth").join(s, "s1").join(r, ["src", "idx"]), ("a", "b"), ("c", "d"))


NATIVE = "translate({x}, 'abcdefghijklmnoprstuvwy', 'अबचदएफगहइजकलमनओपरसतउववय')"


@query(
    "tr08_learned_tokens",
    with_views(
        f"v AS (SELECT unnest(string_split({NATIVE.format(x='p_name')}, ' ')) AS key, unnest(string_split(p_name, ' ')) AS value FROM rec), c AS (SELECT key, value, count(*) AS n FROM v GROUP BY key, value), r AS (SELECT *, sum(n) OVER (PARTITION BY key) AS total, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS rn FROM c) SELECT key, value, n FROM r WHERE rn = 1 AND n >= 3 AND n / CAST(total AS DOUBLE) >= 0.6",
        "rec",
    ),
)
def learned_tokens(spark, sf) -> DataFrame:
    """TR6 to TR8 on names in native letters beside their Latin forms."""
    from ..operators import translit_learn

    return translit_learn.learn_tokens(view(spark, sf, "rec").select(F.expr(NATIVE.format(x="p_name")).alias("noisy"), F.col("p_name").alias("s1")))
