"""Queries over blocking, with oracles that join where Spark explodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import blocking
from .text_queries import PHON, SIMS, query
from .views import view, with_views

KEYS = ["country", "src", "idx"]

#: rec with the phonetic name, as both engines make it
PHON_REC = f"""toks AS (SELECT DISTINCT unnest(string_split(name_core || ' ' || name_alt, ' ')) AS t FROM rec), {PHON},
ph AS (SELECT src, idx, string_agg(phons.ph, ' ' ORDER BY i) AS name_phon FROM (SELECT src, idx, unnest(string_split(name_core, ' ')) AS t, generate_subscripts(string_split(name_core, ' '), 1) AS i FROM rec) u JOIN phons USING (t) GROUP BY src, idx),
r AS (SELECT rec.*, ph.name_phon FROM rec JOIN ph ON ph.src = rec.src AND ph.idx = rec.idx)"""


def _ranked(n: str, source: str, freq: str) -> str:
    return f"{n} AS (SELECT t.country, t.src, t.idx, t.tok, f.df, f.s1df, row_number() OVER (PARTITION BY t.country, t.src, t.idx ORDER BY f.df, t.tok) AS rn, count(*) OVER (PARTITION BY t.country, t.src, t.idx) AS cnt FROM {source} t JOIN {freq} f ON f.country = t.country AND f.tok = t.tok WHERE t.src = 1 OR f.s1df > 0)"


def _freq(n: str, source: str) -> str:
    return f"{n} AS (SELECT country, tok, count(*) AS df, count(*) FILTER (src = 1) AS s1df FROM {source} GROUP BY country, tok)"


def _pairs(ranked: str, k: int, family: str) -> str:
    return f"""SELECT a.country, a.src, a.idx, '{family}|' || least(a.tok, b.tok) || '|' || greatest(a.tok, b.tok) AS h FROM {ranked} a JOIN {ranked} b ON a.country = b.country AND a.src = b.src AND a.idx = b.idx AND a.rn < b.rn AND b.rn <= {k}
UNION ALL SELECT country, src, idx, '{family}|' || tok FROM {ranked} WHERE cnt = 1"""


TOKENS = f"""{PHON_REC},
nt AS (SELECT DISTINCT country, src, idx, unnest(string_split(name_core, ' ')) AS tok FROM r),
pt AS (SELECT DISTINCT nt.country, nt.src, nt.idx, phons.ph AS tok FROM nt JOIN phons ON phons.t = nt.tok),
adt AS (SELECT DISTINCT country, src, idx, tok FROM (SELECT country, src, idx, unnest(string_split(addr_core, ' ')) AS tok FROM r WHERE addr_core <> '') x WHERE NOT regexp_matches(tok, '[0-9]')),
lt AS (SELECT DISTINCT country, src, idx, unnest(string_split(name_alt, ' ')) AS tok FROM r WHERE name_alt <> ''),
lp AS (SELECT DISTINCT lt.country, lt.src, lt.idx, phons.ph AS tok FROM lt JOIN phons ON phons.t = lt.tok),
{_freq('nf', 'nt')}, {_freq('pf', 'pt')}, {_freq('af', 'adt')},
{_ranked('nr', 'nt', 'nf')}, {_ranked('pr', 'pt', 'pf')}, {_ranked('ar', 'adt', 'af')}, {_ranked('lr', 'lt', 'nf')}, {_ranked('lpr', 'lp', 'pf')}"""

KEY_SQL = f"""{TOKENS},
k AS (SELECT DISTINCT country, src, idx, h, kt FROM (
SELECT country, src, idx, h, 0 AS kt FROM ({_pairs('nr', 3, 'N')}) x
UNION ALL SELECT country, src, idx, 'S|' || tok, 1 FROM nr WHERE rn <= 2 AND s1df <= 50
UNION ALL SELECT country, src, idx, h, 2 FROM ({_pairs('pr', 2, 'P')}) x
UNION ALL SELECT country, src, idx, 'C|' || substr(name_concat, 1, 8), 3 FROM r WHERE length(name_concat) >= 6
UNION ALL SELECT country, src, idx, h, 4 FROM ({_pairs('lr', 3, 'N')}) x
UNION ALL SELECT country, src, idx, 'S|' || tok, 4 FROM lr WHERE rn <= 2 AND s1df <= 50
UNION ALL SELECT country, src, idx, h, 4 FROM ({_pairs('lpr', 2, 'P')}) x
UNION ALL SELECT country, src, idx, 'C|' || substr(replace(name_alt, ' ', ''), 1, 8), 4 FROM r WHERE length(replace(name_alt, ' ', '')) >= 6
UNION ALL SELECT country, src, idx, h, 5 FROM ({_pairs('ar', 3, 'A')}) x
UNION ALL SELECT ar.country, ar.src, ar.idx, 'H|' || r.house_num || '|' || ar.tok, 6 FROM ar JOIN r ON r.country = ar.country AND r.src = ar.src AND r.idx = ar.idx WHERE ar.rn = 1 AND r.house_num IS NOT NULL
UNION ALL SELECT nr.country, nr.src, nr.idx, 'X|' || nr.tok || '|' || ar.tok, 7 FROM nr JOIN ar ON ar.country = nr.country AND ar.src = nr.src AND ar.idx = nr.idx WHERE nr.rn = 1 AND ar.rn = 1) u)"""

BLOCK_SQL = f"""{KEY_SQL},
b AS (SELECT country, h, count(DISTINCT CASE WHEN src = 1 THEN idx END) AS n1, count(DISTINCT CASE WHEN src > 1 THEN src * 10000000 + idx END) AS nr FROM k GROUP BY country, h)"""

PAIR_SQL = f"""{BLOCK_SQL},
kk AS (SELECT k.* FROM k JOIN b ON b.country = k.country AND b.h = k.h WHERE n1 > 0 AND nr > 0 AND n1 * nr <= 20000),
ps AS (SELECT s.country, s.idx AS s1, o.src, o.idx, CAST(bit_or(1 << o.kt) AS SMALLINT) AS bits, CAST(count(DISTINCT o.h) AS SMALLINT) AS nkeys FROM (SELECT DISTINCT country, idx, h FROM kk WHERE src = 1) s JOIN kk o ON o.country = s.country AND o.h = s.h AND o.src > 1 GROUP BY s.country, s.idx, o.src, o.idx)"""


def records(spark, sf) -> DataFrame:
    rec = view(spark, sf, "rec")
    return rec.withColumn("name_phon", F.array_join(F.transform(text.tokens(F.col("name_core")), text.phon), " "))


@query("bk03_token_frequency", with_views(f"{TOKENS} SELECT 'name' AS field, country, tok, df, s1df FROM nf UNION ALL SELECT 'phon', country, tok, df, s1df FROM pf UNION ALL SELECT 'addr', country, tok, df, s1df FROM af", "rec"))
def token_frequency(spark, sf) -> DataFrame:
    """BK1 to BK3: tokens of names, phonetic keys and addresses with their frequencies."""
    rec = records(spark, sf)
    toks = blocking.name_tokens(rec)
    parts = {"name": blocking.frequency(toks), "phon": blocking.frequency(toks, "ph"), "addr": blocking.frequency(blocking.address_tokens(rec))}
    rows = [df.select(F.lit(n).alias("field"), "country", "tok", "df", "s1df") for n, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("bk04_ranked_tokens", with_views(f"{TOKENS} SELECT country, src, idx, tok, rn, cnt FROM nr", "rec"))
def ranked_tokens(spark, sf) -> DataFrame:
    """BK4: eligibility, then the rarest first."""
    toks = blocking.name_tokens(records(spark, sf)).select(*KEYS, "tok").distinct()
    return blocking.ranked(toks, blocking.frequency(toks)).select(*KEYS, "tok", "rn", "cnt")


@query("bk12_blocking_keys", with_views(f"{KEY_SQL} SELECT country, src, idx, h, CAST(kt AS TINYINT) AS kt FROM k", "rec"))
def blocking_keys(spark, sf) -> DataFrame:
    """BK5 to BK12: all eight families."""
    return blocking.keys(records(spark, sf))


@query("bk13_blocks", with_views(f"{BLOCK_SQL} SELECT country, h, n1, nr FROM b", "rec"))
def blocks(spark, sf) -> DataFrame:
    """BK13."""
    return blocking.blocks(blocking.keys(records(spark, sf)))


def _pairs_of(spark, sf) -> DataFrame:
    keys = blocking.keys(records(spark, sf))
    return blocking.candidate_pairs(keys, blocking.blocks(keys))


@query("bk15_candidate_pairs", with_views(f"{PAIR_SQL} SELECT country, s1, src, idx, bits, nkeys FROM ps", "rec"))
def candidate_pairs(spark, sf) -> DataFrame:
    """BK14 and BK15: the block join without oversized blocks."""
    return _pairs_of(spark, sf)


@query("bk16_key_stats", with_views(f"{BLOCK_SQL}, kb AS (SELECT DISTINCT k.country, k.h, k.kt, n1, nr FROM k JOIN b ON b.country = k.country AND b.h = k.h WHERE n1 > 0 AND nr > 0) SELECT CAST(kt AS TINYINT) AS kt, count(*) AS n_blocks, count(*) FILTER (n1 * nr > 2000) AS n_skipped, CAST(sum(CASE WHEN n1 * nr > 2000 THEN 0 ELSE n1 * nr END) AS BIGINT) AS raw_pairs FROM kb GROUP BY kt", "rec"))
def key_stats(spark, sf) -> DataFrame:
    """BK16, at a bound that this data reaches."""
    keys = blocking.keys(records(spark, sf))
    return blocking.key_stats(keys, blocking.blocks(keys), 2000)


@query(
    "bk17_lost_recall",
    with_views(
        f"{BLOCK_SQL}, s AS (SELECT DISTINCT country, idx AS s1, h FROM k WHERE src = 1), m AS (SELECT t.country, t.s1, t.src, t.idx, max(CASE WHEN n1 * nr <= 2000 THEN 1 ELSE 0 END) AS ok FROM truth t JOIN k ON k.country = t.country AND k.src = t.src AND k.idx = t.idx JOIN s ON s.country = t.country AND s.s1 = t.s1 AND s.h = k.h JOIN b ON b.country = t.country AND b.h = k.h GROUP BY ALL) SELECT count(*) AS n_true, count(ok) AS n_any_key, count(*) FILTER (ok = 1) AS n_usable FROM truth t LEFT JOIN m ON m.country = t.country AND m.s1 = t.s1 AND m.src = t.src AND m.idx = t.idx",
        "rec",
        "truth",
    ),
)
def lost_recall(spark, sf) -> DataFrame:
    """BK17."""
    keys = blocking.keys(records(spark, sf))
    # the truth is all pairs of one name and brand
    return blocking.lost_recall_of_groups(keys, blocking.blocks(keys), view(spark, sf, "rec"), ["p_name", "p_brand"], 2000)


QUICK = f"""{PAIR_SQL}, nx AS (SELECT ps.*, a.name_core AS sn, b.name_core AS rn, b.name_alt AS ra, a.name_phon AS sp, b.name_phon AS rp, a.addr_core AS sa, b.addr_core AS rd FROM ps JOIN r a ON a.src = 1 AND a.country = ps.country AND a.idx = ps.s1 JOIN r b ON b.country = ps.country AND b.src = ps.src AND b.idx = ps.idx),
tp AS (SELECT sn AS a, rn AS b FROM nx UNION SELECT sn, ra FROM nx UNION SELECT sp, rp FROM nx UNION SELECT sa, rd FROM nx), {SIMS}"""


@query(
    "bk18_quick_scores",
    with_views(f"{QUICK} SELECT country, s1, src, idx, bits, nkeys, greatest(n.tset, CASE WHEN ra <> '' THEN l.tset ELSE 0 END, p.tset) AS sim_name, d.tset AS sim_addr FROM nx JOIN ts n ON n.a = sn AND n.b = rn JOIN ts l ON l.a = sn AND l.b = ra JOIN ts p ON p.a = sp AND p.b = rp JOIN ts d ON d.a = sa AND d.b = rd", "rec"),
)
def quick_scores(spark, sf) -> DataFrame:
    """BK18 on blocked pairs."""
    rows = blocking.quick_scores(_pairs_of(spark, sf), records(spark, sf))
    return rows.withColumns({c: F.round(F.col(c).cast("double"), 3) for c in ("sim_name", "sim_addr")}).drop("score")


RANKS = "SELECT country, s1, src, idx, score, label, row_number() OVER (PARTITION BY country, s1 ORDER BY score DESC, src, idx) AS rank_s, row_number() OVER (PARTITION BY country, src, idx ORDER BY score DESC, s1) AS rank_r FROM pairs"


@query("bk19_ranks", with_views(f"rk AS ({RANKS}) SELECT country, s1, src, idx, rank_s, rank_r FROM rk", "pairs"))
def ranks(spark, sf) -> DataFrame:
    """BK19."""
    return blocking.with_ranks(view(spark, sf, "pairs")).select("country", "s1", "src", "idx", "rank_s", "rank_r")


@query(
    "bk20_pruned_pairs",
    with_views(
        f"rk AS ({RANKS}), kept AS (SELECT * FROM rk WHERE rank_r <= 2 OR rank_s <= 10) SELECT country, s1, src, idx, rank_s AS rank_s_all, rank_r AS rank_r_all, row_number() OVER (PARTITION BY country, s1 ORDER BY score DESC, src, idx) AS rank_s, row_number() OVER (PARTITION BY country, src, idx ORDER BY score DESC, s1) AS rank_r, count(*) OVER (PARTITION BY country, s1) AS n_cand_s1, count(*) OVER (PARTITION BY country, src, idx) AS n_cand_rec FROM kept",
        "pairs",
    ),
)
def pruned_pairs(spark, sf) -> DataFrame:
    """BK20."""
    return blocking.prune(blocking.with_ranks(view(spark, sf, "pairs")), 2, 10).select("country", "s1", "src", "idx", "rank_s_all", "rank_r_all", "rank_s", "rank_r", "n_cand_s1", "n_cand_rec")


F05 = "CASE WHEN {p} = 0 AND {t} = 0 THEN 1.0 WHEN {p} = 0 OR {t} = 0 THEN 0.0 ELSE 1.25 * {tp} / ({p} + 0.25 * {t}) END"
CELLS = "(VALUES " + ", ".join(f"({k}, {b})" for k in blocking.GRID_K for b in blocking.GRID_BIG_K) + ")"


@query(
    "bk21_tuning_grid",
    with_views(
        f"""rk AS ({RANKS}), cells(k, big_k) AS (SELECT * FROM {CELLS}), t AS (SELECT country, s1, count(*) AS t FROM pair_truth GROUP BY country, s1),
h AS (SELECT k, big_k, country, s1, count(*) AS n, sum(label) AS tp FROM rk JOIN cells ON rank_r <= k OR rank_s <= big_k GROUP BY k, big_k, country, s1),
g AS (SELECT k, big_k, country, s1, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp, coalesce(t, 0) AS t FROM ones CROSS JOIN cells LEFT JOIN t USING (country, s1) LEFT JOIN h USING (k, big_k, country, s1)),
r AS (SELECT k, big_k, CAST(sum(n) AS BIGINT) AS n_pairs, avg({F05.format(p='tp', t='t', tp='tp')}) AS oracle FROM g GROUP BY k, big_k)
SELECT CAST(k AS INT) AS k, CAST(big_k AS INT) AS big_k, n_pairs, round(oracle, 8) AS oracle, row_number() OVER (ORDER BY CASE WHEN oracle >= (SELECT max(oracle) FROM r) - 0.002 THEN 0 ELSE 1 END, n_pairs, k, big_k) = 1 AS chosen FROM r""",
        "pairs",
        "ones",
        "pair_truth",
    ),
)
def tuning_grid(spark, sf) -> DataFrame:
    """BK21 to BK23: the grid in one pass."""
    pairs = blocking.with_ranks(view(spark, sf, "pairs"))
    return blocking.tune(pairs, view(spark, sf, "pair_truth"), view(spark, sf, "ones")).withColumn("oracle", F.round("oracle", 8))


@query("bk22_marked_pairs", with_views("SELECT p.country, p.s1, p.src, p.idx, CAST(CASE WHEN t.s1 IS NULL THEN 0 ELSE 1 END AS TINYINT) AS label FROM pairs p LEFT JOIN (SELECT DISTINCT * FROM pair_truth) t ON t.country = p.country AND t.s1 = p.s1 AND t.src = p.src AND t.idx = p.idx", "pairs", "pair_truth"))
def marked_pairs(spark, sf) -> DataFrame:
    """BK22 and FE26."""
    return blocking.marked(view(spark, sf, "pairs").drop("label"), view(spark, sf, "pair_truth")).select("country", "s1", "src", "idx", "label")


@query("bk24_countries", with_views("SELECT DISTINCT country FROM rec WHERE src = 1", "rec"))
def countries(spark, sf) -> DataFrame:
    """BK24."""
    return blocking.countries(view(spark, sf, "rec"))


@query("bk25_candidate_report", with_views("n AS (SELECT country, s1, count(*) AS n FROM pairs GROUP BY country, s1) SELECT country, count(*) AS n_s1, round(avg(coalesce(n, 0)), 8) AS mean, quantile_cont(coalesce(n, 0), 0.5) AS p50, round(quantile_cont(coalesce(n, 0), 0.95), 8) AS p95, max(coalesce(n, 0)) AS most FROM ones LEFT JOIN n USING (country, s1) GROUP BY country", "pairs", "ones"))
def candidate_report(spark, sf) -> DataFrame:
    """BK25: candidates per first-source record."""
    return blocking.candidate_report(view(spark, sf, "pairs"), view(spark, sf, "ones")).withColumns({"mean": F.round("mean", 8), "p95": F.round("p95", 8)})


@query("bk25_found_by_type", with_views("SELECT CAST(i AS INT) AS kt, CAST(sum((bits >> i) & 1) AS BIGINT) AS n_found, count(*) FILTER (bits = (1 << i)) AS n_alone FROM pairs, range(8) t(i) WHERE label = 1 GROUP BY i", "pairs"))
def found_by_type(spark, sf) -> DataFrame:
    """BK25: what each key type finds, and finds alone."""
    return blocking.found_by_type(view(spark, sf, "pairs"))


@query("bk26_missed_profile", with_views(f"{PAIR_SQL.replace('20000', '20')} SELECT t.country, t.src, count(*) AS n_missed, avg(CASE WHEN addr_empty THEN 1.0 ELSE 0.0 END) AS rate_addr_empty, avg(CASE WHEN name_has_marker THEN 1.0 ELSE 0.0 END) AS rate_name_has_marker FROM truth t JOIN rec ON rec.country = t.country AND rec.src = t.src AND rec.idx = t.idx WHERE NOT EXISTS (SELECT 1 FROM ps WHERE ps.country = t.country AND ps.s1 = t.s1 AND ps.src = t.src AND ps.idx = t.idx) GROUP BY t.country, t.src", "rec", "truth"))
def missed_profile(spark, sf) -> DataFrame:
    """BK26, at a bound on blocks that loses pairs of this data."""
    flags = view(spark, sf, "rec").select(*KEYS, "addr_empty", "name_has_marker")
    keys = blocking.keys(records(spark, sf))
    return blocking.missed_profile(view(spark, sf, "truth"), blocking.candidate_pairs(keys, blocking.blocks(keys), 20), flags)


TOP1 = f"""{PAIR_SQL},
j AS (SELECT ps.*, len(list_intersect(string_split(a.name_core, ' '), string_split(c.name_core, ' '))) AS x, len(list_distinct(list_concat(string_split(a.name_core, ' '), string_split(c.name_core, ' ')))) AS u FROM ps JOIN rec a ON a.src = 1 AND a.country = ps.country AND a.idx = ps.s1 JOIN rec c ON c.country = ps.country AND c.src = ps.src AND c.idx = ps.idx),
k1 AS (SELECT *, row_number() OVER (PARTITION BY country, s1 ORDER BY CAST(x AS DOUBLE) / u DESC, nkeys DESC, src, idx) AS rn FROM j)
SELECT country, s1, src, idx, nkeys, round(CAST(x AS DOUBLE) / u, 8) AS jaccard FROM k1 WHERE rn = 1"""


@query("flagship_best_match", with_views(TOP1, "rec"))
def flagship(spark, sf) -> DataFrame:
    """Blocking keys, block join, token overlap, and the best candidate of every first-source record."""
    from pyspark.sql import Window

    from ..operators.features import jaccard

    rec = records(spark, sf)
    one = rec.filter("src = 1").select("country", F.col("idx").alias("s1"), F.split("name_core", " ").alias("a"))
    other = rec.filter("src > 1").select("country", "src", "idx", F.split("name_core", " ").alias("b"))
    keys = blocking.keys(rec)
    rows = blocking.candidate_pairs(keys, blocking.blocks(keys)).join(one, ["country", "s1"]).join(other, ["country", "src", "idx"])
    rows = rows.withColumn("j", jaccard(F.col("a"), F.col("b")))
    best = F.row_number().over(Window.partitionBy("country", "s1").orderBy(F.desc("j"), F.desc("nkeys"), "src", "idx"))
    return rows.withColumn("rn", best).filter("rn = 1").select("country", "s1", "src", "idx", "nkeys", F.round("j", 8).alias("jaccard"))
