"""Records, pairs and truth made from the driver's tables by SQL that Spark and DuckDB read alike.

raw: every part as a record of one of three sources, its name and address dressed up as noisy sources dress theirs. rec: the same parts as normalised records. pairs: every supplier with every part it delivers, as candidates with scores. truth: parts of equal name and brand across sources. lists: customers with the orders that are theirs, and those a rule predicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COUNTRY = "CASE p_size % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'India' WHEN 2 THEN 'France' ELSE 'Other' END"
KEY = "CAST(1 + p_partkey % 3 AS TINYINT) AS src, CAST(p_partkey AS INT) AS idx, 'S' || CAST(1 + p_partkey % 3 AS STRING) || '-' || CAST(p_partkey AS STRING) AS entity_id"

RAW = f"""SELECT {KEY}, {COUNTRY} AS country,
CASE p_partkey % 10 WHEN 0 THEN p_name || ' Inc.' WHEN 1 THEN 'M/s ' || p_name || ' Pvt. Ltd.' WHEN 2 THEN p_name || ' & Sons L.L.C.'
WHEN 3 THEN 'junk formerly known as ' || p_name WHEN 4 THEN 'The ' || p_name || ' Company' WHEN 5 THEN replace(p_name, 'e', 'é') || ' S.A.R.L.'
WHEN 6 THEN 'www.' || replace(p_name, ' ', '') || '.com' WHEN 7 THEN p_name || ' 5ervices #' || CAST(p_size AS STRING) WHEN 8 THEN p_name || ' ' || p_name
ELSE upper(p_name) END AS name_raw,
CASE p_partkey % 8 WHEN 0 THEN CAST(p_size AS STRING) || ' ' || p_brand || ' St, Tyler, TX' WHEN 1 THEN '<NULL>' WHEN 2 THEN 'IA, Iowa City, ' || CAST(p_size AS STRING) || ' Newton Rd, Unit 011'
WHEN 3 THEN CAST(p_size AS STRING) || ' R. DE DIEPPE, LILLE, Hauts-de-France' WHEN 4 THEN 'opp bus stand, h no ' || CAST(p_size AS STRING) || ', gandhi ngr, Mumbai 110 001, Maharashtra'
WHEN 5 THEN 'P.O. Box ' || CAST(p_partkey AS STRING) || ', Paris' WHEN 6 THEN '' ELSE 'Flt #' || CAST(p_size AS STRING) || ' d##85, near l''hôtel, Delhi' END AS addr_raw
FROM {{part}}"""

REC = f"""SELECT *, replace(name_core, ' ', '') AS name_concat FROM (SELECT {KEY}, {COUNTRY} AS country, p_name, p_brand,
CASE p_partkey % 5 WHEN 0 THEN p_name || ' ' || lower(p_type) WHEN 1 THEN p_name ELSE p_name || ' ' || lower(replace(p_brand, '#', '')) END AS name_core,
CASE WHEN p_partkey % 11 = 0 THEN lower(p_type) || ' ' || p_name ELSE '' END AS name_alt,
CASE WHEN p_partkey % 13 = 0 THEN '' ELSE CAST(p_size AS STRING) || ' ' || lower(p_type) || ' ' || lower(replace(p_brand, '#', ' no')) || ' street' END AS addr_core,
CASE WHEN p_partkey % 13 = 0 THEN '' ELSE CAST(p_size AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN ' 7' ELSE '' END END AS addr_nums,
CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS STRING) END AS house_num,
CASE p_partkey % 4 WHEN 0 THEN 'tx' WHEN 1 THEN 'ca' WHEN 2 THEN 'ny' ELSE '' END AS state,
p_partkey % 13 = 0 AS addr_empty, p_partkey % 17 = 0 AS name_has_indic, p_partkey % 6 = 0 AS name_is_web, p_partkey % 11 = 0 AS name_has_marker, p_partkey % 19 = 0 AS addr_has_landmark, p_partkey % 23 = 0 AS addr_has_pobox
FROM {{part}}) r"""

PAIRS = """SELECT l_linestatus AS country, CAST(l_suppkey AS INT) AS s1, CAST(2 + l_partkey % 2 AS TINYINT) AS src, CAST(l_partkey AS INT) AS idx,
round(max(l_discount) * 9.5 + 0.02, 4) AS p, CAST(max(l_quantity) * 4 AS DOUBLE) AS score, CAST(max(l_quantity) * 2 AS DOUBLE) AS sim_name, CAST(100 - min(l_quantity) * 2 AS DOUBLE) AS sim_addr,
CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_partkey % 13 AS STRING) END AS house, 'n' || CAST(l_partkey % 17 AS STRING) AS name, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'a' || CAST(l_partkey % 19 AS STRING) END AS addr,
CAST(l_suppkey % 13 AS STRING) AS s_house, CAST(CASE WHEN (l_suppkey + l_partkey) % 6 = 0 THEN 1 ELSE 0 END AS TINYINT) AS label, CAST(1 + l_partkey % 255 AS SMALLINT) AS bits, CAST(count(*) AS SMALLINT) AS nkeys
FROM {lineitem} GROUP BY l_linestatus, l_suppkey, l_partkey"""

ONES = "SELECT DISTINCT l_linestatus AS country, CAST(l_suppkey AS INT) AS s1 FROM {lineitem}"

PAIR_TRUTH = "SELECT country, s1, src, idx FROM ({pairs}) p WHERE label = 1 UNION ALL SELECT DISTINCT l_linestatus, CAST(l_suppkey AS INT), CAST(2 AS TINYINT), CAST(-1 - l_suppkey AS INT) FROM {lineitem}"

TRUTH = "SELECT s.country, s.idx AS s1, r.src, r.idx FROM ({rec}) s JOIN ({rec}) r ON s.country = r.country AND s.p_name = r.p_name AND s.p_brand = r.p_brand WHERE s.src = 1 AND r.src > 1"

LISTS = """SELECT 'S1-' || CAST(c_custkey AS STRING) AS s1_id, c_mktsegment AS country, CAST(c_custkey AS INT) AS idx FROM {customer}"""
TRUE_IDS = "SELECT 'S1-' || CAST(o_custkey AS STRING) AS s1_id, 'S2-' || CAST(o_orderkey AS STRING) AS rec_id FROM {orders} WHERE o_orderstatus = 'F'"
PRED_IDS = "SELECT 'S1-' || CAST(o_custkey AS STRING) AS s1_id, 'S2-' || CAST(o_orderkey AS STRING) AS rec_id FROM {orders} WHERE o_totalprice > 250000"

TABLES = ("part", "lineitem", "customer", "orders", "supplier", "nation")
VIEWS = {"raw": RAW, "rec": REC, "pairs": PAIRS, "ones": ONES, "pair_truth": PAIR_TRUTH, "truth": TRUTH, "lists": LISTS, "true_ids": TRUE_IDS, "pred_ids": PRED_IDS}


def _fill(text: str, names: dict[str, str]) -> str:
    while "{" in text:
        text = text.format(**names, pairs=PAIRS, rec=REC)
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_fill(VIEWS[name], {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def view_sql(name: str) -> str:
    """The same view for DuckDB, over the driver's registered tables."""
    return _fill(VIEWS[name], {t: t for t in TABLES})


def with_views(body: str, *names: str) -> str:
    """DuckDB SQL with the named views ahead of body, which may begin with further common tables ('x AS (..), y AS (..) SELECT ..')."""
    heads = ", ".join(f"{n} AS ({view_sql(n)})" for n in names)
    joiner = " " if body.lstrip().upper().startswith("SELECT") else ", "
    return f"WITH {heads}{joiner}{body}"
