"""Audits and exploratory aggregates: overlaps, link tokens, integrity, collisions, leaks, and the output validator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from .decide import link_key

def overlap(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """(n, n_shared): rows of left, and those whose columns occur in right."""
    return left.agg(F.count(F.lit(1)).alias("n")).crossJoin(left.join(right.select(*cols).distinct(), cols, "left_semi").agg(F.count(F.lit(1)).alias("n_shared")))


def link_tokens(rows: DataFrame, kind: str) -> DataFrame:
    """rows (.., name_raw, addr_raw) with tok: each distinct link token of a kind, from the name, phones from the address too. Phones are their digits, domains in lower case."""
    pattern, group = rules.LINK_TOKENS[kind]
    source = F.concat_ws(" ", "name_raw", "addr_raw") if kind == "phone" else F.col("name_raw")
    found = F.regexp_extract_all(source, F.lit(pattern), F.lit(group))
    if kind == "phone":
        found = F.filter(F.transform(found, lambda x: F.regexp_replace(x, "[^0-9]", "")), lambda x: F.length(x) >= 7)
    elif kind == "domain":
        found = F.transform(found, F.lower)
    return rows.withColumn("tok", F.explode(F.array_distinct(found)))


def pair_precision(rows: DataFrame, key: list[str], entity: str) -> DataFrame:
    """(n_pairs, n_true_pairs, precision, n_rows): pairs of rows that share the key, and those of one entity; counted from group sizes, no pair is made."""
    sizes = rows.groupBy(*key, entity).agg(F.count(F.lit(1)).alias("m")).groupBy(*key).agg(F.sum("m").alias("n"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("same"))
    total = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("n_pairs"), F.sum("same").alias("n_true_pairs"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_rows"))
    return total.withColumn("precision", F.when(F.col("n_pairs") > 0, F.col("n_true_pairs") / F.col("n_pairs")))


def token_report(rows: DataFrame, kinds: tuple[str, ...] = tuple(rules.LINK_TOKENS)) -> DataFrame:
    """(kind, n_records, n_pairs, n_true_pairs, precision, n_covered): of each kind of link token the records that carry one, pairs that share one within a country, those of one entity, and entities (0 or more) of which two records share one. rows (src, idx, country, entity, name_raw, addr_raw)."""
    toks = reduce(DataFrame.unionByName, [link_tokens(rows, k).select(F.lit(k).alias("kind"), "src", "idx", "country", "entity", "tok") for k in kinds])
    carriers = toks.select("kind", "src", "idx").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n_records"))
    pairs = lambda n: F.coalesce(F.sum(F.col(n) * (F.col(n) - 1) / 2), F.lit(0.0))
    by_entity = toks.groupBy("kind", "country", "tok", "entity").agg(F.count(F.lit(1)).alias("m"))
    whole = by_entity.groupBy("kind", "country", "tok").agg(F.sum("m").alias("n"), pairs("m").alias("same")).groupBy("kind").agg(pairs("n").alias("n_pairs"), F.sum("same").alias("n_true_pairs"))
    covered = by_entity.filter("entity >= 0 and m > 1").groupBy("kind").agg(F.count_distinct("entity").alias("n_covered"))
    found = carriers.join(whole, "kind").join(covered, "kind", "left").na.fill(0, ["n_covered"])
    return found.withColumn("precision", F.when(F.col("n_pairs") > 0, F.col("n_true_pairs") / F.col("n_pairs")))


def rule_report(rows: DataFrame, link_rules: tuple[str, ...]) -> DataFrame:
    """(rule, n_pairs, n_true_pairs, precision, coverage): of each link rule the pairs of one source and country that it links, those of one entity, and their share of all pairs of one entity and source. rows (src, idx, country, entity, name_raw, addr_raw, name_core, addr_core)."""
    others = rows.filter("src > 1")
    keyed = reduce(DataFrame.unionByName, [others.select(F.lit(r).alias("rule"), "src", "country", "entity", link_key(r).alias("key")) for r in link_rules]).filter("key is not null")
    pairs = lambda n: F.coalesce(F.sum(F.col(n) * (F.col(n) - 1) / 2), F.lit(0.0))
    by_entity = keyed.groupBy("rule", "src", "country", "key", "entity").agg(F.count(F.lit(1)).alias("m"))
    groups = by_entity.groupBy("rule", "src", "country", "key").agg(F.sum("m").alias("n"), F.sum(F.when(F.col("entity") >= 0, F.col("m") * (F.col("m") - 1) / 2).otherwise(0.0)).alias("same"))
    found = groups.groupBy("rule").agg(pairs("n").alias("n_pairs"), F.sum("same").alias("n_true_pairs"))
    every = others.filter("entity >= 0").groupBy("src", "entity").agg(F.count(F.lit(1)).alias("m")).agg(pairs("m").alias("all_true"))
    found = found.crossJoin(F.broadcast(every))  # one row
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return found.select("rule", "n_pairs", "n_true_pairs", share("n_true_pairs", "n_pairs").alias("precision"), share("n_true_pairs", "all_true").alias("coverage"))


def with_entities(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """rows (src, idx) with entity: the first-source record they belong to; those without one get a negative number of their own."""
    joined = rows.join(truth.groupBy("src", "idx").agg(F.min("s1").alias("s1")), ["src", "idx"], "left")
    return joined.withColumn("entity", F.coalesce(F.col("s1").cast("long"), -(F.col("src").cast("long") * 2**40 + F.col("idx") + 1))).drop("s1")


def linked_misses(decided: DataFrame, keys: DataFrame) -> DataFrame:
    """(n_missed, n_linked): refused true pairs, and those whose record shares a key (src, idx, key) with an accepted record of the same first-source record."""
    own = keys.select("src", "idx", "key")
    missed = decided.filter("label = 1 and not accepted").select("country", "s1", "src", "idx")
    accepted = decided.filter("accepted").join(own, ["src", "idx"]).select("country", "s1", "key").distinct()
    hit = missed.join(own, ["src", "idx"]).join(accepted, ["country", "s1", "key"], "left_semi").select("country", "s1", "src", "idx").distinct()
    return missed.agg(F.count(F.lit(1)).alias("n_missed")).crossJoin(hit.agg(F.count(F.lit(1)).alias("n_linked")))


def integrity(rows: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """One row of counts: rows, distinct ids, and per column nulls, empties, untrimmed, with tabs, with non-ASCII, longest."""
    count = lambda c: F.count_if(c)
    cols = [F.count(F.lit(1)).alias("n"), F.count_distinct(id_column).alias("n_ids")]
    for c in columns:
        v = F.col(c)
        cols += [
            count(v.isNull()).alias(f"{c}_null"),
            count(v == "").alias(f"{c}_empty"),
            count(v != F.trim(v)).alias(f"{c}_untrimmed"),
            count(v.contains("\t")).alias(f"{c}_tab"),
            count(v.rlike(r"[^\x00-\x7F]")).alias(f"{c}_non_ascii"),
            F.max(F.length(v)).alias(f"{c}_longest"),
        ]
    return rows.agg(*cols)


def truth_integrity(truth: DataFrame, records: DataFrame) -> DataFrame:
    """Of truth (s1_id, ids): rows, repeated ids within a row, ids of no record, records claimed twice."""
    ids = truth.select("s1_id", F.explode("ids").alias("rec_id"))
    base = truth.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("ids") - F.size(F.array_distinct("ids"))).alias("n_repeated"))
    lost = ids.join(records.select(F.col("entity_id").alias("rec_id")), "rec_id", "left_anti").agg(F.count(F.lit(1)).alias("n_unknown"))
    twice = ids.groupBy("rec_id").agg(F.count_distinct("s1_id").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_claimed_twice"))
    return base.crossJoin(lost).crossJoin(twice)


def country_counts(records: DataFrame) -> DataFrame:
    """(country, n1, n2, n3, ratio): sizes by source, and others per first-source record."""
    rows = records.groupBy("country").agg(*(F.count_if(F.col("src") == i).alias(f"n{i}") for i in (1, 2, 3)))
    return rows.withColumn("ratio", F.when(F.col("n1") > 0, (F.col("n2") + F.col("n3")) / F.col("n1")))


def match_buckets(truth: DataFrame) -> DataFrame:
    """By size bucket of the match set: records, and those with two matches or more in one source; truth (country, s1, src, idx)."""
    from .metrics import size_bucket

    per = truth.groupBy("country", "s1").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("src") == 2).alias("k2"), F.count_if(F.col("src") == 3).alias("k3"))
    return per.groupBy(size_bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_s1"), F.count_if((F.col("k2") > 1) | (F.col("k3") > 1)).alias("n_same_source"))


def country_matrix(truth: DataFrame, records: DataFrame) -> DataFrame:
    """(s_country, r_country, n): countries on both sides of true pairs (s1, src, idx)."""
    s = records.filter("src = 1").select(F.col("idx").alias("s1"), F.col("country").alias("s_country"))
    r = records.filter("src > 1").select("src", "idx", F.col("country").alias("r_country"))
    return truth.select("s1", "src", "idx").join(s, "s1").join(r, ["src", "idx"]).groupBy("s_country", "r_country").agg(F.count(F.lit(1)).alias("n"))


def one_home_violations(truth: DataFrame) -> DataFrame:
    return truth.groupBy("src", "idx").agg(F.count_distinct("s1").alias("n_homes")).filter("n_homes > 1")


def orphans(records: DataFrame, truth: DataFrame) -> DataFrame:
    """(country, src, n, n_orphans, rate): other records that belong to no first-source record."""
    own = records.filter("src > 1").select("country", "src", "idx")
    alone = own.join(truth.select("src", "idx"), ["src", "idx"], "left_anti").groupBy("country", "src").agg(F.count(F.lit(1)).alias("n_orphans"))
    rows = own.groupBy("country", "src").agg(F.count(F.lit(1)).alias("n")).join(alone, ["country", "src"], "left").na.fill(0, ["n_orphans"])
    return rows.withColumn("rate", F.col("n_orphans") / F.col("n"))


RANK_PARTS = 200  # ranges of values that ranks are counted in


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The rank correlation of two numeric columns, ties taking their mean rank. Ranks come from counts per value, within ranges of values that hold about as many rows each; a window runs over a range, and one over the ranges."""

    def ranks(c: str, out: str) -> DataFrame:
        bounds = sorted(set(rows.approxQuantile(c, [i / RANK_PARTS for i in range(1, RANK_PARTS)], 0.001)))
        part = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda x: x < F.col(c)))
        sizes = rows.groupBy(c).agg(F.count(F.lit(1)).alias("k")).withColumn("_part", part)
        before = sizes.groupBy("_part").agg(F.sum("k").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        within = F.sum("k").over(Window.partitionBy("_part").orderBy(c))
        return sizes.withColumn("_until", within).join(F.broadcast(before.select("_part", "_before")), "_part").select(c, (F.col("_before") + F.col("_until") - (F.col("k") - 1) / 2).alias(out))

    return rows.join(ranks(a, "_ra"), a).join(ranks(b, "_rb"), b).agg(F.corr("_ra", "_rb").alias("rho"))


def substitutions(pairs: DataFrame, a: str, b: str, n: int = 25) -> DataFrame:
    """(country, side, tok, n): tokens that only one text of a true pair has, the n most frequent of each country and side."""
    ta, tb = F.split(a, " "), F.split(b, " ")
    rows = pairs.select("country", F.explode(F.array(F.struct(F.lit("s").alias("side"), F.array_except(ta, tb).alias("toks")), F.struct(F.lit("r").alias("side"), F.array_except(tb, ta).alias("toks")))).alias("x"))
    counts = rows.select("country", "x.side", F.explode("x.toks").alias("tok")).filter("tok <> ''").groupBy("country", "side", "tok").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("country", "side").orderBy(F.desc("n"), "tok")
    return counts.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def collisions(records: DataFrame, column: str) -> DataFrame:
    """(country, value, n): values that two first-source records or more share."""
    return records.filter("src = 1").groupBy("country", F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def hard_negatives(records: DataFrame, truth: DataFrame, column: str) -> DataFrame:
    """(country, n_pairs, n_true, precision): pairs across sources that share a value, counted from frequencies, and how many are true."""
    f = records.groupBy("country", column).agg(F.count_if(F.col("src") == 1).alias("a"), F.count_if(F.col("src") > 1).alias("b"))
    total = f.groupBy("country").agg(F.sum(F.col("a") * F.col("b")).alias("n_pairs"))
    s = records.filter("src = 1").select("country", F.col("idx").alias("s1"), F.col(column).alias("_a"))
    r = records.filter("src > 1").select("country", "src", "idx", F.col(column).alias("_b"))
    true = truth.join(s, ["country", "s1"]).join(r, ["country", "src", "idx"]).filter(F.col("_a") == F.col("_b")).groupBy("country").agg(F.count(F.lit(1)).alias("n_true"))
    return total.join(true, "country", "left").na.fill(0, ["n_true"]).withColumn("precision", F.when(F.col("n_pairs") > 0, F.col("n_true") / F.col("n_pairs")))


def sample(rows: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows in a seeded order of their keys; a listing for a report."""
    return rows.orderBy(seeded(keys, seed), *keys).limit(n)


def seeded(keys: list[str], seed: int | str = 42) -> Column:
    """A hash of keys and seed that any engine can make: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))).cast("binary"))


def in_share(keys: list[str], share: float, seed: int | str = 42) -> Column:
    """Whether the first 32 bits of the seeded hash of keys fall below the share; the same rows everywhere."""
    return F.conv(F.substring(seeded(keys, seed), 1, 8), 16, 10).cast("long") < F.lit(int(share * 2**32))


def bernoulli(rows: DataFrame, keys: list[str], share: float, seed: int = 42) -> DataFrame:
    return rows.filter(in_share(keys, share, seed))


def validate(lists: DataFrame, required: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """(rule, n): breaches of the output format. lists (line, value) are raw lines with their numbers, the header being 0; required (s1_id); known (id); candidates (s1_id, ids). Ids are split at commas as they stand; ids in lines are not trimmed, the required ones are."""
    head, body = lists.filter("line = 0"), lists.filter("line > 0")
    tabs = F.length("value") - F.length(F.replace(F.col("value"), F.lit("\t"), F.lit("")))
    rows = body.filter(tabs == 1).select(F.split("value", "\t")[0].alias("s1_id"), F.split("value", "\t")[1].alias("list"))
    rows = rows.withColumn("ids", F.when(F.col("list") == "", F.array().cast("array<string>")).otherwise(F.split("list", ",")))
    need = required.select(F.trim("s1_id").alias("s1_id")).distinct()
    one = lambda df, rule: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), F.col("n").cast("long").alias("n"))
    ids = rows.select("s1_id", F.explode("ids").alias("id"))
    out = [
        one(head.filter(tabs != 1), "header without one tab"),
        one(head.filter(~F.col("value").startswith("source1_entity_id\t")), "wrong header"),
        one(body.filter(tabs != 1), "row without one tab"),
        one(rows.groupBy("s1_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "repeated row"),
        one(rows.filter(F.size("ids") != F.size(F.array_distinct("ids"))), "repeated id"),
        one(ids.filter(F.col("id").startswith("S1-")), "first-source id"),
        one(ids.filter(~F.col("id").rlike("^S[123]-")), "wrong prefix"),
        one(need.join(rows, "s1_id", "left_anti"), "missing row"),
        one(rows.join(need, "s1_id", "left_anti"), "extra row"),
    ]
    if known is not None:
        out.append(one(ids.join(known.select("id"), "id", "left_anti"), "unknown id"))
    if candidates is not None:
        c = candidates.select("s1_id", F.col("ids").alias("cids"))
        out.append(one(rows.join(c, "s1_id").filter(F.size(F.array_except("ids", "cids")) > 0), "match that is no candidate"))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def region_cities(components: DataFrame, least: int = 20) -> DataFrame:
    """(city, region): digit-free components of records with a known region that occur often and with one region only; components (component, region)."""
    rows = components.filter((F.col("region") != "") & (F.col("component") != "") & ~F.col("component").rlike("[0-9]"))
    found = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("region").alias("k"), F.min("region").alias("region"))
    return found.filter((F.col("n") >= least) & (F.col("k") == 1)).select(F.col("component").alias("city"), "region")


def find_region(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """rows (country, src, idx, components) with region_found: by whole components; else by the longest city that stands as tokens in one; '' if that is ambiguous. Runs of tokens are looked up by equality, not tried against every city."""
    keys = ["country", "src", "idx"]
    comps = rows.select(*keys, F.explode("components").alias("component"))
    whole = comps.join(cities.withColumnRenamed("city", "component"), "component").groupBy(*keys).agg(F.count_distinct("region").alias("k"), F.min("region").alias("whole"))
    toks = comps.select(*keys, F.filter(F.split("component", " "), lambda t: t != "").alias("t")).filter(F.size("t") > 0)
    most = F.lit(cities.agg(F.max(F.size(F.split("city", " ")))).first()[0] or 1)  # no run longer than the longest city can be one
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.size("t") - i + 1, most)), lambda n: F.array_join(F.slice("t", i, n), " "))))
    parts = toks.select(*keys, F.explode(runs).alias("city")).distinct().join(cities, "city")
    long = F.length("city")
    best = parts.withColumn("_m", F.max(long).over(Window.partitionBy(*keys))).filter(long == F.col("_m")).groupBy(*keys).agg(F.count_distinct("region").alias("kp"), F.min("region").alias("part"))
    found = rows.join(whole, keys, "left").join(best, keys, "left")
    value = F.when(F.col("k") == 1, F.col("whole")).when(F.col("k") > 1, "").when(F.col("kp") == 1, F.col("part")).otherwise("")
    return found.withColumn("region_found", value).drop("k", "whole", "kp", "part")


def test_like(pairs: DataFrame, share: float = 0.19, seed: int = 42) -> DataFrame:
    """pairs as if a share of the first-source records had not been there: theirs go, candidates are ranked and counted anew by score and, where there is one, by pscore; what they matched stays as orphans."""
    from .blocking import with_counts, with_ranks

    kept = pairs.filter(~in_share(["country", "s1"], share, seed))
    kept = kept.drop("rank_s", "rank_r", "prank_s", "prank_r", "n_cand_s1", "n_cand_rec")
    kept = with_counts(with_ranks(kept))
    return with_ranks(kept, "pscore", "prank_s", "prank_r") if "pscore" in pairs.columns else kept


def share_bucket(x: Column, width: float = 0.1) -> Column:
    return F.least(F.floor(x / width), F.lit(int(1 / width) - 1)).cast("int")


def refilled_states(pairs: DataFrame, found: DataFrame, country: str) -> DataFrame:
    """pairs (.., s_state, r_state, state_match) with the states of one country's records filled from regions that were found (country, src, idx, region_found) and its state_match anew; other countries stay as they are."""
    from .features import state_match

    s = found.filter("src = 1").select("country", F.col("idx").alias("s1"), F.col("region_found").alias("_s"))
    r = found.filter("src > 1").select("country", "src", "idx", F.col("region_found").alias("_r"))
    rows = pairs.join(s, ["country", "s1"], "left").join(r, ["country", "src", "idx"], "left")
    here = F.col("country") == country
    fill = lambda own, new: F.when(here & (F.col(own) == ""), F.coalesce(new, F.lit(""))).otherwise(F.col(own))
    rows = rows.withColumns({"s_state": fill("s_state", F.col("_s")), "r_state": fill("r_state", F.col("_r"))}).drop("_s", "_r")
    return rows.withColumn("state_match", F.when(here, state_match(F.col("s_state"), F.col("r_state"))).otherwise(F.col("state_match")))


def before_after(pairs: DataFrame, raw: tuple[str, str], clean: tuple[str, str]) -> DataFrame:
    """(country, n, equal_before, equal_after): true pairs whose texts are equal as they came and as they were normalised."""
    return pairs.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(raw[0]) == F.col(raw[1])).alias("equal_before"), F.count_if(F.col(clean[0]) == F.col(clean[1])).alias("equal_after"))
