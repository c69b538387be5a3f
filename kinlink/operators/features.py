"""Pair features: similarities, token overlaps weighted by rarity, numbers, flags, and competition among candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from .blocking import KEY_TYPES

FLAGS = ("addr_empty", "name_has_indic", "name_is_web", "name_has_marker", "addr_has_landmark", "addr_has_pobox")
NEAR_NAME, NEAR_ADDRESS = 90, 85
ZERO = 0.0


def prepared(rec: DataFrame) -> DataFrame:
    """rec with the texts as features compare them: pname, paddr, pconcat, pphon, token arrays nt and at, numbers nums."""
    rows = rec.withColumns({"pname": text.prepared_name(F.col("name_core")), "paddr": text.prepared_address(F.col("addr_core")), "palt": text.prepared_name(F.col("name_alt"))})
    rows = rows.withColumns({"nt": text.tokens(F.col("pname")), "at": text.tokens(F.col("paddr")), "nums": text.tokens(F.col("addr_nums"))})
    return rows.withColumns({"pconcat": F.array_join("nt", ""), "pphon": F.array_join(F.transform("nt", text.phon), " ")})


def idf(rows: DataFrame, column: str) -> DataFrame:
    """(country, tok, idf): log of records by records with the token, over all sources of a country."""
    n = rows.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    df = rows.select("country", "src", "idx", F.explode(F.array_distinct(column)).alias("tok")).groupBy("country", "tok").agg(F.count(F.lit(1)).alias("df"))
    return df.join(n, "country").select("country", "tok", F.log(F.col("n") / F.col("df")).alias("idf"))


def weighted(rows: DataFrame, column: str, weights: DataFrame, out: str) -> DataFrame:
    """rows with out: array<struct<tok, idf>> of a token array's distinct tokens, sorted."""
    toks = rows.select("country", "src", "idx", F.explode(F.array_distinct(column)).alias("tok")).join(weights.hint("merge"), ["country", "tok"])
    arrays = toks.groupBy("country", "src", "idx").agg(F.array_sort(F.collect_list(F.struct("tok", "idf"))).alias(out))
    return rows.join(arrays.hint("merge"), ["country", "src", "idx"], "left").withColumn(out, F.coalesce(out, F.array().cast("array<struct<tok:string,idf:double>>")))


def jaccard(a: Column, b: Column) -> Column:
    """Common by all tokens; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, ZERO).otherwise(F.size(F.array_intersect(a, b)) / union)


def covered(own: Column, other: Column) -> Column:
    """The share of own's weight (array<struct<tok, idf>>) that other's tokens have; 0 without weight. Sums run in token order, so they are the same everywhere."""
    mass = F.aggregate(own, F.lit(0.0), lambda s, x: s + x["idf"])
    toks = F.transform(other, lambda x: x["tok"])
    hit = F.aggregate(own, F.lit(0.0), lambda s, x: s + F.when(F.array_contains(toks, x["tok"]), x["idf"]).otherwise(F.lit(0.0)))
    return F.when(mass == 0, ZERO).otherwise(hit / mass)


def rarest(own: Column) -> Column:
    """The token of the largest weight, the last by name among equals."""
    return F.array_max(F.transform(own, lambda x: F.struct(x["idf"].alias("idf"), x["tok"].alias("tok"))))["tok"]


def token_features(s_nt: Column, r_nt: Column, s_w: Column, r_w: Column, s_name: Column, r_name: Column, s_concat: Column, r_concat: Column) -> dict[str, Column]:
    exact = (s_name != "") & (s_name == r_name)
    contain = (s_concat != "") & (r_concat != "") & (s_concat.contains(r_concat) | r_concat.contains(s_concat))
    return {
        "name_jaccard": jaccard(s_nt, r_nt),
        "name_cov_s": covered(s_w, r_w),
        "name_cov_r": covered(r_w, s_w),
        "name_first_tok": F.coalesce(F.get(s_nt, F.lit(0)) == F.get(r_nt, F.lit(0)), F.lit(False)).cast("int"),
        "name_rarest_in_r": F.coalesce(F.array_contains(r_nt, rarest(s_w)), F.lit(False)).cast("int"),
        "name_exact": exact.cast("int"),
        "concat_contain": contain.cast("int"),
    }


def address_features(s_at: Column, r_at: Column, s_w: Column, r_w: Column) -> dict[str, Column]:
    both = (F.size(s_at) > 0) & (F.size(r_at) > 0)
    return {"addr_cov_s": F.when(both, covered(s_w, r_w)).otherwise(ZERO), "addr_cov_r": F.when(both, covered(r_w, s_w)).otherwise(ZERO)}


def number_features(s_nums: Column, r_nums: Column) -> dict[str, Column]:
    """Overlap of number sets, and the share of the first side's numbers, repeats counted, that the other has."""
    return {
        "nums_jaccard": jaccard(s_nums, r_nums),
        "nums_frac_s_in_r": F.when(F.size(s_nums) == 0, ZERO).otherwise(F.size(F.filter(s_nums, lambda n: F.array_contains(r_nums, n))) / F.size(s_nums)),
    }


def house_features(s: Column, r: Column) -> dict[str, Column]:
    """By house number; the log difference is null where one is missing, and reads 15 digits at most."""
    number = lambda x: F.substring(x, 1, 15).cast("long")
    missing = s.isNull() | r.isNull()
    return {
        "house_eq": F.coalesce(s == r, F.lit(False)).cast("int"),
        "house_logdiff": F.when(~missing, F.log1p(F.abs(number(s) - number(r)).cast("double"))),
        "house_prefix": F.coalesce(s.startswith(r) | r.startswith(s), F.lit(False)).cast("int"),
        "house_missing": missing.cast("int"),
    }


def size_features(s_nt: Column, r_nt: Column, s_at: Column, r_at: Column, s_name: Column, r_name: Column) -> dict[str, Column]:
    return {
        "name_ntok_s": F.size(s_nt),
        "name_ntok_r": F.size(r_nt),
        "addr_ntok_s": F.size(s_at),
        "addr_ntok_r": F.size(r_at),
        "name_len_diff": F.abs(F.length(s_name) - F.length(r_name)),
    }


def state_match(s: Column, r: Column) -> Column:
    return F.when((s == "") | (r == ""), -1).otherwise((s == r).cast("int"))


def similarity_features(p: str = "s_", q: str = "r_") -> dict[str, Column]:
    a, b = (lambda c: F.col(p + c)), (lambda c: F.col(q + c))
    return {
        "name_tsr": similarity.token_set_ratio(a("pname"), b("pname")),
        "name_tsort": similarity.token_sort_ratio(a("pname"), b("pname")),
        "name_ratio": similarity.ratio(a("pname"), b("pname")),
        "name_partial": similarity.partial_ratio(a("pname"), b("pname")),
        "name_jw": similarity.jaro_winkler(a("pname"), b("pname")),
        "name_alt_tsr": F.when(b("palt") != "", similarity.token_set_ratio(a("pname"), b("palt"))).otherwise(F.lit(0.0).cast("float")),
        "concat_ratio": similarity.ratio(a("pconcat"), b("pconcat")),
        "phon_tsr": similarity.token_set_ratio(a("pphon"), b("pphon")),
        "addr_tsr": similarity.token_set_ratio(a("paddr"), b("paddr")),
        "addr_tsort": similarity.token_sort_ratio(a("paddr"), b("paddr")),
        "addr_ratio": similarity.ratio(a("paddr"), b("paddr")),
        "addr_partial": similarity.partial_ratio(a("paddr"), b("paddr")),
    }


def chains(rows: DataFrame) -> DataFrame:
    """rows with chain: how many first-source records of the country have this prepared name."""
    n = rows.filter("src = 1").groupBy("country", "pname").agg(F.count(F.lit(1)).alias("chain"))
    return rows.join(n, ["country", "pname"], "left").na.fill(0, ["chain"])


def vocabulary_share(rows: DataFrame) -> DataFrame:
    """(country, src, idx, r_tok_in_s1_vocab): the share of name tokens, repeats counted, that the first source's names have."""
    toks = rows.select("country", "src", "idx", F.explode("nt").alias("tok"))
    known = toks.filter("src = 1").select("country", "tok", F.lit(1.0).alias("k")).distinct()
    return toks.join(known, ["country", "tok"], "left").groupBy("country", "src", "idx").agg(F.avg(F.coalesce("k", F.lit(0.0))).alias("r_tok_in_s1_vocab"))


def key_bits(bits: Column) -> dict[str, Column]:
    return {f"key_{name}": F.shiftright(bits.cast("int"), i).bitwiseAND(1) for i, name in enumerate(KEY_TYPES)}


def other_best(value: Column, part: list[str], order: list[Column]) -> Column:
    """The best value among a group's other rows, null if there is none; order decides which row is the best."""
    full = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return F.when(rank == 1, F.nth_value(value, 2).over(full)).otherwise(F.first_value(value).over(full))


def competition(pairs: DataFrame) -> DataFrame:
    """pairs (country, s1, src, idx, score, sim_name, sim_addr) with what the other candidates of both sides are like."""
    rec, one = ["country", "src", "idx"], ["country", "s1"]
    by_rec, by_one = Window.partitionBy(*rec), Window.partitionBy(*one)
    cols = {}
    for short, c in (("name", "sim_name"), ("addr", "sim_addr"), ("score", "score")):
        cols[f"r_oth_{short}"] = other_best(F.col(c), rec, [F.desc(c), F.col("s1")])
    near_name, near_addr = F.col("sim_name") >= NEAR_NAME, F.col("sim_addr") >= NEAR_ADDRESS
    rows = pairs.withColumns(cols)
    rows = rows.withColumns({f"r_margin_{s}": F.col(c) - F.coalesce(F.col(f"r_oth_{s}"), F.lit(0.0)) for s, c in (("name", "sim_name"), ("addr", "sim_addr"), ("score", "score"))})
    return rows.withColumns(
        {
            "r_n_name90": F.sum(near_name.cast("int")).over(by_rec),
            "s_rank_name": F.rank().over(by_one.orderBy(F.desc("sim_name"))),
            "s_rank_addr": F.rank().over(by_one.orderBy(F.desc("sim_addr"))),
            "s_gap_best": F.max("score").over(by_one) - F.col("score"),
            "s_n_near": F.sum((near_name & near_addr).cast("int")).over(by_one),
        }
    )


#: What pair_rows() can add to the prepared fields, each at the price of a join.
PARTS = ("chain", "name", "address", "vocabulary")


def pair_rows(pairs: DataFrame, rec: DataFrame, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """pairs joined with both records' prepared fields, s_ and r_ in front; parts: chain counts, weights of name and address tokens, share of known tokens."""
    rows = prepared(rec)
    keep = ["pname", "palt", "paddr", "pconcat", "pphon", "nt", "at", "nums", "state", "house_num", *FLAGS]
    if "chain" in parts:
        rows, keep = chains(rows), [*keep, "chain"]
    for part, tokens, weights in (("name", "nt", "nw"), ("address", "at", "aw")):
        if part in parts:
            rows, keep = weighted(rows, tokens, idf(rows, tokens), weights), [*keep, weights]
    s = rows.filter("src = 1").select("country", F.col("idx").alias("s1"), *(F.col(c).alias(f"s_{c}") for c in keep))
    r, more = rows.filter("src > 1"), []
    if "vocabulary" in parts:
        r, more = r.join(vocabulary_share(rows).hint("merge"), ["country", "src", "idx"], "left").na.fill(0.0, ["r_tok_in_s1_vocab"]), ["r_tok_in_s1_vocab"]
    r = r.select("country", "src", "idx", *more, *(F.col(c).alias(f"r_{c}") for c in keep))
    # shuffles at any size: files of much repeated values are small, so tables of all records look as if they could be broadcast
    return pairs.join(s.hint("merge"), ["country", "s1"]).join(r.hint("merge"), ["country", "src", "idx"])


def features(pairs: DataFrame, rec: DataFrame, similarities: bool = True) -> DataFrame:
    """Every feature of every pair; pairs as from blocking, with ranks and counts."""
    rows = pair_rows(competition(pairs), rec)
    s, r = (lambda c: F.col(f"s_{c}")), (lambda c: F.col(f"r_{c}"))
    cols: dict[str, Column] = dict(similarity_features()) if similarities else {}
    cols |= token_features(s("nt"), r("nt"), s("nw"), r("nw"), s("pname"), r("pname"), s("pconcat"), r("pconcat"))
    cols |= address_features(s("at"), r("at"), s("aw"), r("aw"))
    cols |= number_features(s("nums"), r("nums")) | house_features(s("house_num"), r("house_num"))
    cols |= size_features(s("nt"), r("nt"), s("at"), r("at"), s("pname"), r("pname"))
    cols |= {"state_match": state_match(s("state"), r("state")), "rec_src_s3": (F.col("src") == 3).cast("int")}
    cols |= {f"rec_{f}": r(f).cast("int") for f in FLAGS} | {"chain_s": s("chain"), "chain_r": r("chain")} | key_bits(F.col("bits"))
    out = rows.withColumns(cols)
    drop = [c for c in out.columns if c.startswith(("s_", "r_")) and c[2:] in {"pname", "palt", "paddr", "pconcat", "pphon", "nt", "at", "nums", "nw", "aw", "chain", "state", "house_num", *FLAGS}]
    return out.drop(*drop)


def uncovered(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs that a finished feature table lacks."""
    return pairs.join(done.select("country", "s1", "src", "idx"), ["country", "s1", "src", "idx"], "left_anti")
