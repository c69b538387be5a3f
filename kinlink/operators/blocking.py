"""Candidate generation: eight families of blocking keys, block sizes, the block join, ranks and pruning.

Relations: rec (country, src, idx, name_core, name_phon, name_alt, name_concat, addr_core, house_num); keys (country, src, idx, h, kt); pairs (country, s1, src, idx, bits, nkeys, ..). Keys are strings in which the family stands first, so that families share a space only where they mean to.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text

KEY_TYPES = ("name_pair", "name_single", "name_phon", "concat_prefix", "name_alt", "addr_pair", "addr_number", "cross")
MOST_PAIRS = 20_000  # of a block: beyond it a block is skipped
SINGLE_DF = 50
PREFIX, PREFIX_LEAST = 8, 6
GRID_K, GRID_BIG_K = (1, 2, 3, 5), (10, 20, 30, 50)
TOLERANCE = 0.002
RECORD = ["country", "src", "idx"]


def name_tokens(rec: DataFrame, core: str = "name_core", phon: str = "name_phon") -> DataFrame:
    """(country, src, idx, tok, ph): each token of a name with its phonetic key, side by side."""
    rows = rec.filter(F.col(core) != "").select(*RECORD, F.explode(F.arrays_zip(F.split(core, " ").alias("tok"), F.split(phon, " ").alias("ph"))).alias("x"))
    return rows.select(*RECORD, "x.tok", "x.ph").distinct()


def address_tokens(rec: DataFrame) -> DataFrame:
    """(country, src, idx, tok): address tokens without a digit in them."""
    return rec.filter(F.col("addr_core") != "").select(*RECORD, F.explode(F.split("addr_core", " ")).alias("tok")).filter(~F.col("tok").rlike("[0-9]")).distinct()


def frequency(toks: DataFrame, column: str = "tok") -> DataFrame:
    """(country, tok, df, s1df): records with a token, over all sources and over the first."""
    return toks.select(*RECORD, F.col(column).alias("tok")).distinct().groupBy("country", "tok").agg(F.count(F.lit(1)).alias("df"), F.count_if(F.col("src") == 1).alias("s1df"))


def ranked(toks: DataFrame, freq: DataFrame) -> DataFrame:
    """toks that the first source knows, with rn (rarest first) and cnt; what it doesn't know goes before ranking."""
    rows = toks.join(freq, ["country", "tok"]).filter((F.col("src") == 1) | (F.col("s1df") > 0))
    by = Window.partitionBy(*RECORD)
    return rows.withColumn("rn", F.row_number().over(by.orderBy("df", "tok"))).withColumn("cnt", F.count(F.lit(1)).over(by))


#: Fields that tokens come from, and the field by whose frequencies each is ranked: an alternative name by the main one's.
FIELDS = {"name": "name", "phon": "phon", "addr": "addr", "alt": "name", "alt_phon": "phon"}


def _field_tokens(rec: DataFrame) -> DataFrame:
    """(country, src, idx, field, space, tok): the distinct tokens of every field, in one pass over the records."""
    alt = text.tokens(F.col("name_alt"))
    arrays = {
        "name": text.tokens(F.col("name_core")),
        "phon": text.tokens(F.col("name_phon")),
        "addr": F.filter(text.tokens(F.col("addr_core")), lambda t: ~t.rlike("[0-9]")),
        "alt": alt,
        "alt_phon": F.transform(alt, text.phon),
    }
    items = F.concat(*(_labelled(F.array_distinct(a), f) for f, a in arrays.items()))
    return rec.select(*RECORD, items.alias("all")).select(*RECORD, F.explode_outer("all").alias("x")).select(*RECORD, "x.*").filter("tok is not null")


def _labelled(tokens: Column, field: str) -> Column:
    return F.transform(tokens, lambda t: F.struct(F.lit(field).alias("field"), F.lit(FIELDS[field]).alias("space"), t.alias("tok")))


def ranked_fields(rec: DataFrame) -> DataFrame:
    """(country, src, idx, and per field an array<struct<df, tok, s1df>>, rarest first): the tokens that the first source knows. One aggregation, one join, and one grouping by record for all fields together."""
    toks = _field_tokens(rec)
    freq = toks.filter(F.col("field") == F.col("space")).groupBy("country", "space", "tok").agg(F.count(F.lit(1)).alias("df"), F.count_if(F.col("src") == 1).alias("s1df"))
    rows = toks.join(freq, ["country", "space", "tok"]).filter((F.col("src") == 1) | (F.col("s1df") > 0))
    lists = rows.groupBy(*RECORD).agg(F.collect_list(F.struct("field", "df", "tok", "s1df")).alias("all"))
    return lists.select(*RECORD, *(_of_field(f).alias(f"t_{f}") for f in FIELDS))


def _of_field(field: str) -> Column:
    own = F.filter("all", lambda x: x["field"] == field)
    return F.array_sort(F.transform(own, lambda x: F.struct(x["df"].alias("df"), x["tok"].alias("tok"), x["s1df"].alias("s1df"))))


def _best(ranked_tokens: Column, k: int) -> Column:
    """The k rarest tokens in alphabetical order."""
    return F.array_sort(F.transform(F.slice(ranked_tokens, 1, k), lambda x: x["tok"]))


def _pairs(best: Column, family: str) -> Column:
    """All unordered pairs of tokens; of a single token, that token."""
    pairs = F.flatten(F.transform(best, lambda a, i: F.transform(F.slice(best, i + 2, F.lit(len(KEY_TYPES))), lambda b: F.concat_ws("|", F.lit(family), a, b))))
    return F.when(F.size(best) == 1, F.transform(best, lambda a: F.concat_ws("|", F.lit(family), a))).otherwise(pairs)


def _singles(ranked_tokens: Column) -> Column:
    few = F.filter(F.slice(ranked_tokens, 1, 2), lambda x: x["s1df"] <= SINGLE_DF)
    return F.transform(few, lambda x: F.concat_ws("|", F.lit("S"), x["tok"]))


def _prefix(concat: Column) -> Column:
    return F.when(F.length(concat) >= PREFIX_LEAST, F.array(F.concat_ws("|", F.lit("C"), F.substring(concat, 1, PREFIX)))).otherwise(F.array().cast("array<string>"))


def _joined(family: str, *parts: Column) -> Column:
    """One key of the parts, or none if one is missing."""
    has = parts[0].isNotNull()
    for p in parts[1:]:
        has = has & p.isNotNull()
    return F.when(has, F.array(F.concat_ws("|", F.lit(family), *parts))).otherwise(F.array().cast("array<string>"))


def keys(rec: DataFrame) -> DataFrame:
    """(country, src, idx, h, kt): all keys of all records, each once; made inside the row from its ranked tokens.

    Arrays that are read more than once are columns of their own, and the explode is an outer one: else their expressions would be copied to every place that reads them.
    """
    # shuffles at any size, here and below: files of much repeated values are small, so tables of all records look as if they could be broadcast
    rows = rec.select(*RECORD, "name_alt", "name_concat", "house_num").join(ranked_fields(rec).hint("merge"), RECORD, "left")
    empty = F.array().cast("array<struct<df:bigint,tok:string,s1df:bigint>>")
    t = {f: F.coalesce(F.col(f"t_{f}"), empty) for f in FIELDS}
    most = {"name": 3, "phon": 2, "addr": 3, "alt": 3, "alt_phon": 2}
    rows = rows.withColumns({f"b_{f}": _best(t[f], most[f]) for f in FIELDS} | {f"f_{f}": F.get(t[f], F.lit(0))["tok"] for f in ("name", "addr")})
    alt_concat = F.replace(F.col("name_alt"), F.lit(" "), F.lit(""))
    made = {
        "name_pair": _pairs(F.col("b_name"), "N"),
        "name_single": _singles(t["name"]),
        "name_phon": _pairs(F.col("b_phon"), "P"),
        "concat_prefix": _prefix(F.col("name_concat")),
        "name_alt": F.concat(_pairs(F.col("b_alt"), "N"), _singles(t["alt"]), _pairs(F.col("b_alt_phon"), "P"), _prefix(alt_concat)),
        "addr_pair": _pairs(F.col("b_addr"), "A"),
        "addr_number": _joined("H", F.col("house_num"), F.col("f_addr")),
        "cross": _joined("X", F.col("f_name"), F.col("f_addr")),
    }
    # a key's type is its place in KEY_TYPES
    typed = F.concat(*(_typed(made[n], kt) for kt, n in enumerate(KEY_TYPES)))
    out = rows.select(*RECORD, typed.alias("all")).select(*RECORD, F.explode_outer("all").alias("x"))
    return out.select(*RECORD, "x.h", "x.kt").filter("h is not null")


def _typed(found: Column, kt: int) -> Column:
    return F.transform(F.array_distinct(found), lambda h: F.struct(h.alias("h"), F.lit(kt).cast("tinyint").alias("kt")))


def blocks(all_keys: DataFrame) -> DataFrame:
    """(country, h, n1, nr): distinct first-source records and others of each key."""
    rec = F.struct("src", "idx")
    return all_keys.groupBy("country", "h").agg(F.count_distinct(F.when(F.col("src") == 1, rec)).alias("n1"), F.count_distinct(F.when(F.col("src") > 1, rec)).alias("nr"))


def usable(sizes: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    return sizes.filter((F.col("n1") > 0) & (F.col("nr") > 0) & (F.col("n1") * F.col("nr") <= most))


def candidate_pairs(all_keys: DataFrame, sizes: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """(country, s1, src, idx, bits, nkeys): pairs that share a block that is not oversized; bits are the other side's key types. No block gives more than `most` rows, so no key is hot."""
    kept = all_keys.join(usable(sizes, most).select("country", "h").hint("merge"), ["country", "h"], "left_semi")
    ones = kept.filter("src = 1").select("country", "h", F.col("idx").alias("s1")).distinct()
    others = kept.filter("src > 1").select("country", "h", "src", "idx", "kt")
    rows = ones.join(others.hint("merge"), ["country", "h"])
    return rows.groupBy("country", "s1", "src", "idx").agg(F.bit_or(F.expr("shiftleft(1, cast(kt as int))")).cast("smallint").alias("bits"), F.count_distinct("h").cast("smallint").alias("nkeys"))


def key_stats(all_keys: DataFrame, sizes: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """Blocks, skipped blocks and raw pairs by key type."""
    over = F.col("n1") * F.col("nr") > most
    rows = all_keys.select("country", "h", "kt").distinct().join(sizes.filter("n1 > 0 and nr > 0"), ["country", "h"])
    return rows.groupBy("kt").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(over).alias("n_skipped"), F.sum(F.when(~over, F.col("n1") * F.col("nr")).otherwise(0)).alias("raw_pairs"))


def lost_recall(all_keys: DataFrame, sizes: DataFrame, truth: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """True pairs by whether they share a key at all, and one in a usable block."""
    ones = all_keys.filter("src = 1").select("country", "h", F.col("idx").alias("s1")).distinct()
    others = all_keys.filter("src > 1").select("country", "h", "src", "idx").distinct()
    ok = usable(sizes, most).select("country", "h", F.lit(1).alias("ok"))
    met = truth.join(others, ["country", "src", "idx"]).join(ones, ["country", "s1", "h"]).join(ok, ["country", "h"], "left").groupBy("country", "s1", "src", "idx").agg(F.max(F.coalesce("ok", F.lit(0))).alias("ok"))
    rows = truth.join(met, ["country", "s1", "src", "idx"], "left")
    return rows.agg(F.count(F.lit(1)).alias("n_true"), F.count_if(F.col("ok").isNotNull()).alias("n_any_key"), F.count_if(F.col("ok") == 1).alias("n_usable"))


def lost_recall_of_groups(all_keys: DataFrame, sizes: DataFrame, members: DataFrame, by: list[str], most: int = MOST_PAIRS) -> DataFrame:
    """lost_recall() where the true pairs are all pairs of a first-source record and another in a group, members (country, src, idx, and by) holding a row for each record. Records of a group with the same keys count as one, with their number, so pairs are not listed one by one."""
    home = ["country", *by]
    known = all_keys.join(usable(sizes, most).select("country", "h", F.lit(True).alias("ok")), ["country", "h"], "left")
    lists = known.groupBy(*RECORD).agg(F.array_sort(F.collect_set("h")).alias("any"), F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("h")))).alias("ok"))
    none = F.array().cast("array<string>")
    rows = members.select(*RECORD, *by).dropna(subset=home).join(lists, RECORD, "left").select(*home, (F.col("src") == 1).alias("one"), F.coalesce("any", none).alias("any"), F.coalesce("ok", none).alias("ok"))
    alike = rows.groupBy(*home, "one", "any", "ok").agg(F.count(F.lit(1)).alias("n"))
    side = lambda one, p: alike.filter(F.col("one") == one).select(*home, *(F.col(c).alias(p + c) for c in ("any", "ok", "n")))
    # a shuffle at any size: the lists of keys are no small table
    both = side(True, "s_").hint("merge").join(side(False, "r_"), home).withColumn("n", F.col("s_n") * F.col("r_n"))
    total = lambda c: F.coalesce(F.sum(F.when(F.arrays_overlap(f"s_{c}", f"r_{c}"), F.col("n"))), F.lit(0))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_true"), total("any").alias("n_any_key"), total("ok").alias("n_usable"))


def quick_scores(pairs: DataFrame, rec: DataFrame) -> DataFrame:
    """pairs with sim_name, sim_addr and score; distinct pairs of texts are compared once."""
    cols = ["name_core", "name_alt", "name_phon", "addr_core"]
    one = rec.filter("src = 1").select("country", F.col("idx").alias("s1"), *(F.col(c).alias(f"s_{c}") for c in cols))
    other = rec.filter("src > 1").select("country", "src", "idx", *(F.col(c).alias(f"r_{c}") for c in cols))
    rows = pairs.join(one.hint("merge"), ["country", "s1"]).join(other.hint("merge"), ["country", "src", "idx"])
    tsr = lambda a, b: similarity.token_set_ratio(F.col(a), F.col(b))
    alt = F.when(F.col("r_name_alt") != "", tsr("s_name_core", "r_name_alt")).otherwise(F.lit(0.0).cast("float"))
    rows = rows.withColumns({"sim_name": F.greatest(tsr("s_name_core", "r_name_core"), alt, tsr("s_name_phon", "r_name_phon")), "sim_addr": tsr("s_addr_core", "r_addr_core")})
    return rows.select(*pairs.columns, "sim_name", "sim_addr", (F.col("sim_name") + F.col("sim_addr")).alias("score"))


def with_ranks(pairs: DataFrame, by: str = "score", s: str = "rank_s", r: str = "rank_r") -> DataFrame:
    """Ranks within each first-source record and within each other record, best first, ties by key."""
    return pairs.withColumns(
        {
            s: F.row_number().over(Window.partitionBy("country", "s1").orderBy(F.desc(by), "src", "idx")),
            r: F.row_number().over(Window.partitionBy("country", "src", "idx").orderBy(F.desc(by), "s1")),
        }
    )


def with_counts(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns(
        {
            "n_cand_s1": F.count(F.lit(1)).over(Window.partitionBy("country", "s1")),
            "n_cand_rec": F.count(F.lit(1)).over(Window.partitionBy("country", "src", "idx")),
        }
    )


def prune(pairs: DataFrame, k: int, big_k: int, by: str = "score", s: str = "rank_s", r: str = "rank_r") -> DataFrame:
    """Pairs among a record's k best or a first-source record's big_k best, ranked anew; the old ranks stay as *_all."""
    kept = pairs.filter((F.col(r) <= k) | (F.col(s) <= big_k))
    kept = kept.withColumnRenamed(s, f"{s}_all").withColumnRenamed(r, f"{r}_all")
    return with_counts(with_ranks(kept, by, s, r))


def marked(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label: whether the truth (country, s1, src, idx) has them."""
    known = truth.select("country", "s1", "src", "idx", F.lit(1).alias("_t")).distinct()
    return pairs.join(known, ["country", "s1", "src", "idx"], "left").withColumn("label", F.col("_t").isNotNull().cast("tinyint")).drop("_t")


def f05(tp: Column, predicted: Column, true: Column) -> Column:
    """F with beta 0.5 of one record: 1 if both are empty, 0 if one is."""
    return F.when((predicted == 0) & (true == 0), 1.0).when((predicted == 0) | (true == 0), 0.0).otherwise(1.25 * tp / (predicted + 0.25 * true))


def oracle_score(marked_pairs: DataFrame, truth: DataFrame, ones: DataFrame) -> DataFrame:
    """The macro score of a perfect choice among candidates; ones (country, s1) are all first-source records."""
    hits = marked_pairs.groupBy("country", "s1").agg(F.sum(F.col("label").cast("long")).alias("tp"))
    sizes = truth.groupBy("country", "s1").agg(F.count(F.lit(1)).alias("t"))
    rows = ones.join(sizes, ["country", "s1"], "left").join(hits, ["country", "s1"], "left").na.fill(0, ["t", "tp"])
    return rows.agg(F.avg(f05(F.col("tp"), F.col("tp"), F.col("t"))).alias("oracle"), F.sum("tp").alias("n_found"))


def tune(marked_pairs: DataFrame, truth: DataFrame, ones: DataFrame, ks=GRID_K, big_ks=GRID_BIG_K, tolerance: float = TOLERANCE, r: str = "rank_r", s: str = "rank_s") -> DataFrame:
    """Every cell of the grid in one pass: pairs kept, the oracle score, and whether it is the choice: the fewest pairs within the tolerance of the best score."""
    cells = list(product(ks, big_ks))
    keep = {c: (F.col(r) <= c[0]) | (F.col(s) <= c[1]) for c in cells}
    agg = [x for i, c in enumerate(cells) for x in (F.count_if(keep[c]).alias(f"n{i}"), F.count_if(keep[c] & (F.col("label") == 1)).alias(f"t{i}"))]
    per = marked_pairs.groupBy("country", "s1").agg(*agg)
    sizes = truth.groupBy("country", "s1").agg(F.count(F.lit(1)).alias("t"))
    rows = ones.join(sizes, ["country", "s1"], "left").join(per, ["country", "s1"], "left").na.fill(0)
    cell = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(b).alias("big_k"), F.col(f"n{i}").alias("n"), f05(F.col(f"t{i}"), F.col(f"t{i}"), F.col("t")).alias("f")) for i, (k, b) in enumerate(cells)))
    table = rows.select(F.explode(cell).alias("c")).groupBy("c.k", "c.big_k").agg(F.sum("c.n").alias("n_pairs"), F.avg("c.f").alias("oracle"))
    whole = Window.partitionBy()
    near = F.col("oracle") >= F.max("oracle").over(whole) - tolerance
    table = table.withColumn("_near", near)
    best = F.min(F.when(F.col("_near"), F.struct("n_pairs", "k", "big_k"))).over(whole)
    return table.withColumn("chosen", best == F.struct("n_pairs", "k", "big_k")).drop("_near")


def candidate_report(pairs: DataFrame, ones: DataFrame) -> DataFrame:
    """Candidates per first-source record by country, those without any included."""
    n = pairs.groupBy("country", "s1").agg(F.count(F.lit(1)).alias("n"))
    rows = ones.join(n, ["country", "s1"], "left").na.fill(0, ["n"])
    return rows.groupBy("country").agg(F.count(F.lit(1)).alias("n_s1"), F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.95).alias("p95"), F.max("n").alias("most"))


def found_by_type(marked_pairs: DataFrame) -> DataFrame:
    """True pairs that each key type finds, and that it alone finds."""
    bits = F.col("bits").cast("int")
    rows = marked_pairs.filter("label = 1").select(F.explode(F.array(*(F.struct(F.lit(i).alias("kt"), F.shiftright(bits, i).bitwiseAND(1).alias("found"), (bits == 1 << i).cast("int").alias("alone")) for i in range(len(KEY_TYPES))))).alias("x"))
    return rows.groupBy("x.kt").agg(F.sum("x.found").alias("n_found"), F.sum("x.alone").alias("n_alone"))


def missed_profile(truth: DataFrame, pairs: DataFrame, flags: DataFrame) -> DataFrame:
    """True pairs that blocking misses, by country and source, with the rates of the records' flags (country, src, idx, flag columns)."""
    missed = truth.join(pairs.select("country", "s1", "src", "idx"), ["country", "s1", "src", "idx"], "left_anti").join(flags, ["country", "src", "idx"])
    names = [c for c in flags.columns if c not in RECORD]
    return missed.groupBy("country", "src").agg(F.count(F.lit(1)).alias("n_missed"), *(F.avg(F.col(c).cast("double")).alias(f"rate_{c}") for c in names))


def countries(rec: DataFrame) -> DataFrame:
    return rec.filter("src = 1").select("country").distinct()
