"""Records from raw names and addresses: fields that blocking and features read."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text


def _by_country(table: dict[str, dict[str, str]], country: Column, key) -> Column:
    """What the country's table has for key(); null where it has nothing."""
    out = F.lit(None).cast("string")
    for name in rules.COUNTRIES:
        if table[name]:
            pairs = F.create_map(*(F.lit(x) for kv in table[name].items() for x in kv))
            out = F.when(country == name, F.try_element_at(pairs, key)).otherwise(out)
    return out


def vocabulary(records: DataFrame) -> DataFrame:
    """(country, tok, n): tokens of cleaned first-source names."""
    return records.filter("src = 1").select("country", F.explode(text.tokens(F.col("name_clean"))).alias("tok")).groupBy("country", "tok").agg(F.count(F.lit(1)).alias("n"))


def segment(token: str, logp: dict[str, float], longest: int) -> list[str] | None:
    """The likeliest cut of a token into two or more known words; None if there is none or its pieces are short."""
    best: list[tuple[float, int] | None] = [(0.0, 0)] + [None] * len(token)
    for end in range(rules.SEGMENT_PIECE, len(token) + 1):
        for start in range(max(0, end - longest), end - rules.SEGMENT_PIECE + 1):
            if best[start] is not None and (p := logp.get(token[start:end])) is not None:
                score = best[start][0] + p
                if best[end] is None or score > best[end][0]:
                    best[end] = (score, start)
    if best[-1] is None:
        return None
    pieces, end = [], len(token)
    while end:
        start = best[end][1]
        pieces.append(token[start:end])
        end = start
    return pieces[::-1] if len(pieces) > 1 and len(token) / len(pieces) >= rules.SEGMENT_AVERAGE else None


def segments(unknown: DataFrame, vocab: DataFrame) -> DataFrame:
    """(country, tok, pieces): the cut of each distinct unknown token (country, tok), by its country's vocabulary, one country at a time in a task."""
    totals = vocab.groupBy("country").agg(F.sum("n").alias("total"))
    words = vocab.join(totals, "country").filter((F.length("tok") >= rules.SEGMENT_PIECE) & (F.col("n") >= rules.SEGMENT_COUNT))
    # only words that occur inside some unknown token travel, and each token meets its own substrings only, none longer than the longest word
    longest = words.agg(F.max(F.length("tok"))).first()[0] or rules.SEGMENT_PIECE
    spans = unknown.select("country", "tok", F.explode(F.transform(F.sequence(F.lit(1), F.length("tok") - rules.SEGMENT_PIECE + 1), lambda i: F.transform(F.sequence(F.lit(rules.SEGMENT_PIECE), F.greatest(F.lit(rules.SEGMENT_PIECE), F.least(F.lit(longest), F.length("tok") - i + 1))), lambda n: F.substring(F.col("tok"), i, n)))).alias("row"))
    parts = spans.select("country", "tok", F.explode("row").alias("word")).distinct()
    met = parts.join(words.select("country", F.col("tok").alias("word"), (F.log(F.col("n") / F.col("total"))).alias("p")), ["country", "word"])
    grouped = met.groupBy("country", "tok").agg(F.map_from_entries(F.collect_list(F.struct("word", "p"))).alias("words"))

    @F.pandas_udf("array<string>")
    def cut(token: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([segment(t, dict(w), max(map(len, dict(w)))) for t, w in zip(token, known)])

    return grouped.select("country", "tok", cut("tok", "words").alias("pieces")).filter("pieces is not null")


def unglued(rows: DataFrame, vocab: DataFrame, column: str) -> DataFrame:
    """rows with the array column's glued tokens replaced by their pieces; rows (country, src, idx, ..). First-source records stay as they are."""
    frequent = vocab.filter((F.length("tok") >= rules.SEGMENT_PIECE) & (F.col("n") >= rules.SEGMENT_COUNT)).select("country", "tok")
    places = rows.filter("src > 1").select("country", "src", "idx", F.posexplode(column).alias("at", "tok"))
    strange = places.filter((F.length("tok") >= rules.SEGMENT_TOKEN) & ~F.col("tok").rlike("^[0-9]+$")).select("country", "tok").distinct().join(frequent, ["country", "tok"], "left_anti")
    new = places.join(segments(strange, vocab), ["country", "tok"], "left").withColumn("pieces", F.coalesce("pieces", F.array("tok")))
    whole = new.groupBy("country", "src", "idx").agg(F.array_sort(F.collect_list(F.struct("at", "pieces"))).alias("x")).select("country", "src", "idx", F.flatten(F.col("x.pieces")).alias("_new"))
    return rows.join(whole, ["country", "src", "idx"], "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def name_fields(rows: DataFrame, vocab: DataFrame | None = None, known: dict[str, str] | None = None) -> DataFrame:
    """rows (country, src, idx, name_raw, ..) with name_clean, name_core, name_alt, name_concat, name_phon and the name's flags; vocab turns on the segmentation of glued words, known is the learned dictionary of Indic words."""
    rows = rows.withColumn("name_clean", text.clean(F.col("name_raw"), known=known))
    base = text.clean(text.without_tags(F.col("name_raw")), known=known)
    rows = rows.withColumn("_x", F.array_join(F.transform(text.tokens(base), text.unleet), " "))
    main, after, found = text.marker_split(F.col("_x"))
    rows = rows.withColumns({"_main": text.tokens(main), "_after": text.tokens(after), "name_has_marker": found})
    if vocab is not None:
        for column in ("_main", "_after"):
            glued = unglued(rows, vocab, column)
            rows = glued
    core = text.core_tokens(F.col("_main"))
    plain = F.filter("_main", lambda t: ~t.isin(rules.HONORIFICS))
    core = F.when(F.size(core) > 0, core).when(F.size(plain) > 0, plain).otherwise(F.col("_main"))
    rows = rows.withColumn("_core", core)
    return rows.withColumns(
        {
            "name_core": F.array_join("_core", " "),
            "name_alt": F.array_join(text.core_tokens(F.col("_after")), " "),
            "name_concat": F.array_join("_core", ""),
            "name_phon": F.array_join(F.transform("_core", text.phon), " "),
            "name_has_indic": text.has_indic(F.col("name_raw")),
            "name_is_web": text.is_web(F.col("name_raw")),
        }
    ).drop("_x", "_main", "_after", "_core")


def _phrase(tokens: Column, phrases: list[str]) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).rlike(" (?:" + "|".join(phrases) + ") ")


def address_fields(rows: DataFrame, known: dict[str, str] | None = None, states: dict[str, str] | None = None) -> DataFrame:
    """rows (country, addr_raw, ..) with addr_clean, addr_core, state, addr_nums, house_num and the address's flags; known and states are the learned dictionaries of Indic words and of whole components.

    The last component that is a state as a whole gives the state and goes; abbreviations are written out, two-token ones first.
    """
    cleaned = text.clean(F.col("addr_raw"), True, known, states)
    comps = F.transform(F.split(cleaned, ","), lambda c: F.array_join(F.filter(F.split(c, " "), lambda t: (t != "null") & (t != "")), " "))
    rows = rows.withColumn("_c", F.filter(comps, lambda c: (c != "") & ~c.isin(rules.PLACEHOLDERS)))
    country = F.col("country")
    rows = rows.withColumn("_s", F.transform("_c", lambda c: F.coalesce(_by_country(rules.STATES, country, c), F.lit(""))))
    last = F.array_max(F.transform("_s", lambda s, i: F.when(s != "", i).otherwise(F.lit(-1))))
    rows = rows.withColumn("_at", F.coalesce(last, F.lit(-1)))
    kept = F.filter("_c", lambda c, i: i != F.col("_at"))
    rows = rows.withColumns({"state": F.when(F.col("_at") >= 0, F.get("_s", F.col("_at"))).otherwise(F.lit("")), "_raw": text.tokens(F.array_join(kept, " "))})
    joined = F.array_join("_raw", " ")
    for name, table in rules.BIGRAM_ABBREVIATIONS.items():
        for short, long in table.items():
            # spaces inside what a pair stands for are held back, so that its words are not looked up again
            joined = F.when(country == name, F.regexp_replace(joined, rf"(?<![^ ]){short}(?![^ ])", long.replace(" ", "\u0001"))).otherwise(joined)
    full = F.transform(text.tokens(joined), lambda t: F.coalesce(_by_country(rules.ABBREVIATIONS, country, t), t))
    rows = rows.withColumn("_t", text.tokens(F.translate(F.array_join(full, " "), "\u0001", " ")))
    numbers = F.transform(F.regexp_extract_all(F.array_join("_t", " "), F.lit("[0-9]+"), F.lit(0)), lambda d: F.regexp_replace(d, "^0+(?=[0-9])", ""))
    rows = rows.withColumn("_n", numbers)
    return rows.withColumns(
        {
            "addr_clean": F.array_join("_c", " "),
            "addr_core": F.array_join("_t", " "),
            "addr_nums": F.array_join("_n", " "),
            "house_num": F.get("_n", F.lit(0)),
            "addr_empty": F.size("_c") == 0,
            "addr_has_landmark": F.arrays_overlap(F.concat("_raw", "_t"), F.array(*map(F.lit, rules.LANDMARK_WORDS))) | _phrase(F.col("_t"), rules.LANDMARK_PHRASES),
            "addr_has_pobox": _phrase(F.col("_raw"), rules.POBOX_PHRASES),
        }
    ).drop("_c", "_s", "_at", "_raw", "_t", "_n")


def records(raw: DataFrame, segmented: bool = True, known: dict[str, str] | None = None, states: dict[str, str] | None = None) -> DataFrame:
    """The records relation from raw rows (src, idx, entity_id, country, name_raw, addr_raw); known and states are learned (translit_learn)."""
    vocab = None
    if segmented:
        ones = raw.filter("src = 1").withColumn("name_clean", text.clean(F.col("name_raw"), known=known))
        vocab = vocabulary(ones)
    return address_fields(name_fields(raw, vocab, known), known, states)
