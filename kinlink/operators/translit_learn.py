"""Learning the transliteration dictionary and the state map from true pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules, text
from ..functions.similarity import ratio_of
from ..functions.translit import component_key, romanize, token_key

LEAST, SHARE = 3, 0.6
SIMILAR, SAME = 50.0, 80.0


@F.pandas_udf(T.StringType())
def _key(x: pd.Series) -> pd.Series:
    return x.map(lambda v: v if v is None else token_key(v))


@F.pandas_udf(T.StringType())
def _component(x: pd.Series) -> pd.Series:
    return x.map(lambda v: v if v is None else component_key(v))


@F.pandas_udf(T.StringType())
def _closest(token: pd.Series, others: pd.Series) -> pd.Series:
    """The first of others most like the token's romanisation, if it is like it at all."""

    def best(t, options):
        scored = [(ratio_of(romanize(token_key(t)), o), -i, o) for i, o in enumerate(options)]
        top = max(scored, default=(0.0, 0, None))
        return top[2] if top[0] >= SIMILAR else None

    return pd.Series([best(t, o) for t, o in zip(token, others)])


def without_honorifics(x: Column) -> Column:
    joined = F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(x, " ", "  "), F.lit(" ")), " m  s ", " ")
    return F.filter(F.split(F.trim(joined), " +"), lambda t: (t != "") & ~t.isin(rules.HONORIFICS))


def aligned(pairs: DataFrame) -> DataFrame:
    """(key, latin): tokens of true pairs (noisy, s1) with Indic letters and what they stand for: by place if both names have as many tokens, else the most similar one."""
    rows = pairs.select(without_honorifics(F.col("noisy")).alias("n"), without_honorifics(F.col("s1")).alias("l")).filter(F.size("l") > 0)
    toks = rows.select("l", (F.size("n") == F.size("l")).alias("even"), F.posexplode("n").alias("at", "tok")).filter(text.has_indic(F.col("tok")))
    by_place = toks.filter("even").select(_key("tok").alias("key"), F.get("l", F.col("at")).alias("latin"))
    by_sound = toks.filter(~F.col("even")).select("tok", "l").distinct().withColumn("latin", _closest("tok", "l"))
    odd = toks.filter(~F.col("even")).join(by_sound, ["tok", "l"]).filter("latin is not null").select(_key("tok").alias("key"), "latin")
    return by_place.unionByName(odd)


def kept(votes: DataFrame) -> DataFrame:
    """(key, value, n): of votes (key, value) the most frequent value of each key, if it is frequent and dominant; the first by name among equals."""
    counts = votes.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("key").orderBy(F.desc("n"), "value")
    rows = counts.withColumn("total", F.sum("n").over(Window.partitionBy("key"))).withColumn("r", F.row_number().over(order))
    return rows.filter((F.col("r") == 1) & (F.col("n") >= LEAST) & (F.col("n") / F.col("total") >= SHARE)).select("key", "value", "n")


def learn_tokens(pairs: DataFrame) -> DataFrame:
    return kept(aligned(pairs).select("key", F.col("latin").alias("value")))


@F.pandas_udf(T.BooleanType())
def _like_any(component: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([any(ratio_of(romanize(token_key(c)), o) >= SAME for o in options) for c, options in zip(component, others)])


def learn_states(pairs: DataFrame) -> DataFrame:
    """(key, value, n): native components of true pairs (noisy_addr, s1_components, state) and the state they stand for; a component that sounds like another component of the first source's address is no vote."""
    rows = pairs.filter("state <> ''").select("state", "s1_components", F.explode(F.split("noisy_addr", ",")).alias("c")).filter(text.has_indic(F.col("c")))
    rows = rows.filter(~_like_any("c", "s1_components"))
    return kept(rows.select(_component("c").alias("key"), F.col("state").alias("value")))
