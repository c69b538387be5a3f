"""Group-consistency features over first-stage probabilities: what a pair's neighbours on both sides say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ONE = ["country", "s1"]
PAIR = ["country", "s1", "src", "idx"]


def _others(part: list[str], key: str, p: str) -> dict[str, Column]:
    """Among a first-source record's other candidates with the same key: how many, their sum and largest p; null where the key is null or empty."""
    by = Window.partitionBy(*part, key)
    order = by.orderBy(F.desc(p), "src", "idx")
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    has = F.col(key).isNotNull() & (F.col(key) != "")
    best = F.when(F.row_number().over(order) == 1, F.nth_value(p, 2).over(full)).otherwise(F.first_value(p).over(full))
    return {
        f"s_n_same_{key}": F.when(has, F.count(F.lit(1)).over(by) - 1),
        f"s_sum_same_{key}": F.when(has, F.sum(p).over(by) - F.col(p)),
        f"s_max_same_{key}": F.when(has, best),
    }


def side_features(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Rank, gap, sum and confident count per first-source record; best other and plausible count per record."""
    by_one, by_rec = Window.partitionBy(*ONE), Window.partitionBy("country", "src", "idx")
    order = by_rec.orderBy(F.desc(p), "s1")
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return pairs.withColumns(
        {
            "s_rank_p": F.row_number().over(by_one.orderBy(F.desc(p), "src", "idx")),
            "s_gap_maxp": F.max(p).over(by_one) - F.col(p),
            "s_sum_p": F.sum(p).over(by_one),
            "s_cnt_p50": F.sum((F.col(p) >= 0.5).cast("int")).over(by_one),
            "r_oth_maxp": F.when(F.row_number().over(order) == 1, F.nth_value(p, 2).over(full)).otherwise(F.first_value(p).over(full)),
            "r_cnt_p10": F.sum((F.col(p) >= 0.1).cast("int")).over(by_rec),
        }
    )


def shared_key_features(pairs: DataFrame, keys: tuple[str, ...] = ("house", "name", "addr"), p: str = "p") -> DataFrame:
    for key in keys:
        pairs = pairs.withColumns(_others(ONE, key, p))
    return pairs


def modal_house(pairs: DataFrame, p: str = "p") -> DataFrame:
    """pairs with r_house_is_mode (is the record's house the heaviest of the first-source record's candidates; among equals the last by name) and s_pshare_r_house (its share of all p; null if that is 0)."""
    houses = pairs.filter("house is not null").groupBy(*ONE, "house").agg(F.sum(p).alias("sp"))
    mode = houses.groupBy(*ONE).agg(F.max_by("house", F.struct(F.round("sp", 9), "house")).alias("mode"))
    total = pairs.groupBy(*ONE).agg(F.sum(p).alias("total"))
    rows = pairs.join(houses, [*ONE, "house"], "left").join(mode, ONE, "left").join(total, ONE)
    return rows.withColumns({"r_house_is_mode": F.coalesce(F.col("house") == F.col("mode"), F.lit(False)).cast("int"), "s_pshare_r_house": F.when(F.col("total") != 0, F.col("sp") / F.col("total"))}).drop("sp", "mode", "total")


def group_sizes(pairs: DataFrame, rec: DataFrame) -> DataFrame:
    """pairs with the sizes, over the whole split, of the groups that share name and house, or name and address, with either record; 0 where a key is missing. rec (country, src, idx, name, house, addr)."""
    has = lambda *cols: " and ".join(f"{c} is not null and {c} <> ''" for c in cols)
    others, ones = rec.filter("src > 1"), rec.filter("src = 1")
    nh = others.filter(has("name", "house")).groupBy("name", "house").agg(F.count(F.lit(1)).alias("grp_r_name_house"))
    na = others.filter(has("name", "addr")).groupBy("name", "addr").agg(F.count(F.lit(1)).alias("grp_r_name_addr"))
    sh = ones.filter(has("name", "house")).groupBy("name", "house").agg(F.count(F.lit(1)).alias("grp_s_name_house"))
    r = others.join(nh, ["name", "house"], "left").join(na, ["name", "addr"], "left").select("country", "src", "idx", "grp_r_name_house", "grp_r_name_addr")
    s = ones.join(sh, ["name", "house"], "left").select("country", F.col("idx").alias("s1"), "grp_s_name_house")
    return pairs.join(r, ["country", "src", "idx"], "left").join(s, ONE, "left").na.fill(0, ["grp_r_name_house", "grp_r_name_addr", "grp_s_name_house"])


def all_features(pairs: DataFrame, rec: DataFrame, p: str = "p") -> DataFrame:
    """Everything above; p names the probability of the fold model that did not see the pair."""
    return group_sizes(modal_house(shared_key_features(side_features(pairs, p), p=p), p), rec)
