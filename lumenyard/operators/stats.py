"""Robust statistics of groups, in partial aggregates that Spark combines before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAD_SCALE = 1.4826
SPLITS = 32  # ranges over which the values of a group are spread


def counted(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, x, c: how often each group has each value; nulls do not count."""
    return rows.select(*keys, value.cast("double").alias("x")).filter("x is not null").groupBy(*keys, "x").agg(F.count("*").alias("c"))


def beside(rows: DataFrame, groups: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
    """rows with the columns of their group, of which groups has one row; a null key is a group, no keys are one.

    few: there are no more groups than a driver can hold, so that rows need not be shuffled by them, which would
    leave as many tasks as there are groups.
    """
    if not keys:
        return rows.crossJoin(F.broadcast(groups))  # one row
    renamed = groups.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return rows.join(F.broadcast(renamed) if few else renamed, same).drop(*(f"__{k}" for k in keys))


def merged(rows: DataFrame, others: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined with others where both grow with the input: sorted and merged, never broadcast. What Spark takes a
    filtered, exploded or aggregated table for before it has run is far below what the driver would have to hold."""
    return rows.join(others.hint("merge"), on, how)


def quantiles(counts: DataFrame, keys: list[str], wanted: dict[str, float], splits: int = SPLITS, few: bool = False) -> DataFrame:
    """keys, n and exact quantiles (with linear interpolation, by name) of values that are counted (keys, x, c).

    A group's values are dealt to ranges at approximate quantiles, which only have to be near enough to share
    the work. The ranges' exact sums tell which of them hold the wanted ranks, and only their values are put
    in order, one task for a range. What lies below a range is taken from the same sums as its bounds, so a
    plan that is run again in part stays right. few: see beside().
    """
    counts = counts.select(*keys, "x", "c")
    cuts = [k / splits for k in range(1, splits)]
    edges = counts.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("x", cuts, F.lit(20 * splits))).alias("edges"))
    dealt = beside(counts, edges, keys, few).withColumn("part", F.size(F.filter("edges", lambda e: e <= F.col("x"))))
    low, high = F.try_element_at("edges", F.col("part")), F.get("edges", F.col("part"))
    low = F.when(F.col("part") > 0, low)
    # the bounds are keys and not an array to carry along, for which Spark would sort all values before it sums
    sums = dealt.groupBy(*keys, "part", low.alias("low"), high.alias("high")).agg(F.sum("c").alias("size"))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # as many rows as splits in a group
    sums = sums.withColumns({"before": F.sum("size").over(own.orderBy("part")) - F.col("size"), "n": F.sum("size").over(own)})
    place = {name: (F.col("n") - 1) * min(1.0, max(0.0, q)) for name, q in wanted.items()}
    ranks = F.array(*(f(p).cast("bigint") for p in place.values() for f in (F.floor, F.ceil)))
    sums = sums.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("size"))))
    # two ranges for each quantile of a group at most
    asked = sums.filter(F.size("ranks") > 0).groupBy(*keys).agg(F.collect_list(F.struct("part", "low", "high", "before", "ranks", "n")).alias("asked"))
    holds = lambda r: (r["low"].isNull() | (r["low"] <= F.col("x"))) & (r["high"].isNull() | (F.col("x") < r["high"]))
    inside = beside(counts, asked, keys, few).select(*keys, "x", "c", F.explode(F.filter("asked", holds)).alias("r")).select(*keys, "x", "c", "r.*")
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "part").orderBy("x"))
    inside = inside.withColumn("upto", upto).withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("c")) & (r < F.col("upto"))))
    at = inside.filter(F.size("ranks") > 0).groupBy(*keys).agg(F.first("n").alias("n"), F.map_from_entries(F.array_distinct(F.flatten(F.collect_set(F.transform("ranks", lambda r: F.struct(r, F.col("x"))))))).alias("at"))

    def value(p: Column) -> Column:
        low, high = (F.try_element_at("at", f(p).cast("bigint")) for f in (F.floor, F.ceil))
        return low + (high - low) * (p - F.floor(p))

    found = at.select(*keys, "n", *(value(p).alias(name) for name, p in place.items()))
    return found if keys else found.filter("n is not null")


def sample_confidence(n: Column) -> Column:
    """0 up to one sample, then rising towards 0.95."""
    return F.when(n <= 1, 0.0).otherwise(F.least(F.lit(0.95), 1 - 5 / (n + 4)))


def deviations(counts: DataFrame, keys: list[str], centres: DataFrame, few: bool = False) -> DataFrame:
    """keys and mad: the scaled median distance of counted values (keys, x, c) from their group's med."""
    away = beside(counts, centres.select(*keys, "med"), keys, few).groupBy(*keys, F.abs(F.col("x") - F.col("med")).alias("x")).agg(F.sum("c").alias("c"))
    return quantiles(away, keys, {"mad": 0.5}, few=few).withColumn("mad", F.col("mad") * MAD_SCALE).drop("n")


def centre_and_spread(rows: DataFrame, keys: list[str], value: str, few: bool = False) -> DataFrame:
    """keys, n, med and mad (scaled median absolute deviation) of a numeric column; nulls do not count."""
    counts = counted(rows, keys, F.col(value))
    centre = quantiles(counts, keys, {"med": 0.5}, few=few)
    mad = deviations(counts, keys, centre, few)
    return beside(centre, mad, keys).select(*keys, "n", "med", "mad")


def robust_z(value: Column, med: Column, mad: Column) -> Column:
    """Deviations from the median; null where all values were alike."""
    return F.abs(value - med) / F.nullif(mad, F.lit(0.0))


def departures(rows: DataFrame, keys: list[str], value: str, threshold: float) -> DataFrame:
    """The rows whose value lies over threshold robust deviations from the median of their group, with z.

    Groups are few (one row each after aggregation) and broadcast.
    """
    learned = F.broadcast(centre_and_spread(rows, keys, value, few=True))
    z = robust_z(F.col(value), F.col("med"), F.col("mad"))
    return rows.join(learned, keys).withColumn("z", z).filter(F.col("z") > threshold)


def histogram(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """keys and a map from value to count, counted before the map is built."""
    counts = rows.groupBy(*keys, value.alias("v")).agg(F.count("*").alias("n")).filter("v is not null")
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("v", "n"))))
    return counts.groupBy(*keys).agg(entries.alias(name))


def unique_ratio(value: Column) -> Column:
    """Distinct values among all that are not null; null if there are none."""
    return F.count_distinct(value) / F.nullif(F.count(value), F.lit(0))


def first_least(value: Column, *order: Column) -> Column:
    """The value of the row that comes first by the given order."""
    return F.min_by(value, F.struct(*order))


def dice(a: Column, b: Column) -> Column:
    """Shared members of two arrays, counted as often as both have them, over their mean size; 1 if both are empty."""
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(2 * shared / (F.size(a) + F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members; null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
