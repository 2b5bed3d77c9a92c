"""Keeping the best of several records, fair batches over hosts, and ranked search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Other words for an interest, which count as whole words only.
ALIASES = {
    "artificial intelligence": ["ai", "machine learning", "ml", "deep learning"],
    "machine learning": ["ml", "ai", "artificial intelligence"],
    "computer science": ["cs", "computing", "software"],
    "data science": ["data", "analytics"],
    "robotics": ["robot"],
    "biotechnology": ["biotech"],
    "renewable energy": ["clean energy", "solar", "wind"],
}


def keep_first(rows: DataFrame, keys: list[Column], *order: Column) -> DataFrame:
    """One row for each key, the first by the given order. Only the order's least row of each task is shuffled."""
    key = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    own = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")
    return rows.groupBy(*key).agg(own).select("r.*")


def last_n(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each key by the given order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def round_robin(entries: DataFrame, host: str, per_host: int, limit: int, *order: Column) -> DataFrame:
    """A batch that takes hosts in turn: every host's first entry, then every second one, up to a limit.

    Hosts take turns in the order of their names. Ranks are found per host; only per_host rows of each
    host go on, and the final limit is a top-k that no task needs to see whole.
    """
    place = F.row_number().over(Window.partitionBy(host).orderBy(*order))
    return entries.withColumn("turn", place).filter(F.col("turn") <= per_host).orderBy("turn", host, *order).limit(limit)


def merge_results(results: DataFrame, limit: int = 12, per_host: int = 2, per_official: int = 5, ties: tuple[str, ...] = ()) -> DataFrame:
    """One list of several searches' results (batch, pos, url, host, official): by position, then batch, then ties.

    A url counts once, a host as often as it may; official hosts get the first 60 % of places, others the
    next, and official ones any that are left. One that is not known to be official is not.
    """
    order = ["pos", "batch", *ties]
    results = results.withColumn("official", F.coalesce("official", F.lit(False)))
    once = keep_first(results, [F.col("url")], *map(F.col, order))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(*order))
    once = once.withColumn("of_host", rank).filter(F.col("of_host") <= F.when(F.col("official"), per_official).otherwise(per_host))
    slots = -(-limit * 6 // 10)
    # at most limit rows of either kind can be taken; these few are ranked in one place
    few = lambda official: once.filter(F.col("official") == official).orderBy(*order).limit(limit)
    ranked = few(True).unionByName(few(False)).withColumn("nth", F.row_number().over(Window.partitionBy("official").orderBy(*order)))
    turn = F.when(F.col("official") & (F.col("nth") <= slots), 0).when(~F.col("official"), 1).otherwise(2)
    return ranked.withColumn("turn", turn).orderBy("turn", *order).limit(limit)


def mentions(haystack: Column, interest: str) -> Column:
    """Whether lower-case text names an interest, or one of its other words as a whole word."""
    term = interest.strip().lower()
    out = F.contains(haystack, F.lit(term)) if term else F.lit(False)
    if aliases := ALIASES.get(term, []):
        # one pass for all, and none where no text holds any
        holds = reduce(Column.__or__, (F.contains(haystack, F.lit(a)) for a in aliases))
        out = out | F.when(holds, F.rlike(haystack, F.lit(f"(?:^|[^A-Za-z0-9_])(?:{'|'.join(aliases)})(?:$|[^A-Za-z0-9_])"))).otherwise(F.when(haystack.isNotNull(), False))
    return out


def search(rows: DataFrame, text: Column, terms: list[str], bonus: Column, key: str, limit: int = 60) -> DataFrame:
    """The rows that score best: one for each word of the terms (over two letters) in the text, one for an
    interest named by another word, and a bonus of their own. Ties by key."""
    import re

    words = [w for t in terms for w in re.split("[^a-z0-9]+", t.lower()) if len(w) > 2]
    low = F.lower(text)
    score = F.lit(1.0) + bonus
    for w in words:
        score = score + F.when(F.contains(low, F.lit(w)), 1.0).otherwise(0.0)
    named = F.lit(False)
    for t in terms:
        named = named | mentions(low, t)
    score = score + F.when(named, 1.0).otherwise(0.0)
    return rows.withColumn("score", score).orderBy(F.desc("score"), key).limit(limit)
