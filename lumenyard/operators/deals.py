"""The best offer taken twice: at face value, and from values that are stood behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenyard.functions import numbers
from lumenyard.operators.paths import value_at

# What fields are called that hold a price, and a name.
PRICE, TITLE = "(?i)price|cost|amount", "(?i)title|name|product"


def deal_fields(collectors: DataFrame, specs: DataFrame) -> DataFrame:
    """collectors with price_path and title_path, from their specs (collector_id, ord, path, kind).

    The price is at the first path of kind money, else the first that is called so, else at price; the title at
    the first path that is called so, else at title. One grouping; order within a collector is ord.
    """
    first = lambda rank: F.min_by(F.when(rank.isNotNull(), F.col("path")), F.when(rank.isNotNull(), F.struct(rank, F.col("ord"), F.col("path"))))
    price = F.when(F.col("kind") == "money", 0).when(F.rlike("path", F.lit(PRICE)), 1)
    title = F.when(F.rlike("path", F.lit(TITLE)), 0)
    found = specs.groupBy("collector_id").agg(first(price).alias("price_path"), first(title).alias("title_path"))
    return collectors.join(found, "collector_id", "left").fillna({"price_path": "price", "title_path": "title"})


def candidates(rows: DataFrame) -> DataFrame:
    """rows (row: variant, price_path, title_path, hint: the collector's currency) with title, price and currency.

    A path with [] reads the first item. A title must be a text; a price may be one.
    """
    out = rows.withColumns({"__price": value_at(F.col("row"), F.col("price_path")), "__title": value_at(F.col("row"), F.col("title_path"))})
    text = lambda c: F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string"))
    number = F.when(~F.schema_of_variant("__price").isin("STRING", "BOOLEAN"), F.try_variant_get("__price", "$", "double"))
    out = out.withColumns({"title": text(F.col("__title")), "__number": number, "__text": text(F.col("__price"))}).withColumn("__money", numbers.money(F.col("__text")))
    price = F.coalesce("__number", F.col("__money.value"))
    out = out.withColumns({"price": price, "currency": F.when(price.isNotNull(), F.coalesce(F.col("__money.currency"), F.upper("hint")))})
    return out.drop("__price", "__title", "__number", "__text", "__money")


def compare_deals(raw: DataFrame, stood_for: DataFrame, group: str, key: str) -> DataFrame:
    """group, naive, verified, currencies, diverged, reason: what either side recommends of each group (null is one, too).

    raw and stood_for: group, key, title, price, currency; prices of 0 and less, and unknown ones, are no offers.
    naive is the least number of raw, whatever its currency. verified is the cheapest of stood_for if all are
    in one currency (unknown counts as one), else null: there is no rate to compare by. Equal prices: least key.
    """
    of_side = lambda df, side: df.select(group, key, "title", "price", "currency", F.when(F.col("price") > 0, side).alias("side"))
    rows = of_side(raw, "raw").unionByName(of_side(stood_for, "stood"))
    of = lambda side, c: F.when(F.col("side") == side, c)
    cheapest = lambda side: F.min_by(F.struct(key, "title", "price", "currency"), of(side, F.struct("price", key)))
    some = lambda side: F.count_if(F.col("side") == side) > 0
    currencies = F.array_sort(F.collect_set(of("stood", F.coalesce("currency", F.lit("unknown")))))
    found = rows.groupBy(group).agg(F.when(some("raw"), cheapest("raw")).alias("naive"), F.when(some("stood"), cheapest("stood")).alias("verified"), currencies.alias("currencies"))
    found = found.withColumn("verified", F.when(F.size("currencies") <= 1, F.col("verified")))
    same = F.col(f"naive.{key}").eqNullSafe(F.col(f"verified.{key}")) & F.col("naive.price").eqNullSafe(F.col("verified.price"))
    reason = F.when(same, None).when(F.size("currencies") > 1, "no rate between currencies").when(F.col("verified").isNull(), "nothing is stood behind").otherwise("another value is stood behind")
    return found.withColumns({"diverged": ~same, "reason": reason})
