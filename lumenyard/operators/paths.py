"""Fields of untyped rows (VARIANT): every leaf by its dotted path, with absent and null told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenyard.functions.text import let

DEPTH = 8  # levels below the row; what lies deeper is left out


def _entry(path: Column, value: Column, leaf: bool = False) -> Column:
    return F.struct(path.alias("path"), value.alias("v"), F.lit(leaf).alias("leaf"))


def _members(value: Column) -> Column:
    """The members of an object as a map, else null."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _items(value: Column) -> Column:
    """The items of an array, else null."""
    return F.try_variant_get(value, "$", "array<variant>")


def _below(path: Column, name: Column) -> Column:
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))


def _opened(entry: Column) -> Column:
    """An entry's members or items, each with its path; an entry that has none is a leaf, and stays as it is."""
    path = entry["path"]

    def parts(own: Column) -> Column:
        members, items, value = own["members"], own["items"], own["v"]
        of_object = F.transform(F.map_entries(members), lambda m: _entry(_below(path, m["key"]), m["value"]))
        # an array is one field: its items share a path, and one without a member in it is a leaf
        bare = lambda x: F.coalesce(F.size(_members(x)) == 0, F.lit(False))
        below = _below(path, F.lit("[]"))
        many = lambda xs: F.when(F.size(xs) > 0, F.transform(xs, lambda x: _entry(below, x))).otherwise(F.array(_entry(below, F.parse_json(F.lit("null")))))
        return F.when(members.isNotNull(), of_object).when(items.isNotNull(), let(F.filter(items, lambda x: ~bare(x)), many)).otherwise(F.array(_entry(path, value, True)))

    value = entry["v"]
    return F.when(entry["leaf"], F.array(entry)).otherwise(let(F.struct(_members(value).alias("members"), _items(value).alias("items"), value.alias("v")), parts))


def _leaf(entry: Column) -> Column:
    path, value = entry["path"], entry["v"]
    kind = lambda name: F.when(name == "VOID", "null").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(F.startswith(name, F.lit("ARRAY")), "array").when(F.rlike(name, F.lit("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")), "number").otherwise("string")

    def typed(kind: Column) -> Column:
        deep = F.when(kind == "array", _below(path, F.lit("[]"))).otherwise(path)
        text = F.when(~kind.isin("null", "array"), F.try_variant_get(value, "$", "string"))
        return F.struct(deep.alias("path"), kind.alias("kind"), text.alias("text"), F.when(kind == "number", F.try_variant_get(value, "$", "double")).alias("number"))

    return let(let(F.schema_of_variant(value), kind), typed)


def value_at(row: Column, path: Column) -> Column:
    """The value at a dotted path, which may differ from row to row; of an array ([]) the first item; null if there is none."""
    step = lambda v, name: F.when(name == "[]", F.get(_items(v), F.lit(0))).otherwise(F.try_element_at(_members(v), name))
    return F.aggregate(F.split(path, "[.]"), row, step)


def leaves(row: Column, depth: int = DEPTH) -> Column:
    """array<struct<path, kind, text, number>> of a variant: kind is string, number, boolean, null or array.

    A key that is absent gives nothing, one that is null a leaf of kind null. Items of an array share the
    path with [] in it; an empty array is a null leaf there. Objects without members give nothing. A row
    that is a plain value, or null, has no fields.
    """
    entries = F.array(_entry(F.lit(""), row))
    for _ in range(depth):
        entries = F.flatten(F.transform(entries, _opened))
    ends = F.filter(entries, lambda e: (e["path"] != "") & (e["leaf"] | _members(e["v"]).isNull()))
    return F.coalesce(F.transform(ends, _leaf), F.array().cast("array<struct<path:string,kind:string,text:string,number:double>>"))


def cells(rows: DataFrame, row: str, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """keys, path, kind, text, number: one row for each leaf of each row, in one pass without a shuffle."""
    return rows.select(*keys, F.explode(leaves(F.col(row), depth)).alias("c")).select(*keys, "c.*")


def leaf_paths(rows: DataFrame, row: str, keys: list[str] | None = None) -> DataFrame:
    """keys, path, kinds (map: how many values of each kind) and n over all rows: the union of their leaf paths."""
    keys = keys or []
    counts = cells(rows, row, keys).groupBy(*keys, "path", "kind").agg(F.count("*").alias("c"))
    return counts.groupBy(*keys, "path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "c")))).alias("kinds"), F.sum("c").alias("n"))
