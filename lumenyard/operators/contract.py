"""Contracts: profiles learned from healthy rows, declared invariants, and the checks of new rows against both.

Rows may have any columns; a field is a column or a dotted path into structs. Everything about a field is
aggregated in one pass over the rows, which are first turned into long form (path, value) by an
expression, so the cost grows with rows times fields and not with the number of checks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenyard.functions.numbers import loose_number, money
from lumenyard.functions.text import character_shape
from lumenyard.operators import stats
from lumenyard.operators.stats import MAD_SCALE, sample_confidence

ENUM_LIMIT = 12
PRESENCE, NULL_RATE = 0.98, 0.02  # of a required field

# How grave a failed check is.
SEVERITY = {
    "invariant": 1.0,
    "required": 0.9,
    "error": 1.0,
    "empty": 1.0,
    "type": 0.7,
    "currency": 0.8,
    "numeric": 0.5,
    "shape": 0.35,
    "enum": 0.5,
    "row_count": 0.6,
    "unique": 0.6,
}


@dataclass(frozen=True)
class Thresholds:
    z: float = 6.0
    presence: float = 0.9
    row_drop: float = 0.5
    unique: float = 0.9
    samples: int = 3


@dataclass(frozen=True)
class Invariant:
    """kind: required, range, compare, unique, host, enum or currency."""

    kind: str
    field: str
    low: float | None = None
    high: float | None = None
    op: str = ">"
    other: str | None = None
    host: str | None = None
    allowed: tuple[str, ...] = field(default=())


def leaf_fields(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Dotted paths of all columns that are no structs, with their types."""
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += leaf_fields(f.dataType, f"{prefix}{f.name}.")
        else:
            out.append((prefix + f.name, f.dataType))
    return out


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "array" if isinstance(dtype, T.ArrayType) else "string"


def long_form(rows: DataFrame, paths: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, path, kind, text, number: one row for each field of each row; text and number are null where the value is."""
    keys = keys or []
    fields = [(p, t) for p, t in leaf_fields(rows.schema) if (paths is None or p in paths) and p not in keys]
    cells = []
    for path, dtype in fields:
        kind, value = kind_of(dtype), F.col(path)
        text = F.to_json(value) if kind == "array" else value.cast("string")
        number = value.cast("double") if kind == "number" else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(path).alias("path"), F.lit(kind).alias("kind"), text.alias("text"), number.alias("number")))
    return rows.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def profile(rows: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """One row for each field: n, present, null_rate, distinct, types, text lengths, and numeric centre, spread,
    quantiles and extremes.

    Numbers written in text count as numbers. rows are read once, into how often each field has each value;
    all else comes from these counts.
    """
    cells = long_form(rows, paths).groupBy("path", "kind", "text", "number").agg(F.count("*").alias("c"))
    number = F.coalesce("number", loose_number(F.when(F.col("kind") == "string", F.col("text"))))
    cells = cells.withColumn("x", number)
    there = F.col("text").isNotNull()
    size = F.when(F.col("kind") == "string", F.length("text"))
    # a path has one kind, which is a key since Spark sorts all rows for the first of several strings
    first = cells.groupBy("path", "kind").agg(
        F.sum("c").alias("n"),
        F.coalesce(F.sum(F.when(there, F.col("c"))), F.lit(0)).alias("present"),
        F.coalesce(F.sum(F.when(there & (F.col("text") == ""), F.col("c"))), F.lit(0)).alias("blank"),
        F.count("text").alias("distinct"),
        F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("c"))), F.lit(0)).alias("numbers"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        F.min(size).alias("shortest"),
        F.max(size).alias("longest"),
    )
    counts = cells.filter("x is not null").groupBy("path", "x").agg(F.sum("c").alias("c"))
    middle = stats.quantiles(counts, ["path"], {"med": 0.5, "p05": 0.05, "p95": 0.95}, few=True)  # as many as columns
    spread = stats.deviations(counts, ["path"], middle, few=True)
    out = first.join(middle.drop("n"), "path", "left").join(spread, "path", "left").withColumn("null_rate", 1 - F.col("present") / F.col("n"))
    return out.withColumns({c: F.when(F.col("numbers") >= 2, F.col(c)) for c in ("med", "mad", "p05", "p95", "low", "high")})


def vocabularies(rows: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """path, shapes (counts), values (counts, where there are few) and currencies (counts) of text fields."""
    cells = long_form(rows, paths).filter("kind = 'string' and text is not null")
    shapes = cells.groupBy("path", character_shape(F.col("text")).alias("v")).agg(F.count("*").alias("n")).withColumn("what", F.lit("shape"))
    values = cells.groupBy("path", F.col("text").alias("v")).agg(F.count("*").alias("n")).withColumn("what", F.lit("value"))
    few = values.groupBy("path").agg(F.count("*").alias("k")).filter(F.col("k") <= ENUM_LIMIT).select("path")
    currency = cells.groupBy("path", money(F.col("text"))["currency"].alias("v")).agg(F.count("*").alias("n")).filter("v is not null").withColumn("what", F.lit("currency"))
    return shapes.unionByName(values.join(few, "path", "left_semi")).unionByName(currency)


def learn(rows: DataFrame, run: str, paths: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A contract: its header (runs, confidence, row counts) and its field profiles with required marked.

    A field is required where nearly every row has it, and with something in it.
    """
    sizes = rows.groupBy(run).agg(F.count("*").alias("c"))
    middle = stats.quantiles(stats.counted(sizes, [], F.col("c")), [], {"rows_med": 0.5}).drop("n")  # one row
    header = sizes.agg(F.count("*").alias("runs"), F.min("c").alias("rows_min")).join(middle).withColumn("confidence", sample_confidence(F.col("runs")))
    fields = profile(rows.drop(run), paths)
    filled = (F.col("present") - F.col("blank")) / F.col("n")
    return header.select("runs", "rows_med", "rows_min", "confidence"), fields.withColumn("required", (F.col("n") > 0) & (F.col("null_rate") <= NULL_RATE) & (filled >= PRESENCE))


def _number_at(rows: DataFrame, path: str) -> Column:
    kind = {p: kind_of(t) for p, t in leaf_fields(rows.schema)}[path]
    return F.col(path).cast("double") if kind == "number" else loose_number(F.col(path).cast("string"))


def invariant_status(rows: DataFrame, inv: Invariant) -> Column:
    """pass, fail or unknown of an invariant for each row (not for unique, which is about all rows)."""
    value = F.col(inv.field)
    text = value.cast("string")
    if inv.kind == "required":
        return F.when(value.isNull() | (text == ""), "fail").otherwise("pass")
    if inv.kind == "range":
        x = _number_at(rows, inv.field)
        inside = (x >= F.lit(inv.low) if inv.low is not None else F.lit(True)) & (x <= F.lit(inv.high) if inv.high is not None else F.lit(True))
        return F.when(x.isNull(), "unknown").when(inside, "pass").otherwise("fail")
    if inv.kind == "compare":
        a, b = _number_at(rows, inv.field), _number_at(rows, inv.other)
        holds = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "==": a == b, "!=": a != b}[inv.op]
        return F.when(a.isNull() | b.isNull(), "unknown").when(holds, "pass").otherwise("fail")
    if inv.kind == "host":
        own = F.regexp_extract(text, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
        return F.when(value.isNull(), "unknown").when(F.lower(own) == inv.host, "pass").otherwise("fail")
    if inv.kind == "enum":
        return F.when(value.isNull(), "unknown").when(text.isin(*inv.allowed), "pass").otherwise("fail")
    if inv.kind == "currency":
        code = money(text)["currency"]
        return F.when(code.isNull(), "unknown").when(code.isin(*inv.allowed), "pass").otherwise("fail")
    raise ValueError(f"no such kind of invariant: {inv.kind}")


def check_invariants(rows: DataFrame, invariants: list[Invariant], thresholds: Thresholds = Thresholds()) -> DataFrame:
    """check_id, status and n over all rows; a unique invariant gives one row by its distinct share."""
    own = [i for i in invariants if i.kind != "unique"]
    parts = []
    if own:
        cells = F.array(*(F.struct(F.lit(f"invariant:{i.kind}:{i.field}").alias("check_id"), invariant_status(rows, i).alias("status")) for i in own))
        parts.append(rows.select(F.explode(cells).alias("c")).groupBy("c.check_id", "c.status").agg(F.count("*").alias("n")))
    for i in invariants:
        if i.kind == "unique":
            ratio = F.count_distinct(F.col(i.field)) / F.nullif(F.count(F.col(i.field)), F.lit(0))
            status = F.when(ratio.isNull(), "unknown").when(ratio >= thresholds.unique, "pass").otherwise("fail")
            parts.append(rows.agg(F.lit(f"invariant:unique:{i.field}").alias("check_id"), status.alias("status"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def check_learned(rows: DataFrame, fields: DataFrame, words: DataFrame | None = None, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """check_id, path, offenders and the first offending value: numbers out of range, and unseen values, shapes, currencies.

    A baseline whose values were all alike warns about any other value. fields and words come from
    profile() and vocabularies() of healthy rows; fields has a row for each column and is broadcast, words is small and
    Spark broadcasts it by measured size.
    """
    cells = long_form(rows).withColumn("x", F.coalesce("number", loose_number(F.when(F.col("kind") == "string", F.col("text")))))
    known = fields.filter("med is not null").select("path", "med", "mad", "p05", "p95")
    own = F.array_sort(F.array("p05", "med", "p95"))
    middle = F.get(own, F.lit(1))
    spread = F.get(F.array_sort(F.transform(own, lambda v: F.abs(v - middle))), F.lit(1)) * MAD_SCALE
    z = F.when(F.col("mad") > 0, F.abs(F.col("x") - F.col("med")) / F.col("mad")).otherwise(F.abs(F.col("x") - middle) / F.nullif(spread, F.lit(0.0)))
    far = F.coalesce(z > thresholds.z, F.col("x") != F.col("med"))
    odd = cells.join(F.broadcast(known), "path").filter("x is not null").filter(far)
    out = odd.groupBy("path").agg(F.count("*").alias("offenders"), F.min("text").alias("example")).withColumn("check_id", F.concat(F.lit("learned:numeric:"), "path"))
    if words is not None:
        strings = cells.filter("kind = 'string' and text is not null")
        seen = {"value": F.col("text"), "shape": character_shape(F.col("text")), "currency": money(F.col("text"))["currency"]}
        for what, value in seen.items():
            base = words.filter(F.col("what") == what).select("path", "v")
            asked = strings.withColumn("v", value).filter("v is not null").join(base.select("path").distinct(), "path", "left_semi")
            new = asked.join(base, ["path", "v"], "left_anti")
            name = {"value": "enum"}.get(what, what)
            out = out.unionByName(new.groupBy("path").agg(F.count("*").alias("offenders"), F.min("text").alias("example")).withColumn("check_id", F.concat(F.lit(f"learned:{name}:"), "path")))
    return out.select("check_id", "path", "offenders", "example")


def validate(rows: DataFrame, header: DataFrame, fields: DataFrame, invariants: list[Invariant], thresholds: Thresholds = Thresholds(), words: DataFrame | None = None) -> DataFrame:
    """All checks of a run as check_id, field, status, severity, confidence.

    An empty run gives just the failed structure check. Passing invariants are left out. Learned checks
    need a baseline of enough runs, else one unknown row says so. A null never fails a check but required.
    """
    head = header.first()  # one row
    sure, runs = float(head["confidence"]), head["runs"]
    total = rows.count()
    row = lambda cid, name, status, sev, conf: rows.sparkSession.range(1).select(F.lit(cid).alias("check_id"), F.lit(name).cast("string").alias("field"), F.lit(status).alias("status"), F.lit(float(sev)).alias("severity"), F.lit(float(conf)).alias("confidence"))
    if total == 0:
        return row("structure:empty_result", None, "fail", SEVERITY["empty"], 1)
    parts = []
    if "error" in rows.columns and (bad := rows.filter(F.col("error").isNotNull()).limit(1).count()):
        parts.append(row("structure:collector_error", None, "fail", SEVERITY["error"], bad))
    required = fields.filter("required").select("path")
    filled = long_form(rows).groupBy("path").agg(F.avg(F.when(F.col("text") != "", 1.0).otherwise(0.0)).alias("rate"))
    met = F.when(F.coalesce(F.col("rate"), F.lit(0.0)) >= thresholds.presence, "pass").otherwise("fail")
    parts.append(required.join(filled, "path", "left").select(F.concat(F.lit("structure:required:"), "path").alias("check_id"), F.col("path").alias("field"), met.alias("status"), F.lit(SEVERITY["required"]).alias("severity"), F.lit(sure).alias("confidence")))
    if invariants:
        found = check_invariants(rows, invariants, thresholds)
        unique = F.startswith("check_id", F.lit("invariant:unique:"))
        found = found.filter(unique | (F.col("status") != "pass"))
        known = F.when(F.col("status") == "unknown", 0.0).otherwise(1.0)
        sev = F.when(unique, SEVERITY["unique"]).otherwise(SEVERITY["invariant"])
        parts.append(found.select("check_id", F.substring_index("check_id", ":", -1).alias("field"), "status", sev.alias("severity"), known.alias("confidence")))
    if runs < thresholds.samples:
        parts.append(row("learned:insufficient_baseline", None, "unknown", 0, 0))
    else:
        kind = F.regexp_extract("check_id", "^learned:([a-z]+):", 1)
        sev = F.when(kind == "numeric", SEVERITY["numeric"]).when(kind == "enum", SEVERITY["enum"]).when(kind == "currency", SEVERITY["currency"]).otherwise(SEVERITY["shape"])
        conf = F.when(kind == "shape", sure * 0.6).otherwise(sure)
        parts.append(check_learned(rows, fields, words, thresholds).select("check_id", F.col("path").alias("field"), F.lit("warn").alias("status"), sev.alias("severity"), conf.alias("confidence")))
    if head["rows_med"]:
        fell = 1 - total / head["rows_med"] > thresholds.row_drop
        parts.append(row("learned:row_count", None, "warn" if fell else "pass", SEVERITY["row_count"], sure))
    return reduce(DataFrame.unionByName, parts)


def weighted(checks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, failure (severity times confidence of what failed, over what could be judged) and coverage."""
    judged = F.col("status") != "unknown"
    bad = F.when(F.col("status").isin("fail", "warn"), F.col("severity") * F.col("confidence")).otherwise(0.0)
    failure = F.sum(F.when(judged, bad)) / F.nullif(F.count_if(judged), F.lit(0))
    out = checks.groupBy(*keys) if keys else checks.groupBy()
    return out.agg(F.coalesce(failure, F.lit(0.0)).alias("failure"), F.coalesce(F.count_if(judged) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("coverage"))
