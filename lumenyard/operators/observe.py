"""Observing a table of runs: contracts of many collectors, checks keyed by run, second readings, and a verdict a run.

All runs go through one plan. Rows are untyped (VARIANT) and taken apart into leaves once; what a collector's
healthy rows look like is learned per collector and path; a run's checks are rows of one table; and only the
runs whose checks ask for it are held against the second reading. No step reads anything on the driver.

Tables, one row for each thing:
  collectors   collector_id, specs array<struct<path, shape, required_on_page>>, protected array<string>,
               invariants array<struct<kind, field, low, high, op, other, host, allowed>>, country, device
  runs         run_id, collector_id, url, observed_at
  rows         run_id, row_no, row (variant); a run may have none
  sightings    run_id, fetched, same_page, country, device, fetched_at: how the second reading went
  readings     run_id, path, value, confidence: what it found
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenyard.functions.numbers import loose_number, money
from lumenyard.functions.text import character_shape
from lumenyard.operators import paths, serving, stats, verdict
from lumenyard.operators.contract import ENUM_LIMIT, NULL_RATE, PRESENCE, SEVERITY, Thresholds
from lumenyard.operators.stats import merged

INVARIANTS = "array<struct<kind:string,field:string,low:double,high:double,op:string,other:string,host:string,allowed:array<string>>>"
SPECS = "array<struct<path:string,shape:string,required_on_page:boolean>>"
OPEN_END = "[]"  # in a path: items of an array
SHAPE_SHARE = 0.6  # of a contract's confidence that a new shape gets


class Contracts(NamedTuple):
    """headers: collector_id, runs, rows_med, rows_min, confidence. fields: collector_id, path, n, present, nulls, kinds,
    required and numeric centre, spread and quantiles. words: collector_id, path, what, v: kinds, shapes, currencies
    and (where they are few) values that were seen."""

    headers: DataFrame
    fields: DataFrame
    words: DataFrame


def _number(kind: Column, text: Column, number: Column) -> Column:
    return F.coalesce(number, loose_number(F.when(kind == "string", text)))


def _signs(kind: Column, text: Column) -> Column:
    """What of a value can be new: its kind, currency, value and shape."""
    string = F.when(kind == "string", text)
    currency = money(F.when(kind.isin("string", "number"), text))["currency"]
    parts = {"type": F.when(kind != "null", kind), "currency": currency, "value": string, "shape": character_shape(string)}
    return F.filter(F.array(*(F.struct(F.lit(what).alias("what"), v.alias("v")) for what, v in parts.items())), lambda s: s["v"].isNotNull())


def learn(runs: DataFrame, rows: DataFrame) -> Contracts:
    """The contracts of all collectors from runs that someone took for healthy.

    A path is required where nearly every row has it and nearly no row has null there; paths into arrays are
    not. Numbers written in text count as numbers; numeric figures need two of them. A collector without
    runs has no contract.
    """
    own = merged(rows, runs.select("run_id", "collector_id"), "run_id")
    sizes = merged(runs.select("collector_id", "run_id"), rows.groupBy("run_id").agg(F.count("*").alias("size")), "run_id", "left").select("collector_id", F.coalesce("size", F.lit(0)).cast("double").alias("x"))
    middle = stats.quantiles(sizes.groupBy("collector_id", "x").agg(F.count("*").alias("c")), ["collector_id"], {"rows_med": 0.5}).select("collector_id", "rows_med")
    header = sizes.groupBy("collector_id").agg(F.count("*").alias("runs"), F.min("x").cast("bigint").alias("rows_min"), F.sum("x").cast("bigint").alias("rows"))
    header = header.join(middle, "collector_id").withColumn("confidence", stats.sample_confidence(F.col("runs")))
    # everything about a path comes from how often it has each value
    values = paths.cells(own, "row", ["collector_id"]).groupBy("collector_id", "path", "kind", "text", "number").agg(F.count("*").alias("c"))
    kinds = values.groupBy("collector_id", "path", "kind").agg(F.sum("c").alias("c"))
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("c"))), F.lit(0))
    fields = kinds.groupBy("collector_id", "path").agg(
        F.sum("c").alias("present"),
        n(F.col("kind") == "null").alias("nulls"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") != "null", F.struct("kind", "c"))))).alias("kinds"),
    )
    x = _number(F.col("kind"), F.col("text"), F.col("number"))
    counts = values.select("collector_id", "path", x.alias("x"), "c").filter("x is not null").groupBy("collector_id", "path", "x").agg(F.sum("c").alias("c"))
    keys = ["collector_id", "path"]
    figures = stats.quantiles(counts, keys, {"med": 0.5, "p05": 0.05, "p95": 0.95})
    figures = figures.filter("n >= 2").drop("n").join(stats.deviations(counts, keys, figures), keys)
    fields = fields.join(header.select("collector_id", F.col("rows").alias("n")), "collector_id").join(figures, keys, "left")
    required = ~F.contains("path", F.lit(OPEN_END)) & (F.col("present") >= PRESENCE * F.col("n")) & (F.col("nulls") <= NULL_RATE * F.col("present"))
    signs = values.select(*keys, F.explode(_signs(F.col("kind"), F.col("text"))).alias("s")).select(*keys, "s.*").distinct()
    few = signs.groupBy(*keys, "what").agg(F.count("*").alias("k")).filter((F.col("what") != "value") | (F.col("k") <= ENUM_LIMIT)).drop("k")
    return Contracts(header.drop("rows"), fields.withColumn("required", required), signs.join(few, [*keys, "what"], "left_semi"))


def extended(before: tuple[DataFrame, DataFrame], runs: DataFrame, rows: DataFrame) -> Contracts:
    """The contracts learned from all runs and rows so far (before) and from those that follow a real change of the source."""
    return learn(before[0].unionByName(runs), before[1].unionByName(rows))


def _invariant(cell: Column, inv: Column, at) -> Column:
    """pass, fail or unknown of one invariant for a row, whose cells at() finds by path."""
    kind, text = cell["kind"], F.nullif(cell["text"], F.lit(""))
    x = _number(cell["kind"], cell["text"], cell["number"])
    other = at(inv["other"])
    y = _number(other["kind"], other["text"], other["number"])
    op = inv["op"]
    holds = F.when(op == ">", x > y).when(op == ">=", x >= y).when(op == "<", x < y).when(op == "<=", x <= y).when(op == "==", x == y).otherwise(x != y)
    string = F.when(kind == "string", cell["text"])
    own = F.lower(F.regexp_extract(string, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1))
    currency = money(F.when(kind.isin("string", "number"), cell["text"]))["currency"]
    judged = lambda known, ok: F.when(~F.coalesce(known, F.lit(False)), "unknown").when(ok, "pass").otherwise("fail")
    inside = F.coalesce(x >= inv["low"], F.lit(True)) & F.coalesce(x <= inv["high"], F.lit(True))
    filled = cell.isNotNull() & (kind != "null") & ((kind != "string") | text.isNotNull())
    return (
        F.when(inv["kind"] == "required", F.when(F.coalesce(filled, F.lit(False)), "pass").otherwise("fail"))
        .when(inv["kind"] == "range", judged(x.isNotNull(), inside))
        .when(inv["kind"] == "compare", judged(x.isNotNull() & y.isNotNull(), holds))
        .when(inv["kind"] == "host", judged(string.isNotNull(), own == inv["host"]))
        .when(inv["kind"] == "enum", judged(string.isNotNull(), F.array_contains(inv["allowed"], string)))
        .when(inv["kind"] == "currency", judged(currency.isNotNull(), F.array_contains(inv["allowed"], currency)))
    )


CHECK = ["run_id", "check_id", "field", "status", "severity", "confidence", "n"]


def _check(check_id: Column, field: Column, status: Column, severity: Column | float, confidence: Column | float, n: Column | int = 1) -> list[Column]:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    n = n if isinstance(n, Column) else F.lit(n)
    return [F.col("run_id"), check_id.alias("check_id"), field.cast("string").alias("field"), status.alias("status"), as_column(severity).alias("severity"), as_column(confidence).alias("confidence"), n.cast("bigint").alias("n")]


def checks(collectors: DataFrame, runs: DataFrame, rows: DataFrame, contracts: Contracts, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """run_id, check_id, field, status, severity, confidence, n: every check of every run.

    n is how many rows a result stands for. An invariant gives a row for each status but pass; a learned
    check one for each path that departs. A run without rows has just its failed structure check. Learned
    checks need a contract of enough runs; else an unknown row says so. A null fails nothing but required.
    """
    none = F.lit(None)
    runs = runs.select("run_id", "collector_id")
    sized = merged(runs, rows.groupBy("run_id").agg(F.count("*").alias("size"), F.count_if(F.try_variant_get("row", "$.error", "variant").isNotNull()).alias("errors")), "run_id", "left")
    sized = sized.withColumns({"size": F.coalesce("size", F.lit(0)), "errors": F.coalesce("errors", F.lit(0))})
    sized = sized.join(contracts.headers, "collector_id", "left").withColumns({"runs": F.coalesce("runs", F.lit(0)), "confidence": F.coalesce("confidence", F.lit(0.0))})
    filled = sized.filter("size > 0")
    wrong = lambda name, when, n: sized.filter(when).select(*_check(F.lit(f"structure:{name}"), none, F.lit("fail"), SEVERITY["error"], 1, n))
    parts = [wrong("empty_result", "size = 0", 1), wrong("collector_error", "errors > 0", F.col("errors"))]
    own = merged(rows, runs, "run_id").withColumn("cells", paths.leaves(F.col("row")))
    cells = own.select("run_id", "collector_id", F.explode("cells").alias("c")).select("run_id", "collector_id", "c.*")

    # required paths: those of the contract, with how many rows have something there
    there = cells.filter("kind <> 'null' and (kind <> 'string' or text <> '')").groupBy("run_id", "path").agg(F.count("*").alias("filled"))
    needed = filled.select("run_id", "collector_id", "size", "confidence").join(contracts.fields.filter("required").select("collector_id", "path"), "collector_id")
    needed = merged(needed, there, ["run_id", "path"], "left")
    met = F.when(F.coalesce("filled", F.lit(0)) >= thresholds.presence * F.col("size"), "pass").otherwise("fail")
    parts.append(needed.select(*_check(F.concat(F.lit("structure:required:"), "path"), F.col("path"), met, SEVERITY["required"], F.col("confidence"))))

    # invariants of the collector, each row against all of them
    by_path = F.map_from_entries(F.array_distinct(F.transform(F.filter("cells", lambda c: ~F.contains(c["path"], F.lit(OPEN_END))), lambda c: F.struct(c["path"], c))))
    asked = own.select("run_id", "collector_id", by_path.alias("at")).join(collectors.select("collector_id", F.explode("invariants").alias("inv")), "collector_id")
    plain = asked.filter("inv.kind <> 'unique'").withColumn("status", _invariant(F.try_element_at("at", F.col("inv.field")), F.col("inv"), lambda p: F.try_element_at("at", p)))
    counted = plain.filter("status <> 'pass'").groupBy("run_id", "inv.kind", "inv.field", "status").agg(F.count("*").alias("n"))
    sure = F.when(F.col("status") == "unknown", 0.0).otherwise(1.0)
    parts.append(counted.select(*_check(F.concat_ws(":", F.lit("invariant"), "kind", "field"), F.col("field"), F.col("status"), SEVERITY["invariant"], sure, F.col("n"))))
    keyed = asked.filter("inv.kind = 'unique'").select("run_id", "inv.field", F.try_element_at("at", F.col("inv.field")).alias("c"))
    distinct = keyed.groupBy("run_id", "field", F.when(F.col("c.kind") != "null", F.struct("c.kind", "c.text")).alias("v")).agg(F.count("*").alias("c")).groupBy("run_id", "field")
    distinct = distinct.agg(F.count("v").alias("k"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0)).alias("of"))
    unique = F.when(F.col("of") == 0, "unknown").when(F.col("k") >= thresholds.unique * F.col("of"), "pass").otherwise("fail")
    parts.append(distinct.select(*_check(F.concat(F.lit("invariant:unique:"), "field"), F.col("field"), unique, SEVERITY["unique"], F.when(F.col("of") == 0, 0.0).otherwise(1.0))))

    # learned: numbers far from the contract's, and kinds, currencies, values and shapes that it has not seen
    taught = contracts.headers.filter(F.col("runs") >= thresholds.samples).select("collector_id", "confidence")
    numbers = cells.withColumn("x", _number(F.col("kind"), F.col("text"), F.col("number"))).filter("x is not null")
    known = contracts.fields.filter("med is not null").select("collector_id", "path", "med", "mad", "p05", "p95").join(taught, "collector_id")
    far = F.coalesce(_z() > thresholds.z, F.col("x") != F.col("med"))
    odd = numbers.join(known, ["collector_id", "path"]).filter(far).groupBy("run_id", "path", "confidence").agg(F.count("*").alias("n"))
    parts.append(odd.select(*_check(F.concat(F.lit("learned:numeric:"), "path"), F.col("path"), F.lit("warn"), SEVERITY["numeric"], F.col("confidence"), F.col("n"))))
    shown = cells.select("run_id", "collector_id", "path", F.explode(_signs(F.col("kind"), F.col("text"))).alias("s")).select("run_id", "collector_id", "path", "s.*")
    shown = shown.groupBy("run_id", "collector_id", "path", "what", "v").agg(F.count("*").alias("c"))
    judged = contracts.words.select("collector_id", "path", "what").distinct().join(taught, "collector_id")
    new = shown.join(judged, ["collector_id", "path", "what"]).join(contracts.words, ["collector_id", "path", "what", "v"], "left_anti").groupBy("run_id", "path", "what", "confidence").agg(F.sum("c").alias("n"))
    name = F.when(F.col("what") == "value", "enum").otherwise(F.col("what"))
    severity = reduce(lambda w, k: w.when(F.col("what") == k, SEVERITY[k]), ("type", "currency", "shape"), F.when(F.col("what") == "value", SEVERITY["enum"]))
    trust = F.when(F.col("what") == "shape", F.col("confidence") * SHAPE_SHARE).otherwise(F.col("confidence"))
    parts.append(new.select(*_check(F.concat_ws(":", F.lit("learned"), name, "path"), F.col("path"), F.lit("warn"), severity, trust, F.col("n"))))

    parts.append(filled.filter(F.col("runs") < thresholds.samples).select(*_check(F.lit("learned:insufficient_baseline"), none, F.lit("unknown"), 0, 0)))
    fell = 1 - F.col("size") / F.col("rows_med") > thresholds.row_drop
    parts.append(filled.filter("rows_med > 0").select(*_check(F.lit("learned:row_count"), none, F.when(fell, "warn").otherwise("pass"), SEVERITY["row_count"], F.col("confidence"))))
    return reduce(DataFrame.unionByName, parts)


def _z() -> Column:
    """Robust deviations of x; by the three quantiles where the values were alike, and null if those were alike too."""
    own = F.array_sort(F.array("p05", "med", "p95"))
    middle = F.get(own, F.lit(1))
    spread = F.get(F.array_sort(F.transform(own, lambda v: F.abs(v - middle))), F.lit(1)) * stats.MAD_SCALE
    return F.when(F.col("mad") > 0, F.abs(F.col("x") - F.col("med")) / F.col("mad")).otherwise(F.abs(F.col("x") - middle) / F.nullif(spread, F.lit(0.0)))


def ranked(found: DataFrame) -> DataFrame:
    """run_id, failed, warned, explicit (booleans), failing, broken, unpassed (fields), worst, coverage and failure.

    worst: the failed and warned checks, gravest first (severity times confidence, then by name). broken: fields
    of failed checks; unpassed: those of all checks that did not pass. coverage: the judged share of results;
    failure: their mean weight.
    """
    status, weight = F.col("status"), F.col("severity") * F.col("confidence")
    bad = status.isin("fail", "warn")
    explicit = (status == "fail") & F.col("check_id").isin("structure:collector_error", "structure:empty_result")
    judged, n = status != "unknown", F.col("n")
    of = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("field"))))
    worst = F.array_sort(F.collect_list(F.when(bad, F.struct((-weight).alias("order"), F.col("check_id").alias("check_id"), status.alias("status"), F.col("n").alias("n")))))
    total = lambda test, v: F.coalesce(F.sum(F.when(test, v)), F.lit(0))
    out = found.groupBy("run_id").agg(
        F.coalesce(F.bool_or(status == "fail"), F.lit(False)).alias("failed"),
        F.coalesce(F.bool_or(status == "warn"), F.lit(False)).alias("warned"),
        F.coalesce(F.bool_or(explicit), F.lit(False)).alias("explicit"),
        of(bad).alias("failing"),
        of(status == "fail").alias("broken"),
        of(status != "pass").alias("unpassed"),
        worst.alias("worst"),
        total(judged, n).alias("judged"),
        total(F.lit(True), n).alias("of"),
        total(judged & bad, weight * n).alias("weight"),
    )
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return out.withColumns({"coverage": share("judged", "of"), "failure": share("weight", "judged")}).drop("judged", "of", "weight")


def first_rows(rows: DataFrame) -> DataFrame:
    """run_id and row: the row of each run that comes first."""
    first = F.min_by(F.struct("row"), "row_no")
    return rows.filter("run_id is not null and row_no is not null").groupBy("run_id").agg(first.alias("first")).select("run_id", "first.row")


def compared(collectors: DataFrame, runs: DataFrame, rows: DataFrame, readings: DataFrame) -> DataFrame:
    """run_id, path, collector, witness, kind, confidence: the fields of each run's first row against the second reading.

    What is compared are the specs of the run's collector. Of several readings of a path the surest counts.
    """
    wanted = runs.join(collectors.select("collector_id", F.explode("specs").alias("s")), "collector_id").select("run_id", "s.*")
    mine = paths.cells(first_rows(rows), "row", ["run_id"]).groupBy("run_id", "path").agg(F.min("text").alias("collector"))
    other = readings.groupBy("run_id", "path").agg(F.max_by(F.struct("value", "confidence"), F.struct("confidence", "value")).alias("r"))
    other = other.select("run_id", "path", F.col("r.value").alias("witness"), F.col("r.confidence").alias("sure"))
    both = merged(merged(wanted, mine, ["run_id", "path"], "left"), other, ["run_id", "path"], "left")
    kind, sure = verdict.judged_reading(F.col("collector"), F.col("witness"), F.col("shape"), F.coalesce("required_on_page", F.lit(False)), F.col("sure"))
    return both.select("run_id", "path", "collector", "witness", kind.alias("kind"), sure.alias("confidence"))


def observe(collectors: DataFrame, runs: DataFrame, rows: DataFrame, sightings: DataFrame, readings: DataFrame, contracts: Contracts, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """runs with verdict, verdict_confidence, publishable, quarantined, witnessed, confirmed_by, affected, worst and captured.

    A run whose checks all pass under a contract is healthy without a second reading. Any other is judged by
    it: without one, or where it read another page, the run is inconclusive. Publishable: a sound verdict and
    no protected field that fails. affected: the fields that the verdict is about; worst: failed checks,
    gravest first; captured: fields whose value is what the second reading has for another field.
    """
    found = ranked(checks(collectors, runs, rows, contracts, thresholds)).withColumnRenamed("coverage", "check_coverage")
    taught = contracts.headers.filter("runs > 0").select("collector_id", F.lit(True).alias("taught"))
    setting = collectors.select("collector_id", "protected", F.col("country").alias("own_country"), F.col("device").alias("own_device"))
    all_runs = merged(runs, found, "run_id").join(taught, "collector_id", "left").join(setting, "collector_id", "left")
    needs = F.col("failed") | F.col("warned") | F.col("taught").isNull()
    seen = sightings.select("run_id", "fetched", "same_page", "country", "device", "fetched_at")
    all_runs = merged(all_runs.withColumn("witnessed", needs), seen, "run_id", "left")
    fields = compared(collectors, all_runs.filter("witnessed").select("run_id", "collector_id"), rows, readings)
    all_runs = merged(all_runs, verdict.summary(fields), "run_id", "left")
    nothing = F.array().cast("array<string>")
    read = F.coalesce("fetched", F.lit(False))
    away = read & ~F.coalesce("same_page", F.lit(True))
    all_runs = all_runs.withColumns({
        "agreed": F.when(read, F.coalesce("agreed", nothing)),
        "disagreed": F.when(read, F.coalesce("disagreed", nothing)),
        "incomparable": F.when(read, F.coalesce("incomparable", nothing)),
        "coverage": F.coalesce("coverage", F.lit(0.0)),
        "agreement_rate": F.coalesce("agreement_rate", F.lit(0.0)),
        "weakest": F.coalesce("weakest", F.lit(1.0)),
        "departs": F.col("failed") | F.col("warned"),
        "aligned": F.when(read, _aligned()),
    })
    judged = verdict.classify(all_runs)
    blind = F.col("witnessed") & (~read | away)
    ruling = F.when(~F.col("witnessed"), "healthy").when(blind, "inconclusive").otherwise(F.col("verdict"))
    sure = F.when(~F.col("witnessed"), F.greatest(F.lit(0.5), F.col("check_coverage"))).when(blind, 0.0).otherwise(F.col("verdict_confidence"))
    unseen = F.exists("failing", lambda f: ~F.exists(F.array_union("agreed", "disagreed"), lambda s: verdict.overlaps(f, s)))
    about_checks = (ruling == "genuine_source_change") | ((ruling == "inconclusive") & unseen)
    affected = F.when(blind, F.col("unpassed")).when(ruling.isin("healthy", "explicit_failure"), nothing).when(about_checks, F.col("failing")).otherwise(F.col("disagreed"))
    judged = judged.withColumns({"affected": affected, "verdict": ruling, "verdict_confidence": sure})
    sound = verdict.publishable(F.col("verdict"), F.col("broken"), F.coalesce("protected", nothing))
    both = F.coalesce(F.size("agreed") > 0, F.lit(False))
    judged = judged.withColumns({"publishable": sound, "quarantined": ~sound, "confirmed_by": F.when(both, "two_sensors").otherwise("contract_only")})
    caught = verdict.captured_instead(fields).groupBy("run_id").agg(F.array_sort(F.collect_list(F.concat(F.col("path"), F.lit(" <- "), F.col("other")))).alias("captured"))
    out = merged(judged, caught, "run_id", "left").withColumn("captured", F.when(F.col("verdict") == "extractor_drift", F.coalesce("captured", nothing)).otherwise(nothing))
    return out.select(*runs.columns, "verdict", "verdict_confidence", "publishable", "quarantined", "witnessed", "confirmed_by", "affected", "worst", "captured")


def _aligned(gap: int = verdict.GAP_SECONDS) -> Column:
    """Whether both readings came from the same place, kind of device and time, as far as it is known."""
    differ = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    device = differ("own_device", "device") & ~F.coalesce(F.col("own_device") == "unknown", F.lit(False)) & ~F.coalesce(F.col("device") == "unknown", F.lit(False))
    late = F.coalesce(F.abs(F.unix_millis("observed_at") - F.unix_millis("fetched_at")) > gap * 1000, F.lit(False))
    return ~(differ("own_country", "country") | device | late)


def incidents(observed: DataFrame) -> DataFrame:
    """The incident of every run that was held against a second reading, with resolved_at: an open one ends with the
    next publishable run of its collector and url."""
    own = observed.filter("witnessed").select(
        F.col("run_id").alias("incident_id"), "run_id", "collector_id", F.col("url").alias("page"), "verdict", F.col("verdict_confidence").alias("confidence"), F.col("affected").alias("fields"), F.col("observed_at").alias("created_at"), "quarantined"
    )
    place = lambda c: F.struct("collector_id", F.col(c).alias("page"))
    runs = observed.select(place("url").alias("url"), F.col("observed_at").alias("at"), "publishable")
    closed = verdict.recovered(own.withColumn("url", place("page")), runs)
    return closed.drop("url").withColumnRenamed("page", "url").withColumn("resolved_at", F.when(F.col("quarantined"), F.col("resolved_at")))


def served(observed: DataFrame, rows: DataFrame, now: Column, max_age_hours: int = serving.MAX_AGE_HOURS) -> DataFrame:
    """The feed of every collector and url that was ever run: the first row of its newest publishable run, or that there is none."""
    keys = ["collector_id", "url"]
    good = merged(observed.filter("publishable").select(*keys, "run_id", "observed_at", "confirmed_by"), first_rows(rows), "run_id")
    newest = good.groupBy(*keys).agg(F.max_by(F.struct("row", "observed_at", "confirmed_by"), F.struct("observed_at", "run_id")).alias("s"))
    snapshots = merged(observed.select(*keys).distinct(), newest, keys, "left").select(*keys, F.to_json("s.row").alias("data"), F.col("s.observed_at").alias("verified_at"), F.col("s.confirmed_by").alias("confirmed_by"))
    return serving.feed(snapshots, incidents(observed), now, max_age_hours)
