"""The gate for a repaired extractor: it must give the expected values on the incident and all golden pages."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenyard.functions.dates import date_agreement
from lumenyard.functions.numbers import loose_number, money
from lumenyard.functions.text import agreement
from lumenyard.operators import paths
from lumenyard.operators.observe import Contracts, checks, first_rows
from lumenyard.operators.stats import merged


def evaluate(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each case: case, passed, missing (never run), wrong (paths).

    expected: case, url, path, value, shape. rows: url, path, value (of the candidate). A case that was
    not run fails; one that expects nothing passes no test and is marked no_expectation.
    """
    got = rows.select("url", "path", F.col("value").alias("observed"))
    ran = rows.select("url").distinct().withColumn("ran", F.lit(True))
    a, b = F.col("observed"), F.col("value")
    value = F.when(F.col("shape") == "date", F.coalesce(date_agreement(a, b), agreement(a, b))).otherwise(agreement(a, b))
    fields = expected.join(got, ["url", "path"], "left").join(ran, "url", "left").withColumn("ok", (value == "agree") & F.col("value").isNotNull())
    none = F.count("path") == 0
    missing = ~F.coalesce(F.bool_or("ran"), F.lit(False))
    wrong = F.sort_array(F.collect_list(F.when(F.col("path").isNotNull() & ~F.col("ok"), F.col("path"))))
    out = fields.groupBy("case").agg(missing.alias("missing"), none.alias("no_expectation"), wrong.alias("wrong"))
    return out.withColumn("passed", ~F.col("missing") & ~F.col("no_expectation") & (F.size("wrong") == 0))


def decide(cases: DataFrame, decoys: DataFrame | None = None, rows: DataFrame | None = None, protected: list[str] | None = None) -> DataFrame:
    """One row: approved and reasons. A candidate that gives a decoy's value, or leaves a protected field empty, fails."""
    reasons = cases.filter("not passed").select(F.concat(F.col("case"), F.when(F.col("missing"), ": never run").when(F.col("no_expectation"), ": nothing expected").otherwise(F.concat(F.lit(": wrong "), F.array_join("wrong", ", ")))).alias("reason"))
    if decoys is not None:
        seen = rows.join(decoys.withColumnRenamed("value", "decoy"), ["url", "path"])
        reasons = reasons.unionByName(seen.filter(agreement(F.col("value"), F.col("decoy")) == "agree").select(F.concat("path", F.lit(": follows the decoy")).alias("reason")))
    for path in protected or []:
        filled = rows.groupBy("url").agg(F.bool_or((F.col("path") == path) & (F.coalesce("value", F.lit("")) != "")).alias("has"))
        reasons = reasons.unionByName(filled.filter("not has").select(F.concat("url", F.lit(f": protected {path} is empty")).alias("reason")))
    return reasons.agg((F.count("*") == 0).alias("approved"), F.sort_array(F.collect_set("reason")).alias("reasons"))


def certificate(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with body (JSON in the given order of fields, nulls written) and digest (its SHA-256).

    Whole numbers are written without a fraction.
    """
    kinds = dict(rows.dtypes)
    plain = lambda c: F.when(F.col(c) == F.floor(c), F.floor(c).cast("string")).otherwise(F.col(c).cast("string")) if kinds[c] in ("double", "float") else F.col(c)
    body = F.to_json(F.struct(*(plain(c).alias(c) for c in columns)), {"ignoreNullFields": "false"})
    return rows.withColumn("body", body).withColumn("digest", F.sha2("body", 256))


def drift_score(rows: DataFrame) -> DataFrame:
    """method, detected, faults, restrained, calm, score: how often a method spoke up just when there was a fault.

    rows: method, fault, notice (booleans).
    """
    right = F.col("fault") == F.col("notice")
    return rows.groupBy("method").agg(
        F.count_if(F.col("fault") & right).alias("detected"),
        F.count_if("fault").alias("faults"),
        F.count_if(~F.col("fault") & right).alias("restrained"),
        F.count_if(~F.col("fault")).alias("calm"),
        F.floor(F.lit(100.0) * F.count_if(right) / F.count("*") + 0.5).cast("bigint").alias("score"),
    )


class Repairs(NamedTuple):
    """Proposed repairs and what their candidates gave.

    repairs: repair_id, collector_id. cases: repair_id, label, kind (incident, anchor or regression), url.
    expected: repair_id, label, path, value and decoy (null: none). executed: repair_id, url of every page that
    the candidate was run on. rows: repair_id, url, row_no, row (variant).
    """

    repairs: DataFrame
    cases: DataFrame
    expected: DataFrame
    executed: DataFrame
    rows: DataFrame


def judge_cases(given: Repairs, collectors: DataFrame) -> DataFrame:
    """repair_id, label, kind, passed, error and wrong (paths) of every case, and whether its decoy was followed.

    A case that was never run, gave an error or no row fails with that as its error; a value that cannot be
    compared is wrong; a case that expects nothing does not pass. Dates are compared as days where the
    collector's specs say so.
    """
    cases = merged(given.cases, given.repairs, "repair_id")
    shapes = collectors.select("collector_id", F.explode("specs").alias("s")).select("collector_id", "s.path", "s.shape")
    own = merged(cases.select("repair_id", "label", "url"), given.rows, ["repair_id", "url"]).select(F.struct("repair_id", "label").alias("run_id"), "row_no", "row")
    wrong_row = F.try_variant_get("row", "$.error", "variant").isNotNull()
    sizes = own.groupBy("run_id").agg(F.count("*").alias("size"), F.min_by(F.when(wrong_row, F.coalesce(F.try_variant_get("row", "$.error", "string"), F.to_json(F.try_variant_get("row", "$.error", "variant")))), F.when(wrong_row, F.col("row_no"))).alias("said"))
    got = paths.cells(first_rows(own), "row", ["run_id"]).groupBy("run_id", "path").agg(F.min("text").alias("observed"))
    wanted = merged(given.expected, cases.select("repair_id", "label", "collector_id"), ["repair_id", "label"]).join(shapes, ["collector_id", "path"], "left")
    wanted = merged(wanted.select(F.struct("repair_id", "label").alias("run_id"), "path", "value", "decoy", "shape"), got, ["run_id", "path"], "left")
    day = lambda v: F.when(F.col("shape") == "date", F.coalesce(date_agreement(F.col("observed"), v), agreement(F.col("observed"), v))).otherwise(agreement(F.col("observed"), v))
    fields = wanted.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("value").isNull() | (day(F.col("value")) != "agree"), F.col("path")))).alias("wrong"),
        F.coalesce(F.bool_or(agreement(F.col("observed"), F.col("decoy")) == "agree"), F.lit(False)).alias("followed"),
    )
    ran = given.executed.select("repair_id", "url").distinct().withColumn("ran", F.lit(True))
    found = merged(cases.withColumn("run_id", F.struct("repair_id", "label")), ran, ["repair_id", "url"], "left")
    found = merged(merged(found, sizes, "run_id", "left"), fields, "run_id", "left")
    error = F.when(F.col("ran").isNull(), "was never run").when(F.col("said").isNotNull(), F.col("said")).when(F.coalesce("size", F.lit(0)) == 0, "gave no row").when(F.col("wrong").isNull(), "nothing is expected")
    found = found.withColumn("error", error)
    wrong = F.when(F.col("error").isNull(), F.col("wrong")).otherwise(F.array().cast("array<string>"))
    return found.select("repair_id", "collector_id", "label", "kind", "url", (F.col("error").isNull() & (F.size("wrong") == 0)).alias("passed"), "error", wrong.alias("wrong"), (F.col("error").isNull() & F.coalesce("followed", F.lit(False))).alias("followed"))


def judge_repairs(given: Repairs, collectors: DataFrame, contracts: Contracts) -> DataFrame:
    """repair_id, collector_id, approved and reasons (sorted) of every repair.

    Approved: every case passes, no protected field is missing on the incident or a regression page, and what the
    candidate gave there fails no check of its contract but learned ones, which a right repair may depart from.
    """
    judged = judge_cases(given, collectors)
    what = F.when(F.col("error").isNotNull(), F.col("error")).otherwise(F.concat(F.lit("wrong "), F.array_join("wrong", ", ")))
    mistake = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("followed"), "followed the decoy: reads a position").otherwise("did not give the token: not shown to read the label")
    failed = judged.filter("not passed").select("repair_id", F.concat(F.col("label"), F.lit(": "), F.when(F.col("kind") == "anchor", mistake).otherwise(what)).alias("reason"))
    real = judged.filter("kind <> 'anchor'").select("repair_id", "label", "url", "collector_id")
    rows = merged(real, given.rows, ["repair_id", "url"]).select(F.struct("repair_id", "label").alias("run_id"), "collector_id", "row_no", "row")
    got = paths.cells(first_rows(rows), "row", ["run_id"]).filter("kind <> 'null' and (kind <> 'string' or text <> '')").select("run_id", "path")
    runs = rows.select("run_id", "collector_id").distinct()
    needed = runs.join(collectors.select("collector_id", F.explode("protected").alias("path")), "collector_id")
    empty = merged(needed, got, ["run_id", "path"], "left_anti").select("run_id.repair_id", F.concat("run_id.label", F.lit(": protected "), "path", F.lit(" is missing")).alias("reason"))
    broken = checks(collectors, runs, rows.select("run_id", "row_no", "row"), contracts).filter("status = 'fail' and check_id not like 'learned:%'")
    broken = broken.select("run_id.repair_id", F.concat("run_id.label", F.lit(": fails "), "check_id").alias("reason"))
    reasons = failed.unionByName(empty).unionByName(broken).groupBy("repair_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    none = F.array().cast("array<string>")
    return merged(given.repairs, reasons, "repair_id", "left").select("repair_id", "collector_id", F.col("reasons").isNull().alias("approved"), F.coalesce("reasons", none).alias("reasons"))


def matrix(judged: DataFrame) -> DataFrame:
    """repair_id and text: a line for each case with its outcome, its label and what was wrong; incidents come first."""
    detail = F.coalesce("error", F.array_join("wrong", ", "))
    line = F.concat(F.lit("  "), F.rpad(F.when(F.col("passed"), "PASS").otherwise("FAIL"), 5, " "), F.lit(" "), F.greatest(F.rpad("label", 24, " "), F.col("label")), F.lit(" "), detail)
    place = F.when(F.col("kind") == "incident", 0).when(F.col("kind") == "anchor", 1).otherwise(2)
    lines = F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col("label").alias("label"), line.alias("line"))))
    return judged.groupBy("repair_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def notices(readings: DataFrame) -> DataFrame:
    """readings with method and notice, a row for each of three ways of watching a value.

    readings: number (whether the value has to be one), known (its last good value), collector and witness
    (strings). conventional: the value is there, a number and above 0 where it has to be; monitor: it is what it was;
    two_sensors: the second reading agrees.
    """
    got, old = money(F.col("collector"))["value"], money(F.col("known"))["value"]
    gone = F.col("collector").isNull()
    plain = F.when(gone, True).when(~F.col("number"), False).otherwise(F.coalesce(got <= 0, F.lit(True)))
    text = lambda c: F.lower(F.trim(c))
    same = F.when(F.col("number"), F.col("known").isNotNull() & got.eqNullSafe(old)).otherwise(F.coalesce(text("collector") == text("known"), F.lit(False)))
    both = F.when(gone | F.col("witness").isNull(), True).otherwise(agreement(F.col("collector"), F.col("witness")) != "agree")
    methods = {"conventional": plain, "monitor": gone | ~same, "two_sensors": both}
    told = F.explode(F.array(*(F.struct(F.lit(name).alias("method"), flag.alias("notice")) for name, flag in methods.items())))
    return readings.withColumn("__told", told).select(*readings.columns, "__told.*")


def safeguards(row: Column, answered: Column, number: str, texts: list[str]) -> Column:
    """struct of the checks that a careful team has: each true where a row (variant) survives it."""
    at = lambda p: F.try_variant_get(row, f"$.{p}", "variant")
    value = loose_number(F.try_variant_get(row, f"$.{number}", "string"))
    there = at(number).isNotNull()
    void = F.coalesce(F.is_variant_null(at(number)), F.lit(False))
    members = F.try_variant_get(row, "$", "map<string,variant>")
    positive = F.coalesce(value > 0, F.lit(False))
    named = [F.coalesce((F.schema_of_variant(at(t)) == "STRING") & (F.try_variant_get(row, f"$.{t}", "string") != ""), F.lit(False)) for t in texts]
    return F.struct(
        F.coalesce(answered, F.lit(False)).alias("answered"),
        row.isNotNull().alias("valid"),
        F.coalesce(F.size(members) > 0, F.lit(False)).alias("filled"),
        there.alias("present"),
        (there & ~void).alias("not_null"),
        value.isNotNull().alias("type"),
        positive.alias("range"),
        reduce(Column.__and__, named, positive).alias("schema"),
        F.coalesce(answered, F.lit(False)).alias("no_retry"),
    )
