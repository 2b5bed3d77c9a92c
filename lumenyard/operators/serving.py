"""Serving the last known good values, and what the checking cost and prevented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_AGE_HOURS = 24
FRESH = {"two_sensors": 0.95, "contract_only": 0.6}
LOADS_PER_RUN = 2
MONTHLY_LOADS = 4000


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of each key the row that is last by the given order."""
    names = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*names), F.struct(*order)).alias("r")
    return rows.groupBy(*keys).agg(last).select(*keys, "r.*")


def feed(snapshots: DataFrame, incidents: DataFrame, now: Column, max_age_hours: int = MAX_AGE_HOURS) -> DataFrame:
    """collector_id, url, data, status, confidence, stale, incident_id, reason of every snapshot.

    snapshots: collector_id, url, data, verified_at, confirmed_by. incidents: incident_id, collector_id,
    url (null: any), verdict, confidence, created_at, resolved_at, quarantined. The newest open incident
    about the url withholds fresh data: the last good value is served as stale; without one (data or
    verified_at null) the value is unavailable. Of each collector and url, and of each collector, only the
    newest incident is joined, so rows never multiply.
    """
    open_ = incidents.filter("quarantined and resolved_at is null")
    place = F.struct(F.col("created_at").isNotNull().alias("dated"), "created_at", "incident_id")
    newest = lambda name: F.max_by(F.struct("incident_id", "verdict", F.col("confidence").alias("sure"), place.alias("place")), place).alias(name)
    own = open_.filter("url is not null").groupBy("collector_id", "url").agg(newest("own"))
    whole = open_.filter("url is null").groupBy("collector_id").agg(newest("whole"))
    found = snapshots.join(own, ["collector_id", "url"], "left").join(whole, "collector_id", "left")
    later = F.col("own").isNull() | (F.col("whole.place") > F.col("own.place"))
    found = found.withColumn("incident", F.when(F.col("whole").isNotNull() & later, F.col("whole")).otherwise(F.col("own")))
    found = found.select("*", "incident.incident_id", "incident.verdict", "incident.sure")
    none = F.col("data").isNull() | F.col("verified_at").isNull()
    old = F.unix_millis(now) - F.unix_millis(F.to_timestamp("verified_at")) > max_age_hours * 3_600_000
    fresh = F.when(F.col("confirmed_by") == "two_sensors", FRESH["two_sensors"]).otherwise(FRESH["contract_only"])
    held = F.col("incident_id").isNotNull()
    reason = (
        F.when(F.col("verdict") == "extractor_drift", "collector_witness_disagreement")
        .when(F.col("verdict") == "explicit_failure", "collector_returned_error_or_empty")
        .when(F.col("verdict") == "access_anomaly", "sensors_observed_different_page_variants")
        .when(F.col("verdict") == "inconclusive", "insufficient_evidence_to_verify")
        .otherwise(F.col("verdict"))
    )
    return found.select(
        "collector_id",
        "url",
        "data",
        F.when(none, "unavailable").when(held, "quarantined").when(old, "stale").otherwise("verified").alias("status"),
        F.when(none, 0.0).when(held, F.greatest(F.lit(0.0), 1 - F.col("sure"))).when(old, fresh / 2).otherwise(fresh).alias("confidence"),
        (none | held | old).alias("stale"),
        "incident_id",
        F.when(held, reason).when(none, "nothing was ever confirmed").when(old, "last confirmed too long ago").alias("reason"),
    )


def impact(runs: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row: runs, incidents, withheld values, silent ones among them, restrained, quarantined, published.

    runs: run_id, caught (a check failed). incidents: run_id, verdict, fields (array).
    """
    joined = incidents.join(runs.select("run_id", "caught"), "run_id", "left")
    fault = F.col("verdict").isin("extractor_drift", "explicit_failure")
    n = F.when(fault, F.size("fields")).otherwise(0)
    sums = joined.agg(
        F.count_if(F.col("verdict") != "healthy").alias("incidents"),
        F.coalesce(F.sum(n), F.lit(0)).alias("withheld"),
        F.coalesce(F.sum(F.when(F.coalesce(~F.col("caught"), F.lit(False)), n).otherwise(0)), F.lit(0)).alias("silent"),
        F.count_if(F.col("verdict") == "genuine_source_change").alias("restrained"),
        F.count_if(F.col("verdict").isin("inconclusive", "access_anomaly")).alias("quarantined"),
    )
    unhealthy = incidents.filter("verdict <> 'healthy'").select("run_id").distinct()
    totals = runs.agg(F.count("*").alias("runs")), runs.join(unhealthy, "run_id", "left_anti").agg(F.count("*").alias("published"))
    return sums.join(F.broadcast(totals[0])).join(F.broadcast(totals[1]))  # one row each


def month_spend(runs: DataFrame, at: str, budget: int = MONTHLY_LOADS, loads: int = LOADS_PER_RUN) -> DataFrame:
    """month, spent, remaining and exhausted of each calendar month (UTC)."""
    spent = runs.groupBy(F.date_trunc("month", F.col(at)).cast("date").alias("month")).agg((F.count("*") * loads).alias("spent"))
    return spent.withColumns({"remaining": F.greatest(F.lit(0), budget - F.col("spent")).cast("bigint"), "exhausted": F.col("spent") >= budget})


def best_offer(offers: DataFrame, keys: list[str], price: str, currency: str, order: str) -> DataFrame:
    """The cheapest positive offer of each key (the first by order among equals); null if currencies differ."""
    rows = offers.filter(F.col(price) > 0)
    least = F.min_by(F.struct(F.col(order), F.col(price)), F.struct(F.col(price), F.col(order)))
    one = F.count_distinct(currency) <= 1
    return rows.groupBy(*keys).agg(F.when(one, least).alias("best"), F.count_distinct(currency).alias("currencies"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables' rows, of each key the one that is last by order; the new table's among equals."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest(rows, keys, F.col(order), F.col("__new")).drop("__new")


SEEN = ["first_seen", "last_seen", "times_seen"]


def merge_indexes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Two indexes (first_seen, last_seen, times_seen) as one: the earliest sight, the latest one, and the sum; newest fields win."""
    fields = [c for c in new.columns if c not in (*keys, *SEEN)]
    rows = old.select(*keys, *fields, *SEEN).unionByName(new.select(*keys, *fields, *SEEN))
    newest = F.max_by(F.struct(*fields), F.struct("last_seen", *fields)).alias("r")
    return rows.groupBy(*keys).agg(newest, F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times_seen").alias("times_seen")).select(*keys, "r.*", *SEEN)


def merge_seen(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """An index with a new batch of sights (seen_at)."""
    fresh = new.withColumns({"first_seen": F.col("seen_at"), "last_seen": F.col("seen_at"), "times_seen": F.lit(1).cast("bigint")}).drop("seen_at")
    return merge_indexes(old, fresh, keys)


def illegal_transitions(events: DataFrame, key: str, state: str, at: list[str], edges: list[tuple[str, str]], start: str | None = None) -> DataFrame:
    """Rows of a history whose state may not follow the one before it; the first follows start, if that is given."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*at))
    rows = events.withColumn("was", F.coalesce(before, F.lit(start).cast("string")) if start else before)
    allowed = F.array(*(F.concat_ws("\0", F.lit(a), F.lit(b)) for a, b in edges))
    return rows.filter(F.col("was").isNotNull() & ~F.array_contains(allowed, F.concat_ws("\0", F.col("was"), F.col(state))))


# The states of an incident and which may follow which.
INCIDENT_EDGES = [
    ("observed", "validating"),
    ("validating", "healthy"),
    ("validating", "witness_pending"),
    ("validating", "classifying"),
    ("witness_pending", "classifying"),
    ("witness_pending", "inconclusive"),
    ("classifying", "healthy"),
    ("classifying", "genuine_change"),
    ("classifying", "access_retry"),
    ("classifying", "inconclusive"),
    ("classifying", "drift_confirmed"),
    ("access_retry", "validating"),
    ("access_retry", "inconclusive"),
    ("inconclusive", "validating"),
    ("inconclusive", "witness_pending"),
    ("drift_confirmed", "healing"),
    ("healing", "awaiting_candidate"),
    ("healing", "repair_rejected"),
    ("awaiting_candidate", "verifying_candidate"),
    ("awaiting_candidate", "repair_rejected"),
    ("verifying_candidate", "awaiting_approval"),
    ("verifying_candidate", "repair_rejected"),
    ("repair_rejected", "healing"),
    ("repair_rejected", "rollback_or_escalate"),
    ("awaiting_approval", "approving"),
    ("awaiting_approval", "repair_rejected"),
    ("approving", "verifying_production"),
    ("verifying_production", "resolved"),
    ("verifying_production", "rollback_or_escalate"),
]


def due(collectors: DataFrame, now: Column, remaining: int, most: int, loads: int = LOADS_PER_RUN) -> DataFrame:
    """Active collectors (collector_id, last_at, min_interval_s, active) that are due, as many as budget and tick allow, longest waiting first."""
    waited = F.unix_timestamp(now) - F.unix_timestamp(F.to_timestamp("last_at"))
    ready = collectors.filter("active").filter(F.coalesce(waited >= F.col("min_interval_s"), F.lit(True)))
    return ready.orderBy(F.col("last_at").asc_nulls_first(), "collector_id").limit(max(0, min(most, remaining // loads)))
