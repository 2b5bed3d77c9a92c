"""Stateful streams: admission by sliding windows, incident histories, freshness and merged indexes."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import isnan

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as SqlWindow

from lumenyard.operators.serving import INCIDENT_EDGES, merge_indexes

PER_CALLER, OVERALL, WINDOW_SECONDS = 5, 120, 3600
OUT_ROWS = 10_000  # events that are given back at once
CELLS = 16  # parts of a window in which requests are counted
CHUNK = 100_000  # requests that are put in order together
PIECE = 512  # requests that are packed together


def admit(stamps: list[float], asked: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Which requests (in time order) a sliding window lets through, and the stamps that it then holds.

    A request that is refused takes no place in the window. One without a time (NaN) is refused.
    """
    held, out = list(stamps), []
    for at in asked:
        if isnan(at):
            out.append(False)
            continue
        held = [s for s in held if s > at - window]
        ok = len(held) < limit
        out.append(ok)
        if ok:
            held.append(at)
    return out, held


@dataclass(frozen=True)
class Limits:
    """How many requests one caller and all callers together may make in any window."""

    per_caller: int = PER_CALLER
    overall: int = OVERALL
    window: float = WINDOW_SECONDS


class Window:
    """The admitted requests of the last window, at most as many as are allowed overall, with their callers."""

    def __init__(self, limits: Limits, held: Iterable[tuple[float, object]] = ()):
        self.limits, self.held = limits, deque(held)
        self.own = Counter(caller for _, caller in self.held)

    def take(self, caller: object, at: float) -> str:
        """Admits the request and takes its place, or says why not; asking and taking are one step.

        admitted, busy (all callers' places are taken), caller (this one's are) or undated.
        """
        if isnan(at):
            return "undated"
        while self.held and self.held[0][0] <= at - self.limits.window:
            self.own[self.held.popleft()[1]] -= 1
        if len(self.held) >= self.limits.overall:
            return "busy"
        if self.own[caller] >= self.limits.per_caller:
            return "caller"
        self.held.append((at, caller))
        self.own[caller] += 1
        return "admitted"


def _seconds(stamps: pa.Array) -> list[float]:
    micros = stamps.cast(pa.timestamp("us", tz=stamps.type.tz)).cast(pa.int64()).to_pylist()
    return [float("nan") if m is None else m / 1e6 for m in micros]


def limited(requests: DataFrame, caller: str, at: str, limit: int = PER_CALLER, window: float = WINDOW_SECONDS) -> DataFrame:
    """A batch of requests with admitted: at most limit in any window of each caller. Ties by all columns.

    A caller's requests pass through one task in time order, a batch at a time, since each depends on those
    before it; only the window's stamps are held. A request without a time is refused.
    """
    schema = ", ".join(f"{n} {t}" for n, t in requests.dtypes) + ", admitted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, begun = None, [], False
        for batch in batches:
            seconds = _seconds(batch.column(at))
            callers, admitted = batch.column(caller).to_pylist(), []
            while len(admitted) < len(callers):
                first = len(admitted)
                if not begun or callers[first] != now:
                    now, held, begun = callers[first], [], True
                to = next((i for i in range(first, len(callers)) if callers[i] != now), len(callers))
                ok, held = admit(held, seconds[first:to], limit, window)
                admitted += ok
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(admitted, pa.bool_())], names=[*batch.schema.names, "admitted"])

    order = [F.col(caller), F.col(at).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in requests.columns if c not in (caller, at))]
    return requests.repartition(caller).sortWithinPartitions(*order).mapInArrow(run, schema)


def _chunks(requests: DataFrame, at: str, window: float) -> DataFrame:
    """requests with __run and __chunk, which part them by time; null where there is no time.

    A run begins after a whole window without a request, so none of what was before counts in it. Its chunks follow
    each other and hold CHUNK requests or little more, unless more are made in one cell, a small part of a window.
    """
    cell = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / 1e6 / (window / CELLS)).alias("__cell")
    # as many rows as cells in which anything was asked
    cells = requests.filter(F.col(at).isNotNull()).groupBy(cell).agg(F.count("*").alias("n"))
    order = SqlWindow.partitionBy(F.lit(0)).orderBy("__cell")
    upto = order.rowsBetween(SqlWindow.unboundedPreceding, 0)
    begins = F.coalesce(F.col("__cell") - F.lag("__cell").over(order) > CELLS + 1, F.lit(True))
    cells = cells.select("__cell", begins.alias("begins"), (F.sum("n").over(upto) - F.col("n")).alias("before"))
    begun = F.max(F.when(F.col("begins"), F.col("before"))).over(upto)
    # short spells share a run and its first chunk; only the last spell of a run can go beyond it
    cells = cells.select("__cell", F.floor(begun / CHUNK).alias("__run"), F.floor((F.col("before") - begun) / CHUNK).alias("__chunk"))
    return requests.withColumn("__cell", cell).join(cells, "__cell", "left").select(*requests.columns, "__run", "__chunk")


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def limited_overall(requests: DataFrame, caller: str, at: str, limits: Limits = Limits()) -> DataFrame:
    """A batch of requests with ruling (see Window.take), by a limit for each caller and one for all together.

    A request is admitted or refused in time order (ties by caller, then by all columns), and a place is taken
    only by what is admitted, so requests depend on those before. They are put in order in chunks of time, each in one
    task. Callers and times alone, packed, then pass through one task for each run of chunks (see _chunks), which finds the
    places that are taken where a chunk begins; while none is free it goes on to the next that is given back. From
    there the chunks are ruled on apart from each other. Requests without a time are refused.
    Columns named ruling, __cell, __run, __chunk and __held are replaced.
    """
    requests = requests.drop("ruling", "__cell", "__run", "__chunk", "__held")
    rows = _chunks(requests, at, limits.window)
    kinds = dict(requests.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = 0
        for batch in batches:
            run, chunk = batch.column("__run").to_numpy(), batch.column("__chunk").to_numpy()
            cuts = np.flatnonzero((np.diff(run) != 0) | (np.diff(chunk) != 0)) + 1
            cuts = np.union1d(np.append(cuts, len(run)), np.arange(0, len(run), PIECE)).tolist()
            asked = pa.RecordBatch.from_arrays([batch.column(caller), batch.column(at)], names=["caller", "at"])
            out = [(run[i], chunk[i], pieces + k, _packed(asked.slice(i, z - i))) for k, (i, z) in enumerate(zip(cuts, cuts[1:]))]
            pieces += len(out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["__run", "__chunk", "piece", "data"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, places = None, Window(limits)
        for batch in batches:
            found = []
            for run, chunk, data in zip(batch.column("__run").to_pylist(), batch.column("__chunk").to_pylist(), batch.column("data")):
                asked = pa.ipc.open_stream(data.as_buffer()).read_next_batch()
                callers = asked.column("caller")
                if now is None or now[0] != run:
                    places = Window(limits)
                if now != (run, chunk):
                    now = (run, chunk)
                    held = [pa.array([s for s, _ in places.held], pa.float64()), pa.array([n for _, n in places.held], callers.type)]
                    found.append((run, chunk, _packed(pa.RecordBatch.from_arrays(held, names=["stamps", "callers"]))))
                times = np.array(_seconds(asked.column("at")))
                before, i = times - limits.window, 0
                while i < len(times):
                    if places.held and len(places.held) >= limits.overall:  # all are refused until the first place is given back
                        i = max(i, int(np.searchsorted(before, places.held[0][0])))
                        if i == len(times):
                            break
                    places.take(callers[i].as_py(), float(times[i]))
                    i += 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.binary()))], names=["__run", "__chunk", "__held"])

    def rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Window(limits)
        for batch in batches:
            begins, rulings = batch.column("__held").is_valid(), []
            for held, name, when in zip(batch.column("__held"), batch.column(caller).to_pylist(), _seconds(batch.column(at))):
                if held.is_valid:  # a chunk begins
                    kept = pa.ipc.open_stream(held.as_buffer()).read_next_batch()
                    places = Window(limits, zip(kept.column("stamps").to_pylist(), kept.column("callers").to_pylist()))
                rulings.append(None if held.is_valid else places.take(name, when))
            out = pa.RecordBatch.from_arrays([*(batch.column(n) for n in kinds), pa.array(rulings, pa.string())], names=[*kinds, "ruling"])
            yield out.filter(pc.invert(begins))

    in_time = [F.col(at).asc_nulls_last(), F.col(caller).asc_nulls_last()]
    dated = rows.filter(F.col("__run").isNotNull()).select("__run", "__chunk", caller, at)
    packed = dated.repartition("__run", "__chunk").sortWithinPartitions("__run", "__chunk", *in_time).mapInArrow(pack, "__run bigint, __chunk bigint, piece bigint, data binary")
    begun = packed.repartition("__run").sortWithinPartitions("__run", "__chunk", "piece").mapInArrow(walk, "__run bigint, __chunk bigint, __held binary")
    # those without a time, which nothing depends on, are dealt by caller
    dealt = rows.withColumns({"__chunk": F.coalesce("__chunk", F.pmod(F.xxhash64(caller), F.lit(CELLS))), "__held": F.lit(None).cast("binary")})
    others = [F.col(c).asc_nulls_last() for c in requests.columns if c not in (caller, at)]
    parts = dealt.unionByName(begun, allowMissingColumns=True).repartition("__run", "__chunk").sortWithinPartitions("__run", "__chunk", F.col("__held").isNull(), *in_time, *others)
    return parts.mapInArrow(rule, ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", ruling string")


def limited_stream(requests: DataFrame, caller: str, at: str, limit: int = PER_CALLER, window: float = WINDOW_SECONDS) -> DataFrame:
    """The same as limited() over a stream (caller, at): the window's stamps are the state. Requests that come late by
    the watermark are dropped by Spark before they get here; that is an addition of this engine.

    Of a micro-batch's requests of one caller a number each is held, which puts the chunks in one order.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stamps = list(state.get[0]) if state.exists else []
        times = np.sort(np.concatenate([pdf[at].to_numpy("datetime64[us]") for pdf in batches]))  # those without a time last
        for begin in range(0, len(times), OUT_ROWS):
            some = times[begin : begin + OUT_ROWS]
            ok, stamps = admit(stamps, _as_seconds(some), limit, window)
            yield pd.DataFrame({caller: [key[0]] * len(some), at: some, "admitted": ok})
        state.update((stamps,))

    kinds = dict(requests.dtypes)
    out = f"{caller} {kinds[caller]}, {at} {kinds[at]}, admitted boolean"
    return requests.groupBy(caller).applyInPandasWithState(run, out, "stamps array<double>", "append", GroupStateTimeout.NoTimeout)


def _as_seconds(times: np.ndarray) -> list[float]:
    return np.where(np.isnat(times), np.nan, times.astype("int64") / 1e6).tolist()


def limited_overall_stream(requests: DataFrame, caller: str, at: str, limits: Limits = Limits()) -> DataFrame:
    """The same as limited_overall() over a stream (caller a string, at): the places that are taken are the state.

    All requests share one state, so a micro-batch passes through one task; maxFilesPerTrigger or its like bounds it.
    Of each request a time, a number for its caller and a place in the order are held there, and each caller's name once.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stamps, names = state.get if state.exists else ([], [])
        places = Window(limits, zip(stamps, names))
        numbers: dict[str | None, int] = {}
        times, codes = [], []
        for pdf in batches:
            times.append(pdf[at].to_numpy("datetime64[us]"))
            own, found = pd.factorize(pdf[caller].astype(object), use_na_sentinel=False)
            codes.append(np.array([numbers.setdefault(None if pd.isna(n) else n, len(numbers)) for n in found], dtype=np.int32)[own])
        times, codes = np.concatenate(times), np.concatenate(codes)
        names = np.array(list(numbers), dtype=object)
        rank = np.empty(len(names), dtype=np.int32)
        rank[sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))] = np.arange(len(names), dtype=np.int32)
        order = np.lexsort((rank[codes], times))  # those without a time last
        for begin in range(0, len(order), OUT_ROWS):
            some = order[begin : begin + OUT_ROWS]
            callers = names[codes[some]]
            rulings = [places.take(name, s) for name, s in zip(callers, _as_seconds(times[some]))]
            yield pd.DataFrame({caller: callers, at: times[some], "ruling": rulings})
        state.update(([s for s, _ in places.held], [n for _, n in places.held]))

    kinds = dict(requests.dtypes)
    out = f"{caller} {kinds[caller]}, {at} {kinds[at]}, ruling string"
    return requests.select(caller, at, F.lit(0).alias("__all")).groupBy("__all").applyInPandasWithState(run, out, "stamps array<double>, callers array<string>", "append", GroupStateTimeout.NoTimeout)


def lifecycle_stream(events: DataFrame, key: str, state_column: str, edges: list[tuple[str, str]] = INCIDENT_EDGES, start: str = "observed") -> DataFrame:
    """key, state, legal for every event of a stream; an event that may not follow leaves the state as it was.

    Spark hands over a large group in several chunks, in no set order, so a micro-batch's events of one key are
    sorted together; a number and a code are held for each. Ties keep the order in which they came.
    """
    allowed = set(edges)

    def run(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else start
        codes: dict[str, int] = {}
        seqs, tos = [], []
        for pdf in batches:
            seqs.append(pdf["seq"].to_numpy())
            tos.append(np.array([codes.setdefault(to, len(codes)) for to in pdf[state_column]], dtype=np.int32))
        names, to_code = list(codes), np.concatenate(tos)
        to_code = to_code[np.argsort(np.concatenate(seqs), kind="stable")]
        for at in range(0, len(to_code), OUT_ROWS):
            rows = []
            for to in (names[c] for c in to_code[at : at + OUT_ROWS]):
                legal = (now, to) in allowed
                now = to if legal else now
                rows.append((own[0], to, legal))
            yield pd.DataFrame(rows, columns=[key, state_column, "legal"])
        state.update((now,))

    kinds = dict(events.dtypes)
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {state_column} string, legal boolean", "now string", "append", GroupStateTimeout.NoTimeout)


def merge_into(path: str, keys: list[str]):
    """A foreachBatch function that merges batches (with seen_at) into a Parquet index; each version is a folder of its own."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fields = [c for c in batch.columns if c not in (*keys, "seen_at")]
        newest = F.max_by(F.struct(*fields), F.struct("seen_at", *fields)).alias("r")
        fresh = batch.groupBy(*keys).agg(newest, F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count("*").alias("times_seen")).select(*keys, "r.*", "first_seen", "last_seen", "times_seen")
        out = fresh if epoch == 0 else merge_indexes(spark.read.parquet(f"{path}/v{epoch - 1}"), fresh, keys)
        out.write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return run
