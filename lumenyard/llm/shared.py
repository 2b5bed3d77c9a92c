"""Helpers that several of the training-data operators use."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenyard.sources.tables import shared_folder, table

__all__ = ["blobs", "checkpointed", "filtered", "fold", "map_batches", "replaced_batches", "shared_folder", "slices", "small_batches", "starts_of", "table", "written"]


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        jvm, sc = spark.sparkContext._jvm, spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended before the interpreter did
        return


def written(df: DataFrame, **options: str | int) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: cuts the lineage, and any executor can read it.

    options are those of Spark's Parquet writer.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/lumenyard-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(folder)
    atexit.register(_delete, spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint, for the small tables of iterations."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def blobs(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes; null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it holds, jobs hand Python tasks batches of fewer rows, so executors keep less outside their heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, so that what a task makes of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, fields: list[tuple[str, str]], compute: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """df with further columns, which compute() gives for each Arrow batch; columns of these names are replaced."""
    return replaced_batches(df.drop(*(n for n, _ in fields)), fields, compute)


def replaced_batches(df: DataFrame, fields: list[tuple[str, str]], compute: Callable[[pa.RecordBatch], list], rows: int = 1000, without: Sequence[str] = ()) -> DataFrame:
    """df with the columns that compute() gives for batches of so many rows in place of those of these names.

    compute() also sees the columns named in without, which are left out of the result.
    """
    names = [n for n, _ in fields]
    kept = [f for f in df.schema.fields if f.name not in names and f.name not in without]
    schema = T.StructType(kept + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            own = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, *compute(batch)], names=[*(f.name for f in kept), *names])

    return df.mapInArrow(run, schema)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs of these lengths begins, and the total at the end."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def filtered(docs: DataFrame, added: list[str], annotate: Callable[[DataFrame], DataFrame], keep: Column) -> DataFrame:
    """The rows of docs, with just its columns, that annotate() gives columns (added) which keep holds for.

    Columns of docs that bear such a name are set aside meanwhile.
    """
    aside = {c: f"__aside_{c}" for c in docs.columns if c in added}
    found = annotate(docs.withColumnsRenamed(aside)).filter(keep)
    return found.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))
