"""Reading and keeping tables: Parquet inputs, JSON that comes in several forms, and folders that a cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenyard.functions.text import let


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session takes a temporary
    one; on a cluster that is an error, since every machine would have its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lumenyard-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session has not ended before the interpreter
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder; they are deleted when the interpreter ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    atexit.register(_delete, spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def variants(text: Column) -> Column:
    """Rows of a JSON text as an array of variants: an array's members, or a single object as the one row; null if unreadable."""
    many = lambda parsed: F.try_variant_get(parsed, "$", "array<variant>")
    return let(F.try_parse_json(text), lambda parsed: F.when(parsed.isNotNull(), F.coalesce(many(parsed), F.array(parsed))))


def salvaged(text: Column) -> Column:
    """The first JSON object or array within noisy output, as a variant."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, "(?s)(\\[.*\\]|\\{.*\\})", 1), F.lit("")))


def field_at(row: Column, path: str, kind: str = "string") -> Column:
    """struct<found, value> at a dotted path of a variant: a null that is there is found, a missing key is not."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    got = F.try_variant_get(row, f"${steps}", "variant")
    return F.struct(got.isNotNull().alias("found"), F.try_variant_get(row, f"${steps}", kind).alias("value"))


def keep_latest(runs: DataFrame, most: int, order: Column) -> DataFrame:
    """The newest runs of a log of bounded length, found by a top-k and not by sorting all."""
    return runs.orderBy(order.desc()).limit(most)


def append_or_replace(log: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The log without the keys that come anew, and the new rows."""
    return log.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def with_order(rows: DataFrame, *by: str) -> DataFrame:
    """rows with ord, their place in a stated order, for what keeps first ones; found per range, not in one task."""
    parts = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return parts.withColumn("ord", F.monotonically_increasing_id())


def screenshots(spark: SparkSession, folder: str, newer_than: Column | None = None) -> DataFrame:
    """path, modificationTime and content of the PNG files in a folder, checked by their first bytes."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    found = found.filter(F.substring("content", 1, 4) == F.lit(bytes([0x89, 0x50, 0x4E, 0x47])))
    return found if newer_than is None else found.filter(F.col("modificationTime") >= newer_than)


def first_of_each(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place).filter("place = 1").drop("place")
