"""Shards by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows of equal text form a group; a group larger than a small share of a shard is cut into several. The
groups are dealt into cells, each cell packs its own into as many bins as there are shards (largest
first, each to the bin whose residual capacity has the highest dot product with it), and the bins of all
cells are packed the same way, level by level, until one cell is left. Places in a shard add up from the
offsets of the levels, so no shard is ever sorted as a whole. Between levels a file is written for each
partition that holds a cell, not for each shuffle partition as a checkpoint does: to create a file can
cost a local or shared file system a process of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

SHARDS = 24
CELL = 20_000  # groups in one cell, about
PIECES = 64  # a group holds at most one such part of a shard, in bytes and in rows
OVERHEAD = 8  # bytes that each row takes besides its text
REPAIRS = 300  # exchanges that level the bytes of a cell's bins, at most
ASIDE = 0.05  # what an exchange of tokens and rows costs beside one of bytes
GROUP_KEY = ["xx", "text_crc32", "size", "salt"]


def place(sizes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each vector (bytes, tokens, rows) and the rows that lie in that bin before it.

    Vectors count as shares of a bin's capacity in each of the three, which weigh alike; the one with the
    largest share is placed first, where its dot product with what is left of a bin is highest.
    """
    unit = sizes / np.maximum(sizes.sum(axis=0), 1) * shards  # of a bin's capacity
    residual = np.ones((shards, sizes.shape[1]))
    bins = np.empty(len(sizes), dtype=np.int64)
    for i in np.argsort(-unit.max(axis=1), kind="stable"):
        k = int((residual @ unit[i]).argmax())
        bins[i] = k
        residual[k] -= unit[i]
    bins = levelled(unit, bins, shards)
    by = np.argsort(bins, kind="stable")
    upto = np.cumsum(sizes[by, 2]) - sizes[by, 2]
    head = np.searchsorted(bins[by], bins[by])  # the first of its bin
    offsets = np.empty(len(sizes), dtype=np.int64)
    offsets[by] = upto - upto[head]
    return bins, offsets


def levelled(unit: np.ndarray, bins: np.ndarray, shards: int, most: int = REPAIRS) -> np.ndarray:
    """A local repair for the law: the fullest bin gives the emptiest one an item, or swaps one with it, as long
    as that brings their bytes nearer to each other; among exchanges those that leave tokens and rows alone."""
    bins = bins.copy()
    size = unit[:, 0]
    load = np.bincount(bins, weights=size, minlength=shards)
    padded = np.append(unit, np.zeros((1, unit.shape[1])), axis=0)  # the last one: nothing comes back
    for _ in range(most if len(size) else 0):
        high, low = int(load.argmax()), int(load.argmin())
        gap = (load[high] - load[low]) / 2
        give, back = np.flatnonzero(bins == high), np.flatnonzero(bins == low)
        back = back[np.argsort(size[back], kind="stable")]
        near = np.searchsorted(size[back], size[give] - gap)[:, None] + np.arange(-2, 2)
        choice = np.append(np.append(back, -1)[np.where((near >= 0) & (near < len(back)), near, -1)], np.full((len(give), 1), -1), axis=1)
        moved = unit[give][:, None] - padded[choice]
        off = np.abs(moved[..., 0] - gap)
        cost = np.where(off < gap * 0.999, off + ASIDE * np.abs(moved[..., 1:]).sum(axis=-1), np.inf)
        g, c = np.unravel_index(int(cost.argmin()), cost.shape)
        if not np.isfinite(cost[g, c]):
            break
        bins[give[g]] = low
        if choice[g, c] >= 0:
            bins[choice[g, c]] = high
        load[high] -= moved[g, c, 0]
        load[low] += moved[g, c, 0]
    return bins


def _pack_cells(items: DataFrame, keys: list[str], shards: int) -> DataFrame:
    """items (keys, cell, bytes, tokens, rows) with bin and offset within their cell."""
    kinds = dict(items.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "cell", "bytes", "tokens", "rows"]) + ", bin bigint, offset bigint"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys, kind="stable", ignore_index=True)
        pdf["bin"], pdf["offset"] = place(pdf[["bytes", "tokens", "rows"]].to_numpy(dtype=np.float64), shards)
        return pdf

    return items.select(*keys, "cell", "bytes", "tokens", "rows").groupBy("cell").applyInPandas(pack, schema)


def shard(docs: DataFrame, shards: int = SHARDS, cell: int = CELL, pieces: int = PIECES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (from 0 without gaps in each shard) for every row.

    size is the text's UTF-8 bytes plus OVERHEAD; tokens are counted as words. A null text has no bytes.
    Bytes come out near equal; rows of one text share a shard unless they are too many. Repeated ids are
    rows of their own; among rows of one text and id, which takes which slot is not defined. Other columns
    are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("bigint") + OVERHEAD).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("xx"),
            F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")).cast("bigint").alias("n_tokens"),
            F.monotonically_increasing_id().alias("row"),  # written, so a row keeps its number
        )
    )
    texts = F.approx_count_distinct(F.xxhash64("xx", "text_crc32", "size"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows"), texts.alias("groups")).first()
    most_bytes, most_rows = max(1, total["bytes"] // (shards * pieces)), max(1, total["rows"] // (shards * pieces))
    groups = rows.groupBy("xx", "text_crc32", "size").agg(F.count("*").alias("n"))
    cuts = F.greatest(F.ceil(F.col("n") * F.col("size") / most_bytes), F.ceil(F.col("n") / most_rows))
    # every group in it has over a part's bytes or rows, so there are at most 2 * shards * pieces
    large = groups.filter((F.col("n") > 1) & (cuts > 1)).select("xx", "text_crc32", "size", cuts.alias("cuts"))
    salt = F.pmod(F.xxhash64("row"), F.coalesce("cuts", F.lit(1)))
    rows = rows.join(F.broadcast(large), ["xx", "text_crc32", "size"], "left").withColumn("salt", salt).drop("cuts")
    atoms = rows.groupBy(*GROUP_KEY).agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    n = max(1, -(-total["groups"] // cell))
    packed = written(_pack_cells(atoms.withColumn("cell", F.pmod(F.xxhash64("xx", "salt"), F.lit(n))), GROUP_KEY, shards))
    placed = packed.select(*GROUP_KEY, F.col("cell").alias("up_cell"), F.col("bin").alias("up_bin"), "offset")
    level = packed
    while n > 1:
        bins = level.groupBy("cell", "bin").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))
        n = max(1, -(-n * shards // cell))
        bins = bins.select(F.col("cell").alias("from_cell"), F.col("bin").alias("from_bin"), F.pmod(F.xxhash64("cell"), F.lit(n)).alias("cell"), "bytes", "tokens", "rows")
        level = written(_pack_cells(bins, ["from_cell", "from_bin"], shards))
        step = level.select(F.col("from_cell").alias("up_cell"), F.col("from_bin").alias("up_bin"), F.col("cell").alias("to_cell"), F.col("bin").alias("to_bin"), F.col("offset").alias("more"))
        placed = placed.join(step, ["up_cell", "up_bin"]).select(*GROUP_KEY, F.col("to_cell").alias("up_cell"), F.col("to_bin").alias("up_bin"), (F.col("offset") + F.col("more")).alias("offset"))
    placed = placed.select(*GROUP_KEY, F.col("up_bin").cast("int").alias("shard"), "offset")
    within = F.row_number().over(Window.partitionBy(*GROUP_KEY).orderBy("doc_id")) - 1
    return rows.withColumn("within", within).join(placed, GROUP_KEY).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("within")).alias("slot"))
