"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Pieces are dealt into cells of bounded size. On each of a cell's islands a population of packings, which
begin as the pieces in random orders, evolves for a fixed number of generations: a child takes whole
well-filled bins from one parent, drops the other's bins that hold any of their pieces, and best-fits
what is displaced. Between epochs each island's elite migrates to the next island of its cell. Bins that
stay badly filled are dissolved and dealt into fewer cells, level by level, until one cell is left or a
level no longer lowers by half what is left to pack.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import blobs, checkpointed, map_batches, written
from .subwords import subwords, vocabulary_path

SEQUENCE = 4096  # tokens
END = 1  # id after each document
CELL = 3000  # pieces in one cell, about
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6  # in an epoch, each of two children
POPULATION = 6
ELITE = 2  # packings that an island passes on
FULL = 0.985  # a bin filled so far is kept when cells are dealt anew
PIECE = "array<struct<piece:int,start:bigint,length:bigint,ids:binary>>"

Bins = list[tuple[int, tuple[int, ...]]]  # load and pieces of each


def pieces(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every document.

    A document's ids are followed by END; one longer than a sequence is cut. A null or empty text is the
    END alone. Other columns are ignored.
    """
    path = vocabulary or vocabulary_path()

    def compute(batch: pa.RecordBatch) -> list:
        end = np.array([END], dtype="<u4").tobytes()
        out = []
        for ids in subwords(path).encode(blobs(batch)):
            ids += end
            out.append([{"piece": k, "start": at, "length": min(sequence, len(ids) // 4 - at), "ids": ids[4 * at : 4 * (at + sequence)]} for k, at in enumerate(range(0, len(ids) // 4, sequence))])
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]))
        return [pa.array(out, kind)]

    found = map_batches(docs.select("doc_id", "text"), [("pieces", PIECE)], compute)
    return found.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.piece", "p.start", "p.length", "p.ids")


def best_fit(items: Iterable[int], lengths: list[int], bins: Bins, room: int) -> Bins:
    """bins with the items added in their order, each where least is left."""
    loads = [load for load, _ in bins]
    held = [list(own) for _, own in bins]
    free = sorted((room - load, i) for i, load in enumerate(loads) if load < room)
    for item in items:
        need = lengths[item]
        at = bisect_left(free, (need, -1))
        if at < len(free):
            left, k = free.pop(at)
            loads[k] += need
            held[k].append(item)
        else:
            left, k = room, len(loads)
            loads.append(need)
            held.append([item])
        if left > need:
            insort(free, (left - need, k))
    return [(load, tuple(own)) for load, own in zip(loads, held)]


def fitness(bins: Bins) -> tuple[int, int]:
    """Fewer bins first, then fuller ones (and so also emptier ones that may be dissolved); the least is the fittest."""
    return len(bins), -sum(load * load for load, _ in bins)


def cross(a: Bins, b: Bins, lengths: list[int], room: int, rng: random.Random) -> Bins:
    """A child of b with whole well-filled bins of a; what they displace is best-fitted, longest first."""
    ranked = sorted(a, key=lambda x: -x[0])
    pool = ranked[: max(1, len(ranked) // 2)]
    given = rng.sample(pool, max(1, len(pool) // 2))
    taken = {i for _, own in given for i in own}
    child, displaced = list(given), []
    for load, own in b:
        if taken.isdisjoint(own):
            child.append((load, own))
        else:
            displaced += [i for i in own if i not in taken]
    return best_fit(sorted(displaced, key=lambda i: (-lengths[i], i)), lengths, child, room)


def loosen(bins: Bins, lengths: list[int], room: int, rng: random.Random) -> Bins:
    """A mutant: the emptiest bins and a few others are dissolved and their pieces best-fitted, longest first."""
    ranked = sorted(bins, key=lambda x: x[0])
    k = max(2, len(ranked) // 50)
    out = ranked[:k] + rng.sample(ranked[k:], min(len(ranked) - k, 2 * k)) if len(ranked) > k else ranked
    gone = {id(x) for x in out}
    loose = sorted((i for _, own in out for i in own), key=lambda i: (-lengths[i], i))
    return best_fit(loose, lengths, [x for x in bins if id(x) not in gone], room)


def evolve(lengths: list[int], seed: int, immigrants: list[list[int]], room: int = SEQUENCE, generations: int = GENERATIONS) -> list[Bins]:
    """The elite after one epoch of an island, fittest first. Immigrants: packings as the bin of every piece."""
    rng = random.Random(seed)
    population: list[Bins] = []
    for bin_of in immigrants:
        held: dict[int, list[int]] = {}
        for i, k in enumerate(bin_of):
            held.setdefault(k, []).append(i)
        population.append([(sum(lengths[i] for i in own), tuple(own)) for own in held.values()])
    while len(population) < POPULATION:
        population.append(best_fit(rng.sample(range(len(lengths)), len(lengths)), lengths, [], room))
    for _ in range(generations):
        a, b = rng.sample(population, 2)
        population += [cross(a, b, lengths, room, rng), loosen(cross(b, a, lengths, room, rng), lengths, room, rng)]
        population = sorted(population, key=fitness)[:POPULATION]
    return sorted(population, key=fitness)[:ELITE]


def _bin_of(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, (_, own) in enumerate(bins):
        for i in own:
            out[i] = k
    return out


ELITES = "array<struct<bins:int,squares:bigint,bin_of:array<int>>>"  # ascending: fittest first


def _epoch(room: int, number: int):
    kind = pa.list_(pa.struct([("bins", pa.int32()), ("squares", pa.int64()), ("bin_of", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i) for i in range(4)]
            out = []
            for cell, island, lengths, held in zip(*(c.to_pylist() for c in cols)):
                found = evolve(lengths, hash((cell, island, number)), [x["bin_of"] for x in held or []], room)
                out.append([{"bins": fitness(b)[0], "squares": fitness(b)[1], "bin_of": _bin_of(b, len(lengths))} for b in found])
            yield pa.RecordBatch.from_arrays([*cols[:3], pa.array(out, kind)], names=["cell", "island", "lengths", "elites"])

    return run


def _pack_cells(cells: DataFrame, room: int, islands: int, epochs: int) -> DataFrame:
    """cells (cell, lengths) with bin_of: the fittest packing that any island found."""
    state = cells.select("cell", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.array().cast(ELITES).alias("elites"))
    for number in range(epochs):
        state = state.mapInArrow(_epoch(room, number), f"cell bigint, island int, lengths array<int>, elites {ELITES}")
        if number + 1 < epochs:
            # an island keeps its elite and gets the fittest one of the island before it
            to = F.explode(F.array(F.struct(F.col("island").alias("island"), F.col("elites").alias("elites")), F.struct(((F.col("island") + 1) % islands).alias("island"), F.slice("elites", 1, 1).alias("elites"))))
            moved = state.select("cell", "lengths", to.alias("m"))
            state = moved.groupBy("cell", "m.island").agg(F.first("lengths").alias("lengths"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("m.elites")))).alias("elites"))
            state = state.select("cell", "island", "lengths", "elites")
    return state.groupBy("cell").agg(F.min(F.col("elites")[0]).alias("best")).select("cell", "best.bin_of")


def pack(rows: DataFrame, room: int = SEQUENCE, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """rows (with a length of 1 to room) with sequence_id and offset; gapless from 0 in every sequence.

    Rows that repeat are packed each. Columns of rows named sequence_id, offset or __row are replaced.
    """
    rows = rows.drop("sequence_id", "offset", "__row")
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()))
    left = rows.select("__row", F.col("length").cast("int").alias("length"))
    whole = left.filter(F.col("length") == room).select("__row", F.col("__row").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    left, done = left.filter(F.col("length") < room), whole
    n, level, last = left.count(), 0, False
    while n and not last:
        count = -(-n // cell)
        own = F.pmod(F.xxhash64("__row", F.lit(level)), F.lit(count))
        cells = left.groupBy(own.alias("cell")).agg(F.sort_array(F.collect_list(F.struct(F.col("length"), F.col("__row").alias("row"))), asc=False).alias("items"))
        cells = checkpointed(cells)
        best = _pack_cells(cells.select("cell", F.col("items.length").alias("lengths")), room, islands, epochs)
        placed = cells.join(best, "cell").select("cell", F.explode(F.arrays_zip("items", "bin_of")).alias("x"))
        placed = placed.select("cell", F.col("x.items.row").alias("__row"), F.col("x.items.length").alias("length"), F.col("x.bin_of").alias("bin"))
        bins = placed.groupBy("cell", "bin").agg(F.sum("length").alias("load"), F.sort_array(F.collect_list(F.struct("length", F.col("__row").alias("row"))), asc=False).alias("items"))
        bins = checkpointed(bins)
        again = bins.filter(F.col("load") < FULL * room).agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
        last = count == 1 or 2 * again > n
        ready = bins if last else bins.filter(F.col("load") >= FULL * room)
        # the level above 57 bits of cell and bin; a whole piece has level 0 and its row's number
        sequence = F.lit((level + 1) << 57) + F.shiftleft("cell", (4 * cell).bit_length()) + F.col("bin")
        ready = ready.select(sequence.alias("sequence_id"), F.explode("items").alias("x")).select(F.col("x.row").alias("__row"), "sequence_id", "x.length")
        upto = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("length"), "__row").rowsBetween(Window.unboundedPreceding, 0))
        ready = ready.select("__row", "sequence_id", (upto - F.col("length")).alias("offset"))
        done = done.unionByName(ready)
        if not last:
            left = bins.filter(F.col("load") < FULL * room).select(F.explode("items").alias("x")).select(F.col("x.row").alias("__row"), "x.length")
            n, level = again, level + 1
    return rows.join(done, "__row").drop("__row")
