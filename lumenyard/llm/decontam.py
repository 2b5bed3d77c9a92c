"""Benchmark decontamination by suffix arrays over the training texts.

Each Arrow batch of documents is a shard with a suffix array of its own. All suffixes of the benchmark
texts are looked up in it at once by binary search on one word after another; where a whole window is
found, its places are read off the array, and windows in step with each other merge into the longest
verbatim matches. Benchmark texts come in blocks of bounded size, one for each pass over the documents, so
no more than one of them is ever held.

Words that no benchmark text has cannot be part of a match. They break the shard's text up, and the
pieces too short to hold a window are left out of the array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blobs, filtered, replaced_batches, starts_of, written

WINDOW = 13  # words
SHARE = 20  # contaminated: one word in so many is hit
BLOCK_BYTES = 8 << 20  # benchmark text in one block, about
SHARD_WORDS = 2_000_000  # words in one suffix array; a longer document has one alone
SHARD_ROWS = 10_000  # documents in one, at most
#: A-Z to lower case; all of ASCII but digits and letters to a space.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MATCH = "array<struct<item_id:string,item_pos:bigint,doc_pos:bigint,length:bigint>>"


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (in lower case), digits and all that is not ASCII."""
    return text.translate(WORD_TABLE).split()


@dataclass
class Block:
    """Benchmark texts as word ids (from 1), ready to be looked up."""

    items: list[str]
    vocabulary: dict[bytes, int]
    text: np.ndarray  # all items' word ids, each followed by a 0
    item: np.ndarray  # of each suffix, its item's place in items
    at: np.ndarray  # where the suffix begins in text
    pos: np.ndarray  # where it begins in its item
    window: np.ndarray  # words in its item's windows
    deepest: int


def block_of(rows: list[tuple[str, bytes]], window: int = WINDOW) -> Block | None:
    """rows: item ids and texts; an item of fewer words than a window is one window."""
    vocabulary: dict[bytes, int] = {}
    items, texts = [], []
    for item, text in rows:
        if words := words_of(text):
            items.append(item)
            texts.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], dtype=np.int64))
    if not items:
        return None
    n = np.array([len(t) for t in texts])
    own = np.minimum(n, window)
    count = n - own + 1  # suffixes that still hold a window
    item = np.repeat(np.arange(len(items)), count)
    pos = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = starts_of(n + 1)[:-1]
    text = np.concatenate([np.append(t, 0) for t in texts])
    return Block(items, vocabulary, text, item, begin[item] + pos, pos, own[item], int(own.max()))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix places in the order of their first depth symbols at least, by doubling."""
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    n, h = len(text), 1
    order = np.argsort(rank, kind="stable")
    while h < depth:
        second = np.zeros(n, dtype=np.int64)
        second[: n - h] = rank[h:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], (np.diff(key[order]) > 0).cumsum()])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            break
        h *= 2
    return order


def _bound(text: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, symbol: np.ndarray, right: bool) -> np.ndarray:
    """In each range [lo, hi) of the array, which is sorted by the symbol at this depth: where symbol would go."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = order[np.minimum(mid, len(order) - 1)] + depth
        seen = np.where(at < len(text), text[np.minimum(at, len(text) - 1)], -1)
        below = open_ & ((seen <= symbol) if right else (seen < symbol))
        lo = np.where(below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


def windows_in(text: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Places in text (word ids, 0 where the benchmark lacks the word) and the benchmark suffix whose window is there."""
    order = suffix_array(text, block.deepest)
    live = np.arange(len(block.at))
    lo, hi = np.zeros(len(live), dtype=np.int64), np.full(len(live), len(text), dtype=np.int64)
    places, suffixes = [], []
    for depth in range(block.deepest):
        symbol = block.text[block.at[live] + depth]
        lo, hi = (_bound(text, order, lo, hi, depth, symbol, right) for right in (False, True))
        found = hi > lo
        live, lo, hi = live[found], lo[found], hi[found]
        if not len(live):
            break
        whole = block.window[live] == depth + 1
        if whole.any():
            width = (hi - lo)[whole]
            inside = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            places.append(order[np.repeat(lo[whole], width) + inside])
            suffixes.append(np.repeat(live[whole], width))
            live, lo, hi = live[~whole], lo[~whole], hi[~whole]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(places), np.concatenate(suffixes)) if places else (none, none)


def matches_in(docs: list[list[bytes]], block: Block) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches of a window or more: document, item, place in the item, place in the document, words."""
    n = np.array([len(d) for d in docs])
    begin = starts_of(n + 1)
    get = block.vocabulary.get
    flat = np.zeros(int(begin[-1]), dtype=np.int64)
    for d, at in zip(docs, begin):
        flat[at : at + len(d)] = np.fromiter((get(w, 0) for w in d), dtype=np.int64, count=len(d))
    breaks = np.flatnonzero(flat == 0)  # after each document at least
    first = np.concatenate([[0], breaks[:-1] + 1])
    size = breaks - first
    long = size >= block.window.min()
    first, size = first[long], size[long] + 1  # with the break
    to = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    origin = np.repeat(first, size) + to
    none = np.zeros(0, dtype=np.int64)
    if not len(origin):
        return none, none, none, none, none
    place, suffix = windows_in(flat[origin], block)
    place = origin[place]
    doc = np.searchsorted(begin, place, "right") - 1
    item, pos, words = block.item[suffix], block.pos[suffix], block.window[suffix]
    shift = place - pos
    by = np.lexsort((place, shift, item, doc))
    doc, item, pos, words, place, shift = (x[by] for x in (doc, item, pos, words, place, shift))
    if not len(doc):
        return none, none, none, none, none
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (place[1:] > place[:-1] + words[:-1])])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(doc)) - 1
    return doc[head], item[head], pos[head], place[head] - begin[doc[head]], pos[last] + words[last] - pos[head]


def _shards(docs: list[list[bytes]], most: int) -> Iterator[tuple[int, int]]:
    at = total = 0
    for i, d in enumerate(docs):
        if total and total + len(d) > most:
            yield at, i
            at, total = i, 0
        total += len(d)
    if at < len(docs):
        yield at, len(docs)


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items as lists of about so many bytes, dealt by a hash; each is read when it is asked for. Null ids and
    texts are left out."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).dropna()
    n = -(-rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // block_bytes)
    for k in range(n):
        own = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        found = own.toArrow()
        yield list(zip(found["item_id"].to_pylist(), found["text"].to_pylist()))


def _matched(docs: DataFrame, rows: list[tuple[str, bytes]], window: int, shard_words: int, first: bool) -> DataFrame:
    """docs with bench_words, and bench_matches lengthened by those of one block."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("item_pos", pa.int64()), ("doc_pos", pa.int64()), ("length", pa.int64())]))
    held: dict[str, Block | None] = {}

    def compute(batch: pa.RecordBatch) -> list:
        if "block" not in held:  # once in a task
            held["block"] = block_of(shared.value, window)
        block = held["block"]
        words = [words_of(b) for b in blobs(batch)]
        matches: list[list[dict]] = [[] for _ in words] if first else batch.column("bench_matches").to_pylist()
        for a, z in _shards(words, shard_words) if block else ():
            for d, i, p, at, n in zip(*(x.tolist() for x in matches_in(words[a:z], block))):
                matches[a + d].append({"item_id": block.items[i], "item_pos": p, "doc_pos": at, "length": n})
        return [pa.array([len(w) for w in words], pa.int64()), pa.array(matches, kind)]

    return replaced_batches(docs, [("bench_words", "bigint"), ("bench_matches", MATCH)], compute, rows=SHARD_ROWS)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with bench_words, bench_hit (words inside a window that a benchmark text has) and bench_matches.

    bench_matches lists the longest verbatim matches with their places in item and document. A null or
    empty text has no words and no match; an empty benchmark hits nothing. Texts are judged whole. Columns
    of docs with these names are replaced.
    """
    out, first = docs.drop("bench_hit", "bench_words", "bench_matches"), True
    for rows in benchmark_blocks(benchmark, block_bytes):
        out, first = _matched(out if first else written(out), rows, window, shard_words, first), False
    if first:
        out = _matched(out, [], window, shard_words, True)
    # spans in order of their places; each adds what lies behind the end of those before it
    span = lambda m: F.struct(m["doc_pos"].alias("at"), (m["doc_pos"] + m["length"]).alias("to"))
    none = F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("end"))
    step = lambda s, x: F.struct((s["hit"] + F.greatest(F.lit(0).cast("bigint"), x["to"] - F.greatest(x["at"], s["end"]))).alias("hit"), F.greatest(s["end"], x["to"]).alias("end"))
    hit = F.aggregate(F.array_sort(F.transform("bench_matches", span)), none, step, lambda s: s["hit"])
    return out.withColumn("bench_hit", hit)


def is_contaminated(share: int = SHARE):
    return (F.col("bench_hit") > 0) & (F.col("bench_hit") * share >= F.col("bench_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with their own columns, of which less than a word in twenty stands in a benchmark window."""
    added = ["bench_words", "bench_hit", "bench_matches"]
    return filtered(docs, added, lambda d: contamination(d, benchmark), ~is_contaminated())
