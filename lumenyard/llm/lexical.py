"""Ranked lexical search over an index of two levels.

Every task turns its documents into blocks: a block has, for each of its terms, the documents that hold it,
how often, and a byte that is the term's exact impact in the document rounded up to a step. A search adds
up bytes, which bounds the scores of a block's documents from above and, less a step for each matched term,
from below; documents whose upper bound reaches the k-th best lower bound found so far are scored exactly in
integers. Each task hands on k documents for each item, and the best k of those are the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import blobs, slices, small_batches, starts_of, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SCALE = 1_000_000_000
STEP = 3922  # of an impact without its term's weight, which is below 1,000,000, so a byte holds it
TOP = 10
BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1_000_000  # a block is closed when it has so many
BLOCKS_AT_ONCE = 1  # rows of the index in one batch, and in one row group of its files
ITEM_TERMS = 1_000_000  # terms of items that are searched for in one pass
INDEX = (
    "doc_ids array<bigint>, norms array<bigint>, lengths array<bigint>, terms array<binary>, starts array<bigint>, "
    "docs binary, tfs binary, impacts binary"  # of each posting: a document's place and count, 32 bits each, and a byte
)


class Corpus(NamedTuple):
    """Documents with at least one term, and all their terms with repeats."""

    documents: int
    terms: int


def n_terms(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TERM)), F.lit(0)).cast("bigint")


def lowered(text: str = "text") -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus_of(docs: DataFrame) -> Corpus:
    n = docs.select(n_terms().alias("n"))
    return Corpus(*n.agg(F.coalesce(F.count_if(F.col("n") > 0), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first())


def norm(length: int, corpus: Corpus) -> int:
    """What a document of so many terms adds below the fraction."""
    return 100 - 90 + 90 * length * corpus.documents // corpus.terms


def exact(tfs: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """A term's impact without its weight."""
    return SCALE * tfs // (1000 * tfs + 8 * norms)


class _Block:
    """Documents that are gathered until there are enough of them."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.number: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        counts = Counter(words)
        number = self.number
        for term in counts:
            if term not in number:
                number[term] = len(number)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.terms.append(np.fromiter(map(number.__getitem__, counts), np.int64, len(counts)))
        self.tfs.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.postings += len(counts)

    def row(self, corpus: Corpus) -> dict:
        names = sorted(self.number)
        rank = np.empty(len(names), np.int64)
        rank[np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
        term = rank[np.concatenate([np.empty(0, np.int64), *self.terms])]
        doc = np.repeat(np.arange(len(self.ids)), np.fromiter(map(len, self.terms), np.int64, len(self.ids)))
        order = np.argsort(term, kind="stable")  # documents of a term ascend
        tfs = np.concatenate([np.empty(0, np.int64), *self.tfs])[order]
        norms = np.array([norm(n, corpus) for n in self.lengths], np.int64)
        impacts = -(-exact(tfs, norms[doc[order]]) // STEP)
        starts = starts_of(np.bincount(term, minlength=len(names)))
        return {
            "doc_ids": self.ids, "norms": norms, "lengths": self.lengths, "terms": names, "starts": starts,
            "docs": doc[order].astype("<i4").tobytes(), "tfs": tfs.astype("<i4").tobytes(), "impacts": impacts.astype(np.uint8).tobytes(),
        }


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> tuple[DataFrame, Corpus]:
    """Blocks of the documents that have a term, one a row, and the corpus they are of.

    doc_id is an integer and may be null. Null texts and texts without a term are left out; repeated rows are
    documents each; other columns are ignored. The blocks are written to the shared folder, each as a row group:
    by itself, Parquet's writer first looks at its size after 100 rows, and would hold so many blocks of a task.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    corpus = corpus_of(rows)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(INDEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in slices(batches):
            for own, data in zip(batch.column("doc_id").to_pylist(), blobs(batch)):
                if words := TERM_BYTES.findall(data.lower()):
                    block.add(own, words)
                if block.postings >= block_postings or len(block.ids) >= block_docs:
                    yield pa.RecordBatch.from_pylist([block.row(corpus)], schema=schema)
                    block = _Block()
        if block.ids:
            yield pa.RecordBatch.from_pylist([block.row(corpus)], schema=schema)

    with small_batches(docs.sparkSession):
        return written(rows.mapInArrow(run, INDEX), **{"parquet.block.row.count.limit": BLOCKS_AT_ONCE}), corpus


def weights(blocks: DataFrame, corpus: Corpus, terms: DataFrame) -> DataFrame:
    """term (binary) and weight of those of terms (a column term, each once) that a document holds."""
    held = F.explode(F.arrays_zip("terms", F.transform("terms", lambda t, i: F.get("starts", i + 1) - F.get("starts", i)).alias("df")))
    rows = blocks.select(held.alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    df = rows.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    ratio = F.lit(2.0 * corpus.documents + 2) / (2.0 * F.col("df") + 1)
    return df.select("term", F.floor(1000 * F.log(ratio)).cast("bigint").alias("weight"))


class _Items(NamedTuple):
    """Items of one pass: their numbers, and of each its terms (places in terms) with weights."""

    numbers: list[int]
    place: dict[bytes, int]
    terms: list[np.ndarray]
    weights: np.ndarray  # by place


def _passes(wanted: DataFrame, most: int) -> Iterator[_Items]:
    """Items (__item, term, weight) dealt to passes of about so many terms by a hash of their numbers."""
    n = -(-wanted.count() // most)
    for k in range(n):
        own = wanted if n == 1 else wanted.filter(F.pmod(F.xxhash64("__item"), F.lit(n)) == k)
        found = own.toArrow()
        place: dict[bytes, int] = {}
        held: dict[int, list[int]] = {}
        value: list[int] = []
        for item, term, weight in zip(*(found[c].to_pylist() for c in ("__item", "term", "weight"))):
            if term not in place:
                place[term] = len(value)
                value.append(weight)
            held.setdefault(item, []).append(place[term])
        if held:
            yield _Items(list(held), place, [np.array(x) for x in held.values()], np.array(value, np.int64))


class _Best:
    """The best documents of one item so far: scores descend, then ids ascend, a null id last."""

    def __init__(self, top: int) -> None:
        self.top, self.rows, self.least = top, [], 1

    def add(self, scores: list[int], ids: list[int | None]) -> None:
        rows = self.rows + [(-s, i is None, i or 0) for s, i in zip(scores, ids) if s > 0]
        self.rows = sorted(rows)[: self.top]
        if len(self.rows) == self.top:
            self.least = max(self.least, -self.rows[-1][0])


def _search_block(block: dict, items: _Items, best: list[_Best]) -> None:
    norms, starts, ids = block["norms"], block["starts"], block["doc_ids"]
    docs, tfs, impacts = (np.frombuffer(block[n], kind) for n, kind in (("docs", "<i4"), ("tfs", "<i4"), ("impacts", np.uint8)))
    # of the items' terms: their places in the block
    own = np.full(len(items.weights), -1, np.int64)
    get = items.place.get
    for i, term in enumerate(block["terms"]):
        if (p := get(term)) is not None:
            own[p] = i
    for terms, found in zip(items.terms, best):
        here = terms[own[terms] >= 0]
        spans = [(int(starts[i]), int(starts[i + 1]), int(w)) for i, w in zip(own[here], items.weights[here])]
        upper, matched = np.zeros(len(norms), np.int64), np.zeros(len(norms), np.int64)
        for a, z, w in spans:
            upper[docs[a:z]] += w * impacts[a:z].astype(np.int64)
            matched[docs[a:z]] += w
        # an impact is above (byte - 1) * STEP
        lower = STEP * (upper - matched) + matched
        least = found.least
        if len(lower) >= found.top:
            least = max(least, int(np.partition(lower, -found.top)[-found.top]))
        maybe = np.flatnonzero(STEP * upper >= least)
        if len(maybe):
            scores = np.zeros(len(maybe), np.int64)
            for a, z, w in spans:
                at = np.searchsorted(docs[a:z], maybe)
                at[at == z - a] = 0
                hit = docs[a:z][at] == maybe
                scores[hit] += w * exact(tfs[a:z][at[hit]].astype(np.int64), norms[maybe[hit]])
            found.add(scores.tolist(), [ids[i] for i in maybe.tolist()])


def _searched(blocks: DataFrame, items: _Items, top: int) -> DataFrame:
    """__item, doc_id, score: of each task the best documents for each item."""
    shared = blocks.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = [_Best(top) for _ in items.numbers]
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                block = {n: row.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("norms", "starts")}
                block |= {n: row.column(n)[0].as_py() for n in ("terms", "docs", "tfs", "impacts", "doc_ids")}
                _search_block(block, items, best)
        rows = [(number, None if none else own, -score) for number, found in zip(items.numbers, best) for score, none, own in found.rows]
        for at in range(0, len(rows), 10_000):
            columns = list(zip(*rows[at : at + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["__item", "doc_id", "score"])

    return blocks.select("doc_ids", "norms", "terms", "starts", "docs", "tfs", "impacts").mapInArrow(run, "__item bigint, doc_id bigint, score bigint")


def search(blocks: DataFrame, corpus: Corpus, items: DataFrame, top: int = TOP, text: str = "text", item_terms: int = ITEM_TERMS) -> DataFrame:
    """The columns of items but its text, with rank, doc_id and score: the best documents of each row of items.

    A score is the sum of the impacts of the item's different terms, and above 0. Equal scores are ranked by
    ascending doc_id, a null one last. Each row of items is searched for by itself, repeated or not; one
    without a term (or a null text) finds nothing. Columns of items named rank, doc_id, score or __item are
    replaced.
    """
    spark = blocks.sparkSession
    items = written(items.drop("rank", "doc_id", "score", "__item").withColumn("__item", F.monotonically_increasing_id()))
    terms = F.array_distinct(F.regexp_extract_all(lowered(text), F.lit(TERM), F.lit(0)))
    wanted = items.select("__item", F.explode(terms).alias("term")).withColumn("term", F.col("term").cast("binary"))
    wanted = written(wanted.join(weights(blocks, corpus, wanted.select("term").distinct()), "term"))
    found: DataFrame | None = None
    for some in _passes(wanted, item_terms):
        with small_batches(spark, BLOCKS_AT_ONCE):
            rows = written(_searched(blocks, some, top))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], "__item bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("__item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return items.drop(text).join(ranked, "__item").drop("__item")
