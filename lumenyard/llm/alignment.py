"""How the tokens of two tokenizers lie over each other in whole texts, and how often ids meet in a corpus.

Both tokenizers end a token before every space that follows a character other than a space and is followed
by no white space; texts are cut there, and each distinct piece of a batch is tokenized and aligned once.
The ends of both sides' tokens together cut the pieces into elementary intervals: each is the overlap of
one token of either side, and an end that both sides have closes a group.

Links are counted over the corpus by pairs of ids. The pairs that occur most often, as many as fit a table
of bounded size, are looked up where the texts are; links of all other pairs are joined with their counts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import LONG, ByteBpe, byte_bpe, gathered, listed, split_evenly, texts_of
from .shared import map_batches, replaced_batches, starts_of, written
from .subwords import vocabulary_path

FIRST = "byte_bpe_50k.json"
SECOND = "piece_bpe_32k.model"
HEAD = 1 << 18  # pairs in the table that every task gets
KNOWN = 400_000  # pieces kept in one worker, about
#: A space before which both tokenizers end a token.
CUT = re.compile(r"(?<! ) (?=\S)")


def cut(text: str) -> list[str]:
    """A text that a space is put before, between cuts; the space that each piece begins with is left out."""
    head, *rest = CUT.split(" " + text)
    return [head[1:], *rest] if head else rest


class Intervals(NamedTuple):
    """Elementary intervals in order: the token of either side that each lies in, and whether a group ends with it."""

    first: np.ndarray
    second: np.ndarray
    closes: np.ndarray


def intervals(first_ends: np.ndarray, second_ends: np.ndarray) -> Intervals:
    """Of two ascending runs of token ends that have the same last end."""
    cuts = np.union1d(first_ends, second_ends)
    first, second = np.searchsorted(first_ends, cuts), np.searchsorted(second_ends, cuts)
    return Intervals(first, second, (first_ends[first] == cuts) & (second_ends[second] == cuts))


class Pieces:
    """The second tokenizer: sentencepiece ids and their bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)

    def encode(self, words: list[str]) -> list[list[int]]:
        return self.model.encode(words, num_threads=1) if words else []


class Aligned(NamedTuple):
    """A piece (space and word): tokens of either side, groups, the groups written out, and the pairs of its links."""

    n_first: int
    n_second: int
    n_groups: int
    n_products: int
    groups: str
    pairs: bytes  # first id * width + second id of each link, as int64


def aligned(words: list[str], coder: ByteBpe, pieces: Pieces) -> list[Aligned | None]:
    """Of each word, with a space before it; None where the second tokenizer does not give back these bytes."""
    width = len(pieces.bytes)
    second = pieces.encode(words)
    fits = [b"".join(map(pieces.bytes.__getitem__, ids)) == b" " + w.encode() for w, ids in zip(words, second)]
    good = [" " + w for w, ok in zip(words, fits) if ok]
    learned = coder.learn(good)
    a = [learned[w] for w in good]
    sizes_a = np.fromiter(map(len, a), np.int64, len(a)) // 4
    ids_a = np.frombuffer(b"".join(a), "<u4").astype(np.int64)
    b = [ids for ids, ok in zip(second, fits) if ok]
    sizes_b = np.fromiter(map(len, b), np.int64, len(b))
    ids_b = np.fromiter((i for ids in b for i in ids), np.int64, int(sizes_b.sum()))
    ends_a, ends_b = np.cumsum(coder.lengths[ids_a]), np.cumsum(pieces.lengths[ids_b])
    found = intervals(ends_a, ends_b)
    pairs = (ids_a[found.first] * width + ids_b[found.second]).tobytes()
    # a group's tokens: those of either side up to the interval that closes it
    last = np.flatnonzero(found.closes)
    upto_a, upto_b = found.first[last] + 1, found.second[last] + 1
    n_a, n_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
    group_end = starts_of(sizes_a)[1:]  # tokens of the first side up to the end of each word; words end groups
    groups_upto = np.searchsorted(upto_a, group_end, "right")
    links_upto = np.append(last + 1, 0)[groups_upto - 1] if len(last) else np.zeros(0, np.int64)
    products = starts_of(n_a * n_b)[groups_upto]
    written_out = _written(ids_a, ids_b, n_a, n_b, upto_a, upto_b)
    places = starts_of(n_a + n_b)[groups_upto].tolist()
    rows = iter(zip(sizes_a.tolist(), sizes_b.tolist(), groups_upto.tolist(), links_upto.tolist(), products.tolist(), places))
    out: list[Aligned | None] = []
    groups = links = product = place = 0
    for ok in fits:
        if not ok:
            out.append(None)
            continue
        before = groups, links, product, place
        x, y, groups, links, product, place = next(rows)
        text = "".join(written_out[before[3] : place])[:-1]
        out.append(Aligned(x, y, groups - before[0], product - before[2], text, pairs[8 * before[1] : 8 * links]))
    return out


def _written(ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> list[str]:
    """The ids in the order of groups, first side before second, each with the sign that follows it."""
    out = np.empty(len(ids_a) + len(ids_b), dtype=object)
    group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    for ids, group, upto, other, mark in ((ids_a, group_a, upto_a, np.append(0, upto_b)[group_a], "|"), (ids_b, group_b, upto_b, upto_a[group_b], ";")):
        text = np.array([f"{i}," for i in ids.tolist()], dtype=object)
        text[upto - 1] = [f"{i}{mark}" for i in ids[upto - 1].tolist()]
        out[np.arange(len(ids)) + other] = text
    return out.tolist()


class Aligner:
    def __init__(self, first: str, second: str):
        self.coder, self.pieces = byte_bpe(first), Pieces(second)
        self.known: dict[str, Aligned | None] = {}

    def of(self, words: list[str]) -> list[Aligned | None]:
        """Of different words; short ones are kept for other texts."""
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        new = [w for w in words if w not in known]
        learned = dict(zip(new, aligned(new, self.coder, self.pieces)))
        known.update((w, x) for w, x in learned.items() if len(w) <= LONG)
        return [learned[w] if w in learned else known[w] for w in words]


@lru_cache(maxsize=1)
def aligner(first: str, second: str) -> Aligner:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Aligner(first, second)


FIELDS = [("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_links", "bigint"), ("n_products", "bigint")]
PAIRS = [("link_a", "array<int>"), ("link_b", "array<int>"), ("link_n", "array<int>")]


def align(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """docs with the tokens of each whole text in both tokenizers and how they overlap.

    n_a, n_b, n_groups: tokens of either side and groups; n_links: pairs of overlapping tokens; n_products:
    pairs of tokens that share a group, overlapping or not; groups: written as a1,a2|b1;a3|b2,b3; link_a, link_b, link_n: the different pairs of ids among the links and how
    often each is linked. The text is taken with a space before it. Null and empty texts, and those which
    either tokenizer changes, have no tokens: zeros, an empty string and empty lists. Other columns stay;
    columns with these names are replaced.
    """
    paths = (first or vocabulary_path(FIRST), second or vocabulary_path(SECOND))

    def compute(batch: pa.RecordBatch) -> list:
        return _compute(texts_of(batch), aligner(*paths))

    return map_batches(docs, [*FIELDS, ("groups", "string"), *PAIRS], compute)


def _compute(texts: pa.Array, tools: Aligner) -> list:
    """The columns of align() for a batch."""
    n_docs, width = len(texts), len(tools.pieces.bytes)
    counts = np.zeros((n_docs, len(FIELDS)), np.int64)
    groups = [""] * n_docs
    doc_keys: list[np.ndarray] = []
    for numbers, lists in split_evenly(texts, cut, before=" "):
        begin = lists.offsets.to_numpy().astype(np.int64)
        begin -= begin[0]
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        found = tools.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        bad = np.array([x is None for x in found], bool)
        held = [x or Aligned(0, 0, 0, 0, "", b"") for x in found]
        pairs = np.frombuffer(b"".join(x.pairs for x in held), np.int64)
        links = np.fromiter((len(x.pairs) // 8 for x in held), np.int64, len(held))
        per_word = np.stack([np.array([x[k] for x in held], np.int64) for k in range(3)] + [links, np.array([x.n_products for x in held], np.int64)], axis=1)
        fails = starts_of(bad[which].astype(np.int64))
        sums = np.concatenate([np.zeros((1, len(FIELDS)), np.int64), np.cumsum(per_word[which], axis=0)])
        texts_out = np.array([x.groups for x in held], dtype=object)[which].tolist()
        lengths = np.diff(begin)
        # the texts whose bytes both sides give back
        good = (np.diff(fails[begin]) == 0) & np.asarray([bool(t) for t in texts.take(pa.array(numbers)).to_pylist()])
        counts[numbers[good]] = (sums[begin[1:]] - sums[begin[:-1]])[good]
        for i, a, z, ok in zip(numbers.tolist(), begin.tolist(), begin[1:].tolist(), good.tolist()):
            if ok:
                groups[i] = ";".join(texts_out[a:z])
        of_word = np.repeat(numbers, lengths)[np.repeat(good, lengths)]
        word = which[np.repeat(good, lengths)]
        n = links[word]
        doc_keys.append(np.repeat(of_word, n) * (1 << 40) + pairs[gathered(starts_of(links)[word], n)])
    keys, times = np.unique(np.concatenate([np.empty(0, np.int64), *doc_keys]), return_counts=True)
    begin = np.searchsorted(keys >> 40, np.arange(n_docs + 1))
    pair = keys & ((1 << 40) - 1)
    return [*(pa.array(counts[:, k]) for k in range(len(FIELDS))), pa.array(groups, pa.string()), *(listed(x, begin, pa.int32()) for x in (pair // width, pair % width, times))]


def counted(rows: DataFrame) -> DataFrame:
    """a, b, n: how many links of the corpus hold the two ids linked; best: no id has more links with b."""
    link = F.explode(F.arrays_zip("link_a", "link_b", "link_n"))
    pairs = rows.select(link.alias("x")).groupBy(F.col("x.link_a").alias("a"), F.col("x.link_b").alias("b")).agg(F.sum("x.link_n").alias("n"))
    pairs = written(pairs)
    # one row for each id of the second vocabulary at most
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def head_of(pairs: DataFrame, most: int = HEAD) -> DataFrame:
    """The pairs with at least as many links (a power of two) as leaves at most so many pairs."""
    sizes = dict(pairs.groupBy(F.length(F.bin("n")).alias("bits")).count().collect())  # 64 rows at most
    kept, bits = 0, 64
    while bits > 1 and kept + sizes.get(bits - 1, 0) <= most:
        bits -= 1
        kept += sizes.get(bits, 0)
    return pairs.filter(F.col("n") >= (1 << (bits - 1)))


def scored(rows: DataFrame, width: int | None = None, head: int = HEAD) -> DataFrame:
    """rows of align() with n_best (links whose pair no other id of the first side has more often with the
    second id) and count_sum (over links, how many links of the corpus hold their pair), over all rows; the
    link lists are left out.

    width: ids of the second vocabulary, at least. Repeated rows count each. Columns named n_best, count_sum,
    __row and __rest are replaced.
    """
    width = width or len(aligner(vocabulary_path(FIRST), vocabulary_path(SECOND)).pieces.bytes)
    rows = written(rows.drop("n_best", "count_sum", "__row", "__rest").withColumn("__row", F.monotonically_increasing_id()))
    pairs = counted(rows)
    key = F.col("a").cast("bigint") * width + F.col("b")
    table = head_of(pairs, head).select(key.alias("key"), "n", "best").toArrow().sort_by("key")
    shared = rows.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("key", "n", "best")))
    own = written(replaced_batches(rows, _FOUND, _look_up(shared, width), without=[n for n, _ in PAIRS]))
    rest = own.select("__row", F.explode("__rest").alias("x")).select("__row", "x.*").join(pairs, ["a", "b"])
    more = rest.groupBy("__row").agg(F.sum(F.col("times") * F.col("best").cast("int")).alias("__best"), F.sum(F.col("times") * F.col("n")).alias("__sum"))
    plus = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    kept = [c for c in own.columns if c not in ("n_best", "count_sum", "__row", "__rest")]
    return own.join(more, "__row", "left").select(*kept, plus("n_best", "__best"), plus("count_sum", "__sum"))


_FOUND = [("n_best", "bigint"), ("count_sum", "bigint"), ("__rest", "array<struct<a:int,b:int,times:int>>")]


def _look_up(shared, width: int) -> Callable[[pa.RecordBatch], list]:
    """What the table of frequent pairs gives for the links of a batch, and the links that it lacks."""

    def flat(column: pa.ListArray) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    def compute(batch: pa.RecordBatch) -> list:
        keys, counts, best = shared.value
        a, b, times = (flat(batch.column(n)) for n, _ in PAIRS)
        begin = starts_of(np.asarray(batch.column("link_a").value_lengths().to_numpy(zero_copy_only=False), np.int64))
        at = np.minimum(np.searchsorted(keys, a * width + b), max(len(keys) - 1, 0))
        hit = keys[at] == a * width + b if len(keys) else np.zeros(len(a), bool)
        at = at[hit]
        sums = [np.zeros(len(a), np.int64) for _ in range(2)]
        sums[0][hit] = times[hit] * best[at]
        sums[1][hit] = times[hit] * counts[at]
        over = [np.diff(starts_of(x)[begin]) for x in sums]
        lacking = pa.StructArray.from_arrays([pa.array(x[~hit].astype(np.int32)) for x in (a, b, times)], names=["a", "b", "times"])
        rest = pa.ListArray.from_arrays(pa.array(starts_of((~hit).astype(np.int64))[begin].astype(np.int32)), lacking)
        return [*map(pa.array, over), rest]

    return compute
