"""Byte-level BPE of whole texts by the tokenizers library, and back.

A byte-level vocabulary is written in characters that stand for bytes. Texts are cut at spaces before a
character that is no white space, where no token of such a vocabulary reaches over, and each distinct
piece of a batch is encoded once: its matches of the vocabulary's pattern are mapped to those characters
and handed to the library as words, many at a time. Where a token lies follows from the lengths of the
tokens in bytes, so no offsets are asked of the library. Decoding looks every id up in the reversed byte
table; a character whose bytes lie in several tokens comes out once all of them are there.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import map_batches, replaced_batches, starts_of
from .subwords import BYTE_CHARS, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
KNOWN = 250_000  # pieces kept in one worker, at most (some 100 MB)
LONG = 64  # characters; longer pieces are not kept
TOGETHER = 1000  # words handed to the library as one text

#: A space before which a text can be cut.
CUT = re.compile(r" (?=\S)")
#: Texts with a space that is followed by white space, a control character or the end: they are cut by CUT; others at each space.
UNEVEN = r" (?:[\x00-\x20\x7f-\x{a0}\pZ]|\z)"
#: The characters of the alphabet by byte.
ALPHABET = np.array([BYTE_CHARS.get(b, b) for b in range(256)], dtype="<u2")
#: Below this code point all Unicode versions agree on letters and digits.
SETTLED = re.compile("[\x00-ɏ]*")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column; null as empty."""
    return pc.fill_null(batch.column(name).cast(pa.string()), "")


def split_evenly(texts: pa.Array, cut: Callable[[str], list[str]] = CUT.split, before: str = "") -> Iterable[tuple[np.ndarray, pa.ListArray]]:
    """The texts' pieces between cuts, for the texts that are cut at every space and for the others, which cut() splits:
    their numbers and lists. What is taken to stand before a text counts in telling which is which."""
    uneven = np.asarray(pc.match_substring_regex(pc.binary_join_element_wise(before, texts, ""), UNEVEN).to_numpy(zero_copy_only=False), dtype=bool)
    even = np.flatnonzero(~uneven)
    if len(even):
        yield even, pc.split_pattern(texts.take(pa.array(even)), " ")
    odd = np.flatnonzero(uneven)
    if len(odd):
        yield odd, pa.array([cut(t) for t in texts.take(pa.array(odd)).to_pylist()], pa.list_(pa.string()))


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs that begin at starts, one run after another."""
    return np.repeat(starts - starts_of(lengths)[:-1], lengths) + np.arange(int(lengths.sum()))


class ByteBpe:
    """Encodes texts to ids as the library would, without special tokens."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        self.pretokenize = whole.pre_tokenizer.pre_tokenize_str
        self.matches = regex.compile(public_tokenizers.PATTERN).findall
        self.words = Tokenizer(whole.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        byte_of = {int(c): b for b, c in enumerate(ALPHABET)}
        vocabulary = whole.get_vocab(with_added_tokens=False)
        self.pieces = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            if all(ord(c) in byte_of for c in token):
                self.pieces[i] = bytes(byte_of[ord(c)] for c in token)
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.known: dict[str, bytes] = {}

    def _words(self, pieces: list[str]) -> list[str]:
        """The pattern's matches in all pieces, one after another."""
        text = "".join(pieces)
        if not SETTLED.fullmatch(text):
            return [piece[a:z] for piece in pieces for _, (a, z) in self.pretokenize(piece)]
        if all(map(CUT.match, pieces)):  # then no match reaches from one piece into the next
            return self.matches(text)
        return [w for piece in pieces for w in self.matches(piece)]

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Of each of different pieces its ids, little-endian unsigned 32-bit."""
        plain = pieces if SETTLED.fullmatch("".join(pieces)) else [p for p in pieces if SETTLED.fullmatch(p)]
        found = dict(zip(plain, self._coded(plain)))
        other = [p for p in pieces if p not in found] if len(plain) < len(pieces) else []
        found.update(zip(other, self._coded(other)))
        return found

    def _coded(self, pieces: list[str]) -> list[bytes]:
        data = np.frombuffer("".join(pieces).encode(), np.uint8)
        byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each character begins
        words = self._words(pieces)
        ends = byte_at[np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
        ids, at = [np.empty(0, "<u4")], 0
        for some in np.split(ends, np.arange(TOGETHER, len(ends), TOGETHER)):
            own = ALPHABET[data[at : some[-1]]] if len(some) else ALPHABET[:0]
            line = np.insert(own, some[:-1] - at, ord(" ")).tobytes().decode("utf-16-le")
            ids.append(np.array(self.words.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4"))
            at = some[-1] if len(some) else at
        found = np.concatenate(ids).astype("<u4")
        reached = starts_of(self.lengths[found])
        upto = 4 * np.searchsorted(reached, byte_at[starts_of(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
        coded, places = found.tobytes(), upto.tolist()
        return [coded[a:z] for a, z in zip(places, places[1:])]

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """Of each of different pieces its ids; those of short ones are kept for other texts."""
        known = self.known
        new = [p for p in pieces if p not in known]
        learned = self.learn(new)
        found = [learned[p] if p in learned else known[p] for p in pieces]
        if len(known) + len(learned) > KNOWN:
            known.clear()
        known.update(islice(learned.items() if max(map(len, new), default=0) <= LONG else ((p, x) for p, x in learned.items() if len(p) <= LONG), KNOWN))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (and the last one's end)."""
        runs: list[np.ndarray] = [np.empty(0, "<u4")] * len(texts)
        for numbers, lists in split_evenly(texts):
            begin, words = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
            begin -= begin[0]
            is_head = np.zeros(len(words), bool)
            is_head[begin[:-1]] = True  # no list is empty: a text without a cut is one piece
            which, parts, base = np.empty(len(words), np.int64), [], 0
            for at, before in ((~is_head, " "), (is_head, "")):
                coded = words.filter(pa.array(at)).dictionary_encode()
                which[at] = coded.indices.to_numpy() + base
                own = self.ids_of([before + w for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()])
                parts += own
                base += len(own)
            ids = np.frombuffer(b"".join(parts), "<u4")
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            n = sizes[which]
            flat = ids[gathered(starts_of(sizes)[which], n)]
            upto = starts_of(n)[begin]
            for i, a, z in zip(numbers.tolist(), upto, upto[1:]):
                runs[i] = flat[a:z]
        return np.concatenate([np.empty(0, "<u4"), *runs]), starts_of(np.fromiter(map(len, runs), np.int64, len(runs)))

    def decode(self, ids: Iterable[int]) -> bytes:
        """The tokens' bytes; ids that the vocabulary lacks, and nulls, have none."""
        pieces, most = self.pieces, len(self.pieces)
        try:
            return b"".join(map(pieces.__getitem__, ids))
        except (IndexError, TypeError):
            return b"".join(pieces[i] for i in ids if i is not None and 0 <= i < most)


@lru_cache(maxsize=1)
def byte_bpe(path: str) -> ByteBpe:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteBpe(path)


def char_spans(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens of these lengths in bytes: the first character that each has a byte of, and the one after the last."""
    ends = np.cumsum(lengths)
    char = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1  # the character of each byte
    if not len(ends) or not len(char):
        return np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    return char[np.minimum(ends - lengths, len(char) - 1)], char[ends - 1] + 1


def listed(values: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values).cast(kind))


def encode(docs: DataFrame, vocabulary: str | None = None, spans: bool = False) -> DataFrame:
    """docs with bpe_ids: the ids of every whole text, without special tokens.

    With spans also byte_starts (where each token begins, in the text's UTF-8), char_starts and char_ends:
    a token that holds part of a character covers that whole character. A null or empty text has no ids;
    strings of special tokens are plain text. Columns of docs with these names are replaced.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)

    def compute(batch: pa.RecordBatch) -> list:
        coder, texts = byte_bpe(path), texts_of(batch)
        ids, begin = coder.encode(texts)
        out = [listed(ids, begin, pa.int32())]
        if spans:
            lengths = coder.lengths[ids]
            found = [char_spans(t.encode(), lengths[a:z]) for t, a, z in zip(texts.to_pylist(), begin, begin[1:])]
            ends = np.cumsum(lengths)
            base = np.repeat(starts_of(lengths)[begin[:-1]], np.diff(begin))
            none = np.empty(0, np.int64)
            out += [listed(x, begin, pa.int64()) for x in (ends - lengths - base, np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)]))]
        return out

    longs = [(n, "array<bigint>") for n in ("byte_starts", "char_starts", "char_ends")]
    return map_batches(docs, [("bpe_ids", "array<int>"), *(longs if spans else [])], compute)


def decode(rows: DataFrame, ids: str = "bpe_ids", vocabulary: str | None = None, pieces: bool = False) -> DataFrame:
    """rows with bpe_bytes, the bytes of the tokens in the column ids, and bpe_text, the same as text.

    Bytes of characters that are not there as a whole (a cut run of ids) are U+FFFD in bpe_text. With pieces
    also bpe_pieces: what each token adds to the text; a token that leaves a character open adds nothing, the
    one that completes it adds it. No ids (or null): no bytes. Columns of rows with these names are replaced.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)

    def compute(batch: pa.RecordBatch) -> list:
        coder = byte_bpe(path)
        tokens = [x or [] for x in batch.column(ids).to_pylist()]
        data = [coder.decode(t) for t in tokens]
        out = [pa.array(data, pa.binary()), pa.array([d.decode("utf-8", "replace") for d in data], pa.string())]
        if pieces:
            out.append(pa.array([added(coder.decode, t) for t in tokens], pa.list_(pa.string())))
        return out

    more = [("bpe_pieces", "array<string>")] if pieces else []
    return map_batches(rows, [("bpe_bytes", "binary"), ("bpe_text", "string"), *more], compute)


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs with bpe_ids, as encode() gives them, and bpe_bytes, as decode() gives them for those ids, without the text.

    Both steps share one task's worker and its vocabulary; between them are only the ids.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)

    def compute(batch: pa.RecordBatch) -> list:
        coder = byte_bpe(path)
        ids, begin = coder.encode(texts_of(batch))
        data = [coder.decode(ids[a:z].tolist()) for a, z in zip(begin, begin[1:])]
        return [listed(ids, begin, pa.int32()), pa.array(data, pa.binary())]

    return replaced_batches(docs, [("bpe_ids", "array<int>"), ("bpe_bytes", "binary")], compute, without=["text"])


def added(bytes_of: Callable[[list[int]], bytes], ids: list[int]) -> list[str]:
    """What each id adds to a text that is decoded from left to right."""
    import codecs

    stream = codecs.getincrementaldecoder("utf-8")("replace")
    return [stream.decode(bytes_of([i]), final=k == len(ids)) for k, i in enumerate(ids, 1)]
