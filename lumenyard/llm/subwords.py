"""Subword ids of whole texts by a public tokenizer, with the ids of words kept between texts.

The tokenizer's rules never join what white space separates, so a text's ids are those of its words one
after another. A word of plain letters followed by plain punctuation is looked up as two parts; any
other word is looked up whole. What is not known yet goes to the tokenizer, many at a time.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

VOCABULARY = "word_bpe_49k.json"
KNOWN = 400_000  # words kept in one worker, about
TOGETHER = 200  # texts whose new words are learned at once
#: ASCII and Latin-1 lower-case letters, as UTF-8, then punctuation without an apostrophe or a less-than sign.
LETTERS = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-;=-@\[-`{-~]*)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

#: Byte-level vocabularies write a byte that has no printable Latin-1 character as the next one from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = dict(zip([b for b in range(256) if b not in _PRINTED], range(256, 512)))


class Subwords:
    """Encodes UTF-8 texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def _whole(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, runs: list[bytes]) -> list[bytes]:
        """Of letter runs, which the tokenizer takes as one word each: straight from its model."""
        tokenize, ids, ends = self.tokenizer.model.tokenize, [], [0]
        for run in runs:
            word = run.decode("latin-1")
            ids += [x.id for x in tokenize(word if word.isascii() else word.translate(BYTE_CHARS))]
            ends.append(4 * len(ids))
        data = np.array(ids, dtype="<u4").tobytes()
        return [data[a:z] for a, z in zip(ends, ends[1:])]

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Of each word its ids; none of them is kept, but for punctuation."""
        parts, match = self.parts, LETTERS.fullmatch
        found = [match(w) for w in words]
        split = [m.groups() for m in found if m]
        runs = self._runs([run for run, _ in split])
        if new := list({tail for _, tail in split}.difference(parts)):
            if len(parts) > KNOWN:
                parts.clear()
                new = list({tail for _, tail in split})
            parts.update(zip(new, self._whole(new)))
        plain = iter([r + parts[tail] for r, (_, tail) in zip(runs, split)])
        odd = iter(self._whole([w for w, m in zip(words, found) if not m]))
        return [next(plain) if m else next(odd) for m in found]

    def encode_words(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of texts that are given as lower-case (A-Z) words, split at ASCII white space."""
        out: list[bytes] = []
        for at in range(0, len(texts), TOGETHER):
            some = texts[at : at + TOGETHER]
            if len(self.words) > KNOWN:
                self.words = {}
            if missing := list(set().union(*some).difference(self.words)):
                self.words.update(zip(missing, self.ids_of(missing)))
            get = self.words.__getitem__
            out += [b"".join(map(get, words)) for words in some]
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Of each text its ids; A-Z are lower-cased first, as the tokenizer does itself."""
        return self.encode_words([t.lower().split() for t in texts])


@lru_cache(maxsize=1)
def subwords(path: str) -> Subwords:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Subwords(path)
