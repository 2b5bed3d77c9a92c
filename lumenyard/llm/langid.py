"""Language identification by cross-parsing against suffix automata of labelled text.

A text is parsed greedily into the longest phrases that a language's reference text contains. The cross
entropy is phrases times the bits that point into the reference, divided by the text's length; the
language with the least wins. The automata are built on the workers from reference texts of bounded
size, as tables that also hold where the next phrase begins, so many pieces of text are parsed in step.
A reference is made of many short passages of different texts, so a passage that is copied all over the
corpus makes up little of it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import filtered, replaced_batches, starts_of, written

PASSAGE = 160  # code points that a drawn document gives to its language's reference text, at most
SAMPLE_DOCS = 150  # labelled documents that are drawn for each language, about
TOGETHER_LANGUAGES = 32  # in one pass over the texts
PIECE = 2048  # bytes that are parsed in one run; a longer text has several
TOGETHER = 4096  # pieces parsed in step
SHARPNESS = 6.0  # of the score
CONFIDENT = 0.5  # score from which a document counts as written in a known language
#: Letters and all that is not ASCII stay, the rest becomes a space.
TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal(text: str) -> bytes:
    """Lower case, single spaces for all ASCII but letters, a space at either end."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(TABLE).split()) + b" "


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """The transitions of the least automaton of all substrings; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """Counts phrases against several references at once."""

    def __init__(self, references: tuple[tuple[str, bytes], ...]):
        self.langs = [lang for lang, _ in references]
        self.bits = np.array([np.log2(len(r) + 2) for _, r in references])
        used = sorted({b for _, r in references for b in r})
        self.code = np.full(256, len(used), dtype=np.int64)  # all unseen bytes share a class that never matches
        self.code[used] = np.arange(len(used))
        width = len(used) + 1
        self.tables = []
        for _, reference in references:
            states = suffix_automaton(reference)
            dead = len(states)  # after a byte that the reference lacks: it is a phrase of its own
            if (dead + 1) * 2 * width >= 1 << 31:
                raise ValueError("a reference text is too long for 32-bit states")
            own = np.full((dead + 1, width), -1, dtype=np.int32)
            for s, to in enumerate(states):
                own[s, self.code[list(to)]] = list(to.values())
            # where no longer match exists, a phrase ends and the next begins with this byte; low bit: it did
            begin = np.where(own[0] >= 0, own[0], dead)
            none = own < 0
            none[0] = False
            own[0] = begin
            own *= 2 * width
            np.copyto(own, begin * 2 * width + 1, where=none, casting="same_kind")
            self.tables.append(own.reshape(-1))

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """For each text and language, the phrases; every piece of a text begins a new one."""
        n = np.array([len(t) for t in texts], dtype=np.int64)
        flat = self.code[np.frombuffer(b"".join(texts), dtype=np.uint8)].astype(np.int32)
        pieces = -(-n // PIECE)
        own = np.repeat(np.arange(len(texts)), pieces)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts_of(n)[:-1][own] + within * PIECE
        size = np.minimum(begin + PIECE, starts_of(n)[1:][own]) - begin
        by = np.argsort(-size, kind="stable")
        own, begin, size = own[by], begin[by], size[by]
        out = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        for a in range(0, len(by), TOGETHER):
            at, long = begin[a : a + TOGETHER], size[a : a + TOGETHER]
            live = np.searchsorted(-long, -np.arange(int(long[0])), "left").tolist()  # pieces that reach a step
            begun = np.ones((len(self.langs), len(at)), dtype=np.int32)
            state = np.zeros((len(self.langs), len(at)), dtype=np.int32)
            for step, k in enumerate(live):
                row = flat[at[:k] + step]
                for table, s, count in zip(self.tables, state, begun):
                    to = table.take((s[:k] >> 1) + row)
                    flag = to & 1
                    count[:k] += flag
                    np.subtract(to, flag, out=s[:k])
            np.add.at(out, own[a : a + TOGETHER], begun.T)
        return out


@lru_cache(maxsize=1)
def parser(references: tuple[tuple[str, bytes], ...]) -> Parser:
    return Parser(references)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def learn(labelled: DataFrame, passage: int = PASSAGE, sample_docs: int = SAMPLE_DOCS) -> tuple[tuple[str, bytes], ...]:
    """Reference texts from columns text and lang; rows with a null among them teach nothing.

    Of each language about sample_docs different texts are drawn by a hash of the text, and from each of
    them one passage at a place that the hash gives; equal texts count once.
    """
    rows = labelled.select("text", "lang").dropna()
    sizes = rows.groupBy("lang").count().collect()  # one row a language
    if not sizes:
        return ()
    code = F.xxhash64("text")
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample_docs / r["count"]))))
    drawn = rows.filter(F.pmod(code, F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.try_element_at(share, F.col("lang")))
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - passage + 1)).cast("int") + 1
    drawn = drawn.select("lang", code.alias("code"), F.substring(F.col("text"), place, F.lit(passage)).alias("passage")).distinct()
    held: dict[str, list[bytes]] = {}
    for row in sorted(drawn.collect(), key=lambda r: (r["lang"], r["code"], r["passage"])):
        if len(text := normal(row["passage"])) > 2:
            held.setdefault(row["lang"], []).append(text)
    return tuple(sorted((lang, b"".join(texts)) for lang, texts in held.items()))


def identify(docs: DataFrame, references: tuple[tuple[str, bytes], ...], together: int = TOGETHER_LANGUAGES) -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1) and lang_entropy (bits a byte) for every whole text.

    A text that is null or has no letter, and every text where no language was learned, is ``und`` with
    score 0. Equal entropies: the language that sorts first. Many languages take several passes, each
    over so many of them that a worker can hold their automata. Columns of docs with these names are replaced.
    """
    fields = [("lang_pred", "string"), ("lang_entropy", "double"), ("__mass", "double")]
    out = docs.drop(*(n for n, _ in fields), "lang_score")
    for at in range(0, max(1, len(references)), together):
        shared = docs.sparkSession.sparkContext.broadcast(references[at : at + together])

        def compute(batch: pa.RecordBatch, shared=shared, first=at == 0) -> list:
            texts = batch.column("text").to_pylist()
            read = [i for i, t in enumerate(texts) if has_letter(t)] if shared.value else []
            if first:
                lang, bits, mass = ["und"] * len(texts), np.full(len(texts), np.nan), np.zeros(len(texts))
            else:
                lang = batch.column("lang_pred").to_pylist()
                bits, mass = (np.array(batch.column(c).to_pandas(), dtype=float) for c in ("lang_entropy", "__mass"))
            if read:
                own = parser(shared.value)
                clean = [normal(texts[i]) for i in read]
                size = np.array([len(c) for c in clean])[:, None]
                entropy = own.phrases(clean) * own.bits / size
                mass[read] += np.exp(-SHARPNESS * entropy).sum(axis=1)
                for i, k, least in zip(read, entropy.argmin(axis=1), entropy.min(axis=1)):
                    if not bits[i] <= least:
                        lang[i], bits[i] = own.langs[k], least
            return [pa.array(lang, pa.string()), pa.array(bits, from_pandas=True), pa.array(mass)]

        out = replaced_batches(written(out) if at else out, fields, compute)
    score = F.coalesce(F.exp(-SHARPNESS * F.col("lang_entropy")) / F.nullif(F.col("__mass"), F.lit(0.0)), F.lit(0.0))
    return out.withColumn("lang_score", score).drop("__mass")


def in_known_language(docs: DataFrame, training: Column, least: float = CONFIDENT) -> DataFrame:
    """The documents, with their own columns, that are likelier written in one of the learned languages than in all
    the others together; so null texts, those without letters, and those that every language explains alike go."""
    references = learn(docs.filter(training))
    added = ["lang_pred", "lang_score", "lang_entropy", "__mass"]
    return filtered(docs, added, lambda d: identify(d, references), (F.col("lang_pred") != "und") & (F.col("lang_score") >= least))
