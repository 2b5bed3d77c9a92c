"""SimHash near-duplicate groups by a Gray-order hierarchical index.

Fingerprints that differ in at most two bits are linked. Three parts of the 64 bits are cut so that
any two linked fingerprints agree on one whole part; rows meet where such a part agrees. A group that
is still large is cut again over its remaining bits, by the same rule, so no task holds more than
``GROUP`` fingerprints, or 4096 after the last cut. Inside a group the fingerprints lie in Gray order
under a tree of shared bit patterns, and a search drops a whole subtree once the differences
accumulated on the way down exceed the limit. Each group gives back a spanning forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blobs, checkpointed, map_batches, starts_of, written

BITS = 2  # linked fingerprints differ in so many bits at most
SHINGLE = 3  # words
GROUP = 1000  # fingerprints in one search group
LEVELS = 4  # cuts at most; a part then leaves 12 bits open, so 4096 fingerprints
FANOUT = 8  # children of an index node
HOT = 1000  # fingerprints whose rows are not shuffled
FRONTIER = 1_000_000  # pairs of query and node held at once
ALL = (1 << 64) - 1


def simhash(words: list[bytes], k: int = SHINGLE) -> int:
    """Majority bits over the XXH64 (seed 42) of all k-word shingles, repeats included; no words give 0."""
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < k else map(b" ".join, zip(*(words[i:] for i in range(k))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and the 64-bit fingerprint (as a signed long) of every whole text. A null text has no words."""

    return _with_fingerprint(docs, k).select("doc_id", "fp")


def _with_fingerprint(docs: DataFrame, k: int) -> DataFrame:
    def compute(batch: pa.RecordBatch) -> list:
        values = np.array([simhash(b.lower().split(), k) for b in blobs(batch)], dtype=np.uint64)
        return [pa.array(values.view(np.int64))]

    return map_batches(docs.select("doc_id", "text"), [("fp", "bigint")], compute)


def gray_rank(x: Column) -> Column:
    """The place of a code word in Gray order, shifted so that signed order is unsigned order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def parts(mask: int, n: int = BITS + 1) -> list[int]:
    """mask with each of n parts of the bits that it leaves open; codes within BITS agree on one of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [len(free) * i // n for i in range(n + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cut, cut[1:])]


def search_groups(codes: np.ndarray, group: np.ndarray, limit: int = BITS) -> np.ndarray:
    """For codes in Gray order within runs of equal group: the smallest index that each is connected to.

    The index: leaves are the codes, FANOUT of them share a node that holds the bits on which they all
    agree, and so on up to one root a run. A node's pattern leaves out the bits of its parent, so
    differences add up on the way down.
    """
    n = len(codes)
    labels = np.arange(n)
    edge = np.flatnonzero(np.diff(group)) + 1
    sizes = np.diff(np.concatenate([[0], edge, [n]]))
    low = high = codes
    counts, levels = sizes, []
    while True:  # from the leaves up; a level: where its nodes' children begin, the common ones and zeros
        per = -(-counts // FANOUT)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        inside = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        begin = np.repeat(first, per) + FANOUT * inside
        low, high = np.bitwise_and.reduceat(low, begin), np.bitwise_or.reduceat(high, begin)
        levels.append((begin, np.append(begin[1:], counts.sum()), low, ~(low ^ high)))
        counts = per
        if (counts == 1).all():
            break
    own_root = np.repeat(np.arange(len(sizes)), sizes)
    weight = np.cumsum(np.repeat(sizes, sizes))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + FRONTIER, "right")))
        q, node, seen = np.arange(at, to), own_root[at:to], np.zeros(to - at, dtype=np.uint64)
        acc = np.zeros(to - at, dtype=np.uint8)
        for begin, end, low, agree in reversed(levels):
            fresh = agree[node] & ~seen
            acc = acc + np.bitwise_count((codes[q] ^ low[node]) & fresh)
            keep = acc <= limit
            q, node, acc = q[keep], node[keep], acc[keep]
            seen = agree[node]
            width = end[node] - begin[node]
            child = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(begin[node], width)
            q, seen, acc, node = np.repeat(q, width), np.repeat(seen, width), np.repeat(acc, width), child
        ahead = node > q
        q, node, seen, acc = q[ahead], node[ahead], seen[ahead], acc[ahead]
        near = acc + np.bitwise_count((codes[q] ^ codes[node]) & ~seen) <= limit
        labels = _joined(labels, q[near], node[near])
        at = to
    return labels


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each points to the smallest member known) after the pairs (a, b) have been united."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        x, y = x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, key, fp) sorted by group and Gray order to edges; a group may reach over batches."""

    def edges(part: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        group = np.concatenate([[0], np.cumsum((part[1:] != part[:-1]) | (key[1:] != key[:-1]))]) if len(fp) else part
        if len(fp):
            size = np.bincount(group)
            more = size[group] > 1
            part, key, fp, group = part[more], key[more], fp[more], group[more]
        labels = search_groups(fp.view(np.uint64), group) if len(fp) else np.zeros(0, dtype=np.int64)
        own = np.arange(len(fp))
        moved = labels != own
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[labels[moved]])], names=["a", "b"])

    held: list[np.ndarray] = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for batch in batches:
        held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
        part, key, _ = held
        if not len(part):
            continue
        last = _run_start(part, key)
        if last:
            yield edges(*(h[:last] for h in held))
            held = [h[last:] for h in held]
    if len(held[0]):
        yield edges(*held)


def _run_start(part: np.ndarray, key: np.ndarray) -> int:
    """Where the last run of equal (part, key) begins."""
    other = np.flatnonzero((part != part[-1]) | (key != key[-1]))
    return int(other[-1]) + 1 if len(other) else 0


def link_forest(codes: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect just those distinct fingerprints (column fp) that chains of links connect."""
    masks, done = [0], None
    rows = codes.select(F.lit(0).alias("part"), "fp")
    for level in range(1, LEVELS + 1):
        masks = [m for mask in masks for m in parts(mask)]
        below = F.explode(F.sequence(F.col("part") * (BITS + 1), F.col("part") * (BITS + 1) + BITS))
        rows = rows.select("fp", below.alias("part"))
        mask = F.element_at(F.array(*(F.lit(_signed(m)) for m in masks)), F.col("part") + 1)
        rows = rows.select("part", F.col("fp").bitwiseAND(mask).alias("key"), "fp")
        large = None
        if level < LEVELS:
            large = rows.groupBy("part", "key").count().filter(F.col("count") > group).select("part", "key")
            large = checkpointed(large)
        whole = large is None or large.isEmpty()
        small = (rows if whole else rows.join(large, ["part", "key"], "left_anti")).withColumn("level", F.lit(level))
        done = small if done is None else done.unionByName(small)
        if whole:
            break
        rows = rows.join(large, ["part", "key"], "left_semi").select("part", "fp")
    done = done.withColumn("part", F.col("part") + F.col("level") * (BITS + 1) ** (LEVELS + 1))
    dealt = done.select("part", "key", "fp").repartition("part", "key").sortWithinPartitions("part", "key", gray_rank(F.col("fp")))
    return dealt.mapInArrow(_forest, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node that it is connected to, for all nodes of the edges (a, b); nothing is collected."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label"))
    labels = checkpointed(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        stepped = labels.join(near, "node").select("node", F.least("label", "least").alias("to"), F.col("label").alias("was"))
        target = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        moved = stepped.join(target, "to").select("node", F.least("to", "further").alias("label"), (F.least("to", "further") < F.col("was")).alias("moved"))
        moved = checkpointed(moved)
        changed = not moved.filter("moved").isEmpty()
        labels = moved.select("node", "label")
        if not changed:
            return labels


def _labelled(prints: DataFrame, first: Column, group: int) -> DataFrame:
    """Each fingerprint once, with the number and the least first of its rows and the label of its component, a fingerprint too."""
    codes = checkpointed(prints.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")))
    labels = components(link_forest(codes, group))
    return codes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest doc_id reachable over links; a row for each input row.

    Only doc_id and text are read, whatever other columns there are. Null and empty texts have no words,
    so fingerprint 0. Rows with a null doc_id take part and never name a component that has other ids.
    """
    prints = written(fingerprints(docs, k))
    joined = _labelled(prints, F.col("doc_id"), group)
    least = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    named = checkpointed(joined.join(least, "label").select("fp", "n", "component_id"))
    # fingerprints of most rows, HOT of them, do not go through the shuffle
    hot = F.broadcast(named.orderBy(F.desc("n"), "fp").limit(HOT).select("fp", "component_id"))
    rare = prints.join(hot.select("fp"), "fp", "left_anti").join(named.drop("n"), "fp")
    found = prints.join(hot, "fp").unionByName(rare)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, k: int = SHINGLE, group: int = GROUP) -> DataFrame:
    """One row of each near-duplicate group, with all its columns: the one whose doc_id is the smallest (null: the
    largest), then whose text has the smallest MD5.

    Groups are told apart by their fingerprints and not by ids, so rows that share an id, or have none, stay
    unless their texts are near-duplicates. Rows that repeat both id and text go, but for one.
    """
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    prints = written(_with_fingerprint(docs, k).select("doc_id", "fp", digest.alias("digest")))
    found = _labelled(prints, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"), group)
    first = found.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.digest").alias("__first"))
    # one key for the join and for what repeats, so rows are shuffled once
    key = lambda i, d: F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("none")), d)
    kept = first.select(key(F.col("__id"), F.col("__first")).alias("__key"))
    rows = docs.withColumn("__key", key(F.col("doc_id"), digest)).join(kept, "__key", "left_semi")
    return rows.dropDuplicates(["__key"]).drop("__key")
