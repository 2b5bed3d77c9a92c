"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, and where none lies below it
the smallest hash, so only a text without words has an empty one. Both are properties of the set of
hashes: the sketch of several texts together is found from their sketches (merged), and what two sketches
share tells how much of either text lies in the other, however unequal they are. A hash that was kept for
being the smallest need not be in the sketch of a text that holds all of this one, so it counts for
resemblance only: how much of a text without a hash below the fraction lies in another is not known (null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenyard.functions.text import let
from lumenyard.llm.shared import written

SHINGLE = 5  # words
FRACTION = 4  # one hash in so many is kept
RANGE_ROWS = 4000  # documents in one range of ids, about
RANGES = 1 << 17  # at most, 500 million documents; beyond it ranges hold more rows and spill while they are sorted
CUTOFF = (1 << 64) // FRACTION - (1 << 63)


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """XXH64 of all runs of k words (of the words' own hashes); a text of fewer words, but not none, is one run."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def runs(h: Column) -> Column:
        whole = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        each = F.transform(F.slice(h, 1, F.greatest(F.size(h) - k + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))))
        return F.when(F.size(h) < k, whole).otherwise(each)

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def scaled(hashes: Column) -> Column:
    """The sketch of a set of hashes (or of sketches laid end to end): sorted, distinct."""

    def kept(low: Column) -> Column:
        least = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(least)

    return let(F.filter(hashes, lambda h: h < F.lit(CUTOFF)), kept)


def sketch(text: Column) -> Column:
    """The sketch of a text; null counts as empty."""
    return let(shingle_hashes(F.coalesce(text, F.lit(""))), scaled)


def merged(*sketches: Column) -> Column:
    """The sketch of all shingles of several texts, from their sketches alone."""
    return let(F.concat(*sketches), scaled)


def told(sk: Column) -> Column:
    """How many hashes of a sketch lie below the fraction: all but one that is there for being the smallest."""
    return F.when(F.get(sk, F.lit(0)) < F.lit(CUTOFF), F.size(sk)).otherwise(0)


def compared(a: Column, b: Column) -> Column:
    """resemblance (shared among all hashes) and containment (shared among those of the smaller), both 0 to 1.

    Equal sketches give 1, also empty ones; an empty one has nothing in common with any other. Containment of
    sketches that are not equal is null where one of them has no hash below the fraction.
    """
    one = F.struct(F.lit(1.0).alias("resemblance"), F.lit(1.0).alias("containment"))

    def measures(both: Column) -> Column:
        union = F.size(a) + F.size(b) - both
        return F.struct(F.when(union > 0, both / union).otherwise(0.0).alias("resemblance"), (both / F.nullif(F.least(told(a), told(b)), F.lit(0))).alias("containment"))

    return F.when(a == b, one).otherwise(let(F.size(F.array_intersect(a, b)), measures))


def contained(a: Column, b: Column) -> Column:
    """The share of a's text that lies in b's, by their sketches; null if a's has no hash below the fraction."""
    return F.size(F.array_intersect(F.filter(a, lambda h: h < F.lit(CUTOFF)), b)) / F.nullif(told(a), F.lit(0))


def hexed(sk: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash."""
    return F.array_join(F.transform(sk, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with fp (the sketch of text) for every row; a column of that name is replaced."""
    return docs.withColumn("fp", sketch(F.col("text")))


def _place(docs: DataFrame) -> DataFrame:
    """docs with __place, by which rows are ordered: null ids, then ascending doc_id, then the text's hash."""
    key = F.col("doc_id").cast("bigint")
    return docs.withColumn("__place", F.struct(key.isNotNull().alias("known"), F.coalesce(key, F.lit(0)).alias("id"), F.xxhash64("text").alias("tie")))


def _firsts(docs: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """One row, written: the places (firsts) at which ranges of about so many rows begin, in order, and their number
    (ranges). The second result is a bound of that number and at most RANGES."""
    n = max(1, min(RANGES, -(-docs.count() // rows)))
    dealt = _place(docs).select("__place").repartitionByRange(n, "__place")
    least = dealt.groupBy(F.spark_partition_id().alias("range")).agg(F.min("__place").alias("first"))
    return written(least.agg(F.array_sort(F.collect_list("first")).alias("firsts")).withColumn("ranges", F.size("firsts"))), n


def with_next(docs: DataFrame, columns: list[str], add=lambda rows: rows, rows: int = RANGE_ROWS) -> DataFrame:
    """docs with next_<column> of the row that follows by ascending doc_id; the first follows the last.

    Rows are dealt by ranges of ids, and each range also gets the first row of the one after, so no task
    sees all rows. Where ranges begin is a table of at most RANGES places that the plan refers to, so the plan
    grows by one step as they double. add() may give the rows further columns once they are dealt, so that these
    are not shuffled. Null ids come first; rows of one id are ordered by their text's hash. Columns of docs
    named next_<column> are replaced; docs has no column named __place, __range, __copy or __at.
    """
    table, most = _firsts(docs, rows)
    firsts, ranges = table.select("firsts").scalar(), table.select("ranges").scalar()
    begins = lambda at: F.get(firsts, at)
    number, base = F.col("__at"), _place(docs).withColumn("__at", F.lit(0))
    for bit in reversed(range((most - 1).bit_length())):  # a binary search for the last range that begins at or before the row
        base = base.withColumn("__at", number + F.when(begins(number + (1 << bit)) <= F.col("__place"), 1 << bit).otherwise(0))
    home = F.struct(number.alias("range"), F.lit(0).alias("copy"))
    before = F.struct(F.when(number == 0, ranges - 1).otherwise(number - 1).alias("range"), F.when(number == 0, 2).otherwise(1).alias("copy"))
    dealt = base.withColumn("__at", F.explode(F.when(begins(number) == F.col("__place"), F.array(home, before)).otherwise(F.array(home))))
    dealt = dealt.select(*docs.columns, "__place", F.col("__at.range").alias("__range"), F.col("__at.copy").alias("__copy"))
    window = Window.partitionBy("__range").orderBy("__copy", "__place")
    led = add(dealt.repartition("__range")).withColumns({f"next_{c}": F.lead(c).over(window) for c in columns})
    return led.filter("__copy = 0").drop("__range", "__place", "__copy")


def edited(text: Column, after: Column) -> Column:
    """text with its last quarter (of code points) replaced by as many first ones of the text after it."""
    n = F.length(text)
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(after, F.lit(1), k))


def compared_with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp and those of the edited text and the next document, with both comparisons. Null text: empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, ["text", "fp"], fingerprints)
    rows = rows.withColumn("edited_text", edited(F.col("text"), F.col("next_text"))).drop("next_text")
    rows = rows.withColumn("edited_fp", sketch(F.col("edited_text")))
    return rows.withColumns({"to_edited": compared(F.col("fp"), F.col("edited_fp")), "to_next": compared(F.col("fp"), F.col("next_fp"))})
