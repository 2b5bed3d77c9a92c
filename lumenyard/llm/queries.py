"""The registered query of each training-data operator, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bytebpe, decontam, fingerprint, langid, lexical, licenses, lm_scoring, neardup, packing, quality, sharding, urlfilter
from .shared import fold, table


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.compared_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.hexed(F.col("fp")).alias("fingerprint"),
        fingerprint.hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        F.col("to_edited.resemblance").alias("near_edited"),
        F.col("to_next.resemblance").alias("near_next"),
        F.col("to_edited.containment").alias("within_edited"),
        F.col("to_next.containment").alias("within_next"),
    )


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) == 0)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = quality.classify(docs, model)
    predicted = F.when(F.col("quality_score") >= quality.THRESHOLD, 1).otherwise(0)
    return found.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), predicted.alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_entropy")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(table(spark, sf_dir, "documents"))
    rows = found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(rows)


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("licenses", lambda d: d["base"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    rows = found.select("doc_id", "license_words", "licenses", base.alias("base"))
    return rows.select(
        "doc_id",
        F.col("license_words").alias("n_words"),
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.start").cast("bigint").alias("first_word"),
        F.array_max("base.start").cast("bigint").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.col("licenses.label")).alias("labels"),
        F.coalesce(F.array_max("licenses.confidence"), F.lit(0.0)).alias("score"),
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct("bench_matches.item_id"))
    return found.select(
        "doc_id",
        F.col("bench_words").alias("n_words"),
        F.col("bench_hit").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        decontam.is_contaminated().alias("contaminated"),
    )


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return alignment.scored(found.withColumn("groups_sha256", digest).drop("text", "groups"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, corpus = lexical.index(table(spark, sf_dir, "documents"))
    return lexical.search(blocks, corpus, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bytebpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("bpe_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("bpe_ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bpe_bytes", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_language_id": op3_language_id,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_license_scans": op5_license_scans,
    "op6_url_filters": op6_url_filters,
    "op7_sharding": op7_sharding,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_ranked_lexical_search": op12_ranked_lexical_search,
    "op13_byte_bpe": op13_byte_bpe,
}
_WORDS = "list_filter(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
_TERMS = "list_filter(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
_WINDOWS = "array_to_string(w[spot:spot + k - 1], ' ') AS window_text"


def _url_sql() -> str:
    """Rules, and as many unrolled steps of trust and distrust as the operator takes."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lower.format("regexp_extract(coalesce(url, ''), '^((?s:.*?))://([^/?#]*)', 2)")
    link = urlfilter.LINK.replace("'", "''")
    fits = {r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in sorted(urlfilter.RULES, key=lambda r: -len(r.name))}
    case = lambda value: "CASE " + " ".join(f"WHEN {test} THEN '{value(r)}'" for r, test in fits.items()) + " END"
    steps = []
    for k in range(1, urlfilter.STEPS + 1):
        steps.append(
            f"""moving{k} AS MATERIALIZED (SELECT kind, dst AS host, mass * share * {urlfilter.DAMPING} AS got FROM mass{k - 1} JOIN steps_of USING (kind, host)),
            mass{k} AS MATERIALIZED (SELECT kind, host, sum(got) AS mass FROM (SELECT * FROM moving{k} UNION ALL
            SELECT kind, host, seed * (1 - coalesce(kept, 0)) FROM seeds LEFT JOIN (SELECT kind, sum(got) AS kept FROM moving{k} GROUP BY 1) USING (kind)) GROUP BY 1, 2)"""
        )
    return f"""
    WITH p AS MATERIALIZED (SELECT page_id, html, {host} AS host, regexp_extract(coalesce(url, ''), '^((?s:.*?))://[^/?#]*([^?#]*)', 2) AS path FROM pages),
    j AS MATERIALIZED (SELECT page_id, host, path, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS own FROM p),
    hosts AS MATERIALIZED (SELECT host, count(*) FILTER (own = 'allow') AS allowed, count(*) FILTER (own = 'block') AS blocked FROM j WHERE host <> '' GROUP BY 1),
    sums AS (SELECT coalesce(sum(allowed), 0) AS a, coalesce(sum(blocked), 0) AS b FROM hosts),
    seeds AS MATERIALIZED (SELECT 'trust' AS kind, host, allowed / a AS seed FROM hosts, sums WHERE allowed > 0 UNION ALL SELECT 'distrust', host, blocked / b FROM hosts, sums WHERE blocked > 0),
    links AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {lower.format("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM p) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
    edges AS (SELECT 'trust' AS kind, src AS host, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
    steps_of AS MATERIALIZED (SELECT kind, host, dst, n / sum(n) OVER (PARTITION BY kind, host) AS share FROM edges),
    mass0 AS (SELECT kind, host, seed AS mass FROM seeds),
    {", ".join(steps)},
    scored AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) * any_value(a) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) * any_value(b) AS distrust FROM mass{urlfilter.STEPS}, sums GROUP BY 1)
    SELECT page_id, j.host AS host, path, rule, coalesce(own, CASE WHEN distrust / (trust + distrust) >= {urlfilter.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
    FROM j LEFT JOIN scored ON scored.host = j.host"""


#: The other operators need a hash, tokenizer, model or search that DuckDB lacks.
ORACLES: dict[str, str] = {
    "op6_url_filters": _url_sql(),
    "op8_benchmark_decontamination": f"""
    WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w, len(w) AS n FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w, len(w) AS n, least({decontam.WINDOW}, n) AS k FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL AND len({_WORDS}) > 0),
    bench_windows AS (SELECT DISTINCT item_id, k, {_WINDOWS} FROM b, unnest(range(1, n - k + 2)) t(spot)),
    doc_windows AS (SELECT doc_id, spot, k, {_WINDOWS} FROM d, (SELECT DISTINCT k FROM b), unnest(range(1, n - k + 2)) t(spot)),
    found AS (SELECT DISTINCT doc_id, spot, k, item_id FROM doc_windows JOIN bench_windows USING (k, window_text)),
    hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + k)) AS place FROM found) GROUP BY 1),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1)
    SELECT d.doc_id AS doc_id, n AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit > 0 AND {decontam.SHARE} * n_hit >= n, false) AS contaminated
    FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""",
    "op12_ranked_lexical_search": f"""
    WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
    total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
    postings AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, row_number() OVER () AS own, len(w) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, own, n, term),
    weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM postings, total GROUP BY term),
    items AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
    scored AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM items JOIN weights USING (term) JOIN postings USING (term), total GROUP BY item_id, doc_id),
    ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {lexical.TOP}""",
}
