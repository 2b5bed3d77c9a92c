"""Queries of the scalar functions, over texts and addresses of the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenyard.functions import dates, numbers, repair, text, urls
from lumenyard.operators import gate, opportunity, pages, verdict
from lumenyard.plans.registry import register
from lumenyard.sources.tables import table


def _amounts(spark, sf):
    """o_orderkey, cents and the same amount written in five ways, some of them with a currency."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole, rest = F.floor(F.col("cents") / 100).cast("bigint"), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    group = lambda sep: F.replace(F.format_number(whole, 0), F.lit(","), F.lit(sep))
    way = F.col("o_orderkey") % 5
    written = (
        F.when(way == 0, F.concat(F.lit("USD "), group(","), F.lit("."), rest))
        .when(way == 1, F.concat(group("."), F.lit(","), rest, F.lit(" €")))
        .when(way == 2, F.concat(F.lit("£"), whole.cast("string"), F.lit("."), rest))
        .when(way == 3, F.concat(group(","), F.lit(" total")))
        .otherwise(F.lit("in stock"))
    )
    return table(spark, sf, "orders").select("o_orderkey", cents.alias("cents")).select("o_orderkey", "cents", written.alias("written"))


_CENTS = "SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders"


@register("sc01_loose_number", f"SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN floor(cents / 100)::DOUBLE WHEN 4 THEN NULL ELSE cents / 100.0::DOUBLE END AS number FROM ({_CENTS})")
def sc01(spark, sf):
    """What was written in several ways is read back as the same number; the SQL knows it from the source."""
    return _amounts(spark, sf).select("o_orderkey", numbers.loose_number(F.col("written")).alias("number"))


@register("sc02_money", f"SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' END AS currency, o_orderkey % 5 <> 4 AS is_money FROM ({_CENTS})")
def sc02(spark, sf):
    read = _amounts(spark, sf).select("o_orderkey", numbers.money(F.col("written")).alias("m"))
    return read.select("o_orderkey", "m.currency", F.col("m").isNotNull().alias("is_money"))


@register("sc04_tolerance", "SELECT l_linenumber, count(*) FILTER (abs(l_extendedprice - l_extendedprice * (1 + l_tax / 10)) / greatest(abs(l_extendedprice), abs(l_extendedprice * (1 + l_tax / 10)), 1) <= 0.005) AS agree FROM lineitem GROUP BY 1")
def sc04(spark, sf):
    p = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count_if(numbers.near(p, p * (1 + F.col("l_tax") / 10))).alias("agree"))


_BLANK = text.BLANK.replace("[\\s", "[\\s\\x0B")


@register("sc09_normal_text", f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g'), '{_BLANK}', ' ', 'g'))) AS digest FROM documents")
def sc09(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normal_text(F.col("text"))).alias("digest"))


@register("sc10_comparison_key", "SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(trim(regexp_replace(text, '\\s+', ' ', 'g')))), '[^a-z0-9 ]', '', 'g'))) AS digest FROM documents")
def sc10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.comparison_key(F.col("text"))).alias("digest"))


@register("sc13_key", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key FROM part")
def sc13(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.alnum_key(F.col("p_name")).alias("key"))


def _dated(spark, sf):
    """o_orderkey and its date written in six ways."""
    d = F.col("o_orderdate")
    way = F.col("o_orderkey") % 6
    day, month = F.date_format(d, "d"), F.date_format(d, "MMMM")
    year = F.date_format(d, "yyyy")
    written = (
        F.when(way == 0, F.concat(F.lit("closes "), day, F.lit(" "), month, F.lit(" "), year))
        .when(way == 1, F.concat(month, F.lit(" "), day, F.lit("th, "), year))
        .when(way == 2, F.date_format(d, "'until 'yyyy-MM-dd"))
        .when(way == 3, F.concat(F.lit("from 1 January 1995 to "), day, F.lit(" "), F.substring(month, 1, 3), F.lit(". "), year))
        .when(way == 4, F.date_format(d, "M/d/yyyy"))
        .otherwise(F.lit("31 February 2026 or 2026"))
    )
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate", written.alias("raw"))


_DATED = "CASE o_orderkey % 6 WHEN 5 THEN NULL WHEN 3 THEN greatest(o_orderdate::DATE, DATE '1995-01-01') ELSE o_orderdate::DATE END"


@register("sc20_deadline", f"SELECT o_orderkey, {_DATED} AS deadline FROM orders")
def sc20(spark, sf):
    return _dated(spark, sf).select("o_orderkey", dates.parse_deadline(F.col("raw")).alias("deadline"))


@register("sc21_passed", f"SELECT o_orderkey, coalesce({_DATED} < DATE '1997-01-01' - INTERVAL 1 DAY, false) AS passed, datediff('day', DATE '1997-01-01', {_DATED}) AS days FROM orders")
def sc21(spark, sf):
    now = F.lit("1997-01-01 00:00:00").cast("timestamp")
    rows = _dated(spark, sf).select("o_orderkey", dates.parse_deadline(F.col("raw")).alias("d"))
    return rows.select("o_orderkey", dates.has_passed(F.col("d"), now).alias("passed"), dates.days_until(F.col("d"), now).alias("days"))


_REDACT = "text"
for _p in text.SECRETS:
    _REDACT = "regexp_replace(" + _REDACT + ", '" + _p.replace("'", "''") + "', '[redacted]', 'g')"


@register("sc25_redact", f"SELECT doc_id, md5({_REDACT}) AS digest FROM documents WHERE regexp_matches(text, '^[\\x00-\\x7F]*$')")
def sc25(spark, sf):
    """Over ASCII texts here, since the two engines differ on word boundaries at other letters."""
    rows = table(spark, sf, "documents").filter(F.rlike("text", F.lit("^[\\x00-\\x7F]*$")))
    return rows.select("doc_id", F.md5(text.redact(F.col("text"))).alias("digest"))


_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9 ]', '', 'g'))"


@register("sc27_agreement", f"SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'incomparable' WHEN contains({_KEY.format('p_name')}, {_KEY.format('p_type')}) OR contains({_KEY.format('p_type')}, {_KEY.format('p_name')}) OR p_size % 3 = 1 THEN 'agree' ELSE 'disagree' END AS kind FROM part WHERE NOT regexp_matches(p_name, '[0-9]') AND NOT regexp_matches(p_type, '[0-9]')")
def sc27(spark, sf):
    """A name against nothing, itself in capitals, or a type."""
    rows = table(spark, sf, "part").filter(~F.rlike("p_name", F.lit("[0-9]")) & ~F.rlike("p_type", F.lit("[0-9]")))
    other = F.when(F.col("p_size") % 3 == 0, None).when(F.col("p_size") % 3 == 1, F.upper("p_name")).otherwise(F.col("p_type"))
    return rows.select("p_partkey", text.agreement(F.col("p_name"), other).alias("kind"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '')"


@register("sc28_host", f"SELECT page_id, {_HOST} AS host FROM pages")
def sc28(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


@register("sc29_canonical", f"SELECT page_id, 'https://' || {_HOST} || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') || regexp_extract(url, '^https?://[^?#]*(\\?[^#]*)', 1) AS canonical FROM pages")
def sc29(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@register("sc30_without_tracking", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '(?i)([?&])(?:utm_[a-z]+|gclid|fbclid|mc_cid|mc_eid|ref|source)=[^&#]*', '\\1', 'g'), '&{2,}', '&', 'g'), '\\?&+', '?', 'g'), '[?&]+(#|$)', '\\1') AS url FROM pages")
def sc30(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.without_tracking(F.col("url")).alias("url"))


@register("sc34_id", "SELECT doc_id, substring(sha256(text), 1, 18) AS id FROM documents")
def sc34(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.page_key(F.col("text")).alias("id"))


@register("sc35_certificate", "SELECT o_orderkey, sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\",\"o_orderpriority\":\"' || o_orderpriority || '\"}') AS digest FROM orders")
def sc35(spark, sf):
    return gate.certificate(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"]).select("o_orderkey", "digest")


_COUNT = "len(regexp_extract_all({}, '{}'))"


@register(
    "sc36_page_shape",
    "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INT AS lines, len(regexp_extract_all(text, '\\S+'))::INT AS words, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^#{1,6}\\s+\\S')))::INT AS headings FROM documents",
)
def sc36(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", verdict.page_shape(F.col("text")).alias("s"))
    return rows.select("doc_id", "s.lines", F.col("s.words").alias("words"), F.size("s.headings").alias("headings"))


@register("sc39_kind", "SELECT p_partkey, CASE WHEN contains(t, 'scholar') THEN 'scholarship' WHEN contains(t, 'fellow') THEN 'fellowship' WHEN contains(t, 'intern') THEN 'internship' WHEN contains(t, 'grant') THEN 'grant' END AS kind FROM (SELECT p_partkey, p_name || CASE p_size % 4 WHEN 0 THEN ' Scholars grant' WHEN 1 THEN ' INTERN' WHEN 2 THEN ' grants' ELSE '' END t0, lower(t0) t FROM part)")
def sc39(spark, sf):
    tail = F.when(F.col("p_size") % 4 == 0, " Scholars grant").when(F.col("p_size") % 4 == 1, " INTERN").when(F.col("p_size") % 4 == 2, " grants").otherwise("")
    return table(spark, sf, "part").select("p_partkey", opportunity.kind_of(F.concat("p_name", tail)).alias("kind"))


@register("v14_links", "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)) AS link FROM pages")
def v14(spark, sf):
    return pages.html_links(table(spark, sf, "pages"))


@register("p01_props", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def p01(spark, sf):
    from lumenyard.sources.tables import field_at

    return table(spark, sf, "events").select("event_id", field_at(F.try_parse_json("props"), "k", "int")["value"].alias("k"))


@register("s08_public_url", "SELECT page_id, NOT regexp_matches(url, '//(localhost|10\\.|127\\.|192\\.168\\.)') AS public FROM pages")
def s08(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.is_public(F.col("url")).alias("public"))


@register("sc14_unscrambled", "SELECT doc_id, md5(text) AS digest FROM documents")
def sc14(spark, sf):
    """Whole texts are scrambled as a wrong decoder would, and restored; plain ones stay as they are."""
    wrong = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, sf, "documents").select("doc_id", F.md5(repair.unscrambled(wrong)).alias("digest"))


@register("p06_lists", "SELECT p_partkey, p_brand || '/' || p_type AS parts FROM part WHERE p_brand <> p_type")
def p06(spark, sf):
    rows = table(spark, sf, "part").filter("p_brand <> p_type")
    written = F.concat("p_brand", F.lit("; "), "p_type", F.lit(" ,"), "p_brand", F.lit("|"))
    return rows.select("p_partkey", F.array_join(repair.as_list(written), "/").alias("parts"))
