"""What pages say: links, facts in their markup, labelled values in their text, and who may read them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenyard.functions.dates import parse_deadline
from lumenyard.functions.numbers import money
from lumenyard.functions.text import comparison_key, let, strip_markdown
from lumenyard.functions.urls import host, without_tracking

# Hosts and endings that lead nowhere useful.
NEVER_HOSTS = "(?:^|\\.)(?:facebook|twitter|x|instagram|linkedin|youtube|pinterest|tiktok|whatsapp|t)\\.(?:com|me|co)$"
NEVER_PATHS = "(?i)/(?:login|signin|signup|register|cart|privacy|terms|cookies?|contact)(?:/|$)"
NEVER_FILES = "(?i)\\.(?:pdf|docx?|xlsx?|pptx?|zip|png|jpe?g|gif|svg|mp[34])$"
PROMISING = "(?i)scholar|fellow|grant|intern|award|program|opportunit|funding|call"
# How sure each way of reading a value is.
CONFIDENCE = {"json-ld": 0.95, "markdown-link": 0.85, "labelled-line": 0.85, "table-row": 0.85, "heading-adjacent": 0.6, "bare-currency": 0.35}
AMOUNT = "(?:[$£€¥₹]\\s?[0-9][0-9.,]*|[0-9][0-9.,]*\\s?(?:USD|EUR|GBP|INR))"


def resolve(href: Column, base: Column) -> Column:
    """An absolute http address from a link on a page, without tracking and fragment; null for other schemes."""
    root = F.regexp_extract(base, "^((?i:https?)://[^/?#]+)", 1)
    folder = F.regexp_extract(base, "^((?i:https?)://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    found = (
        F.when(F.rlike(href, F.lit("^(?i:https?)://")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, "^((?i:https?):)", 1), href))
        .when(F.rlike(href, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:|^#")), F.lit(None))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .otherwise(F.concat(F.regexp_replace(folder, "([^/])$", "$1/"), href))
    )
    return without_tracking(F.regexp_replace(found, "#.*$", ""))


def html_links(pages: DataFrame) -> DataFrame:
    """page_id and every distinct href of a page, as written."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit("(?i)href\\s*=\\s*[\"']([^\"']*)[\"']"), F.lit(1)))
    return pages.select("page_id", F.explode(found).alias("link"))


def harvest(pages: DataFrame, limit: int = 200) -> DataFrame:
    """page_id, url, text, pos: the promising links of a markdown page, each once and in its order, the first limit of them."""
    pattern = "(?<!!)\\[([^\\]]*)\\]\\(([^)\\s]+)[^)]*\\)"
    links = F.transform(F.regexp_extract_all("markdown", F.lit(pattern), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("text"), resolve(F.regexp_extract(m, pattern, 2), F.col("url")).alias("to")))

    def worth(x: Column) -> Column:
        to = x["to"]
        return to.isNotNull() & host(to).isNotNull() & ~F.rlike(host(to), F.lit(NEVER_HOSTS)) & ~F.rlike(to, F.lit(NEVER_PATHS)) & ~F.rlike(to, F.lit(NEVER_FILES)) & (to != F.col("url"))

    def once(xs: Column) -> Column:
        to = F.transform(xs, lambda x: x["to"])
        first = F.filter(F.transform(xs, lambda x, i: F.struct(x["text"].alias("text"), x["to"].alias("to"), (F.array_position(to, x["to"]) == i + 1).alias("new"))), lambda x: x["new"])
        return F.slice(first, 1, limit)

    promising = lambda x: F.rlike(x["text"], F.lit(PROMISING)) | F.rlike(x["to"], F.lit(PROMISING))
    kept = let(F.filter(links, lambda x: worth(x) & promising(x)), once)
    return pages.select("page_id", F.posexplode(kept).alias("pos", "x")).select("page_id", F.col("x.to").alias("url"), F.col("x.text").alias("text"), "pos")


@dataclass(frozen=True)
class Field:
    """What to read: kind is money, number, text or enum; shape date or url narrows texts."""

    path: str
    labels: tuple[str, ...]
    kind: str = "text"
    exclude: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    shape: str | None = None


def _fits(value: Column, spec: Field) -> Column:
    """The value, if it is of the field's kind and shape, else null."""
    if spec.kind in ("money", "number"):
        value = F.when(money(value).isNotNull(), value)
    if spec.kind == "enum":
        out = F.lit(None).cast("string")
        for a in reversed(spec.allowed):
            out = F.when(F.contains(comparison_key(value), comparison_key(F.lit(a))), F.lit(a)).otherwise(out)
        value = out
    if spec.shape == "date":
        value = F.when(parse_deadline(value).isNotNull(), value)
    if spec.shape == "url":
        value = F.when(F.rlike(value, F.lit("(?i)^https?://")), value)
    return F.nullif(value, F.lit(""))


def extract(markdown: Column, url: Column, spec: Field) -> Column:
    """struct<value, confidence, strategy> of a field, by the first way of reading that finds one; else null.

    Facts in JSON-LD come first, then links (for addresses), labelled lines, table rows, the lines below
    a heading, and an amount that is the only one on the page.
    """
    keys = [comparison_key(F.lit(x)) for x in spec.labels]
    outs = [comparison_key(F.lit(x)) for x in spec.exclude]

    def named(key: Column) -> Column:
        """Whether a line's key names the field; a label without Latin letters or digits has no key and names nothing."""
        within = lambda xs: reduce(Column.__or__, (F.contains(key, x) & (x != "") for x in xs), F.lit(False))
        return within(keys) & ~within(outs)

    names = "|".join([*("[ _]?".join(map(re.escape, x.split(" "))) for x in spec.labels), re.escape(spec.path.split(".")[-1])])
    fact = f"(?i)\"(?:{names})\"\\s*:\\s*\"?([^\",}}\\]]+)"
    # only what stands in a JSON object counts as a fact
    blocks = F.filter(F.regexp_extract_all(markdown, F.lit("(?s)\\{.*?\\}"), F.lit(0)), lambda b: F.try_parse_json(b).isNotNull())
    facts = F.array_join(blocks, "\n")
    json_ld = F.when(F.contains(markdown, F.lit("{")), _fits(F.nullif(F.trim(F.regexp_extract(facts, fact, 1)), F.lit("")), spec))

    link = "\\[([^\\]]*)\\]\\(([^)\\s]+)[^)]*\\)"

    def first(values: Column) -> Column:
        return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))

    if spec.shape == "url":
        found = F.filter(F.regexp_extract_all(markdown, F.lit(link), F.lit(0)), lambda m: named(comparison_key(F.regexp_extract(m, link, 1))))
        links = first(F.transform(found, lambda m: _fits(resolve(F.regexp_extract(m, link, 2), url), spec)))
    else:
        links = F.lit(None).cast("string")

    pair = "^([^:\\x{FF1A}]{1,60})[:\\x{FF1A}]\\s*(.*)$"

    def told(raw: Column) -> Column:
        """What a line is, found once: its plain text, what stands before and after a colon, and whether these name the field."""
        plain = strip_markdown(raw)

        def parts(p: Column) -> Column:
            name = F.regexp_extract(p, pair, 1)
            row, head = F.startswith(raw, F.lit("|")), F.startswith(raw, F.lit("#"))
            return F.struct(
                raw.alias("raw"),
                p.alias("plain"),
                F.trim(F.regexp_extract(p, pair, 2)).alias("rest"),
                F.when(row, False).when(name != "", named(comparison_key(name))).otherwise(False).alias("pair"),
                F.when(row | head | (F.length(p) > 60) | F.contains(p, F.lit(":")), False).otherwise(named(comparison_key(p))).alias("alone"),
                row.alias("row"),
                F.when(head, named(comparison_key(p))).otherwise(False).alias("head"),
                head.alias("any_head"),
            )

        return let(plain, parts)

    def lined(lines: Column) -> Column:
        at = lambda i: F.get(lines, i)
        every = F.sequence(F.lit(0), F.size(lines) - 1)

        def line_value(i: Column) -> Column:
            own = F.when(at(i)["rest"] == "", at(i + 1)["plain"]).otherwise(at(i)["rest"])
            return F.when(at(i)["pair"], _fits(own, spec)).when(at(i)["alone"], _fits(at(i + 1)["plain"], spec))

        def row_value(i: Column) -> Column:
            cells = F.filter(F.transform(F.split(at(i)["raw"], "\\|"), lambda c: F.trim(c)), lambda c: c != "")
            fit = lambda c: F.when(named(comparison_key(F.get(c, F.lit(0)))), first(F.transform(F.slice(c, 2, 20), lambda x: _fits(x, spec))))
            return F.when(at(i)["row"], let(cells, fit))

        def heading_value(i: Column) -> Column:
            below = F.array(*(_fits(F.when(~at(i + k)["any_head"], at(i + k)["plain"]), spec) for k in (1, 2, 3)))
            return F.when(at(i)["head"], first(below))

        return F.struct(*(first(F.transform(every, f)).alias(n) for n, f in [("line", line_value), ("row", row_value), ("heading", heading_value)]))

    lines = F.filter(F.transform(F.split(markdown, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    amounts = F.array_distinct(F.regexp_extract_all(markdown, F.lit(AMOUNT), F.lit(0)))
    bare = F.when(F.size(amounts) == 1, F.get(amounts, F.lit(0))) if spec.kind in ("money", "number") else F.lit(None).cast("string")

    def chosen(found: Column) -> Column:
        ways = [("json-ld", json_ld), ("markdown-link", links), ("labelled-line", found["line"]), ("table-row", found["row"]), ("heading-adjacent", found["heading"]), ("bare-currency", bare)]
        return F.coalesce(*(F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(CONFIDENCE[n]).alias("confidence"), F.lit(n).alias("strategy"))) for n, v in ways))

    whole = F.transform(F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(""))), told)
    return let(let(whole, lined), chosen)


def robots_rules(files: DataFrame) -> DataFrame:
    """origin, agent, verb (allow, disallow), pattern of robots files (origin, text), one row a rule and agent.

    Agent lines in a row share the rules that follow them; an agent without rules has one row without a pattern.
    """
    from pyspark.sql.window import Window

    line = F.trim(F.substring_index("line", "#", 1))
    rows = files.select("origin", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    rows = rows.select("origin", "pos", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("verb"), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1)).alias("value"), F.contains(line, F.lit(":")).alias("ok"))
    rows = rows.filter("ok").drop("ok")
    order = Window.partitionBy("origin").orderBy("pos")
    agent = F.col("verb") == "user-agent"
    starts = agent & ~F.coalesce(F.lag(agent).over(order), F.lit(False))
    rows = rows.withColumn("starts", starts.cast("int")).withColumn("grp", F.sum("starts").over(order))
    agents = rows.filter(agent).select("origin", "grp", F.lower("value").alias("agent"))
    rules = rows.filter(F.col("verb").isin("allow", "disallow") & (F.col("value") != "")).select("origin", "grp", "verb", F.col("value").alias("pattern"))
    return agents.join(rules, ["origin", "grp"], "left").select("origin", "grp", "agent", "verb", "pattern")


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """url, allowed and reason: the longest rule that fits the path decides, an allowing one among equals.

    Rules of the first group that names the agent count, else those for all. No rules: allowed.
    """
    named = F.when((F.col("agent") != "*") & F.contains(F.lit(agent.lower()), F.col("agent")), 0).when(F.col("agent") == "*", 1)
    own = rules.withColumn("rank", named).filter("rank is not null")
    best = own.groupBy("origin").agg(F.min(F.struct("rank", "grp")).alias("m")).select("origin", "m.rank", "m.grp")
    own = own.join(best, ["origin", "rank", "grp"]).select("origin", "verb", "pattern")
    body = F.regexp_replace(F.regexp_replace("pattern", "\\$$", ""), "([.+?^${}()|\\[\\]\\\\])", "\\\\$1")
    regex = F.concat(F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(F.endswith("pattern", F.lit("$")), "$").otherwise(""))
    rule = F.when(F.col("pattern").isNotNull(), F.struct((F.col("verb") == "allow").alias("allow"), F.length("pattern").alias("length"), regex.alias("regex")))
    # a robots file's rules are one row of its origin: urls are joined with that and never multiply
    held = own.groupBy("origin").agg(F.array_distinct(F.collect_list(rule)).alias("rules"))
    asked = urls.select("url", F.regexp_extract("url", "^((?i:https?)://[^/?#]+)", 1).alias("origin"), F.regexp_extract("url", "^(?i:https?)://[^/?#]+([^#]*)", 1).alias("path"))
    asked = asked.withColumn("path", F.when(F.startswith("path", F.lit("/")), F.col("path")).otherwise(F.concat(F.lit("/"), "path")))
    found = asked.join(held, "origin", "left")
    longest = lambda allow: F.array_max(F.transform(F.filter("rules", lambda r: (r["allow"] == allow) & F.rlike(F.col("path"), r["regex"])), lambda r: r["length"]))
    found = found.withColumns({"yes": longest(True), "no": longest(False), "n": F.coalesce(F.size("rules"), F.lit(0))})
    reason = F.when(F.col("n") <= 0, "no_rules").when(F.col("no").isNull(), "not_disallowed").when(F.col("yes") >= F.col("no"), "explicitly_allowed").otherwise("disallowed")
    return found.select("url", (reason != "disallowed").alias("allowed"), reason.alias("reason"))


def crawl(seeds: DataFrame, links: DataFrame, depth: int = 2, per_host: int = 40, limit: int = 500) -> DataFrame:
    """url, depth of all pages reached from seeds (url) over links (src, dst), fairly over hosts in each round.

    Each round reads the next batch of unseen addresses; what was seen is written out between rounds.
    """
    from lumenyard.operators.ranking import round_robin

    batch = seeds.select("url").distinct().withColumn("depth", F.lit(0)).withColumn("host", F.coalesce(host(F.col("url")), F.lit("")))
    seen = round_robin(batch, "host", per_host, limit, F.col("url")).select("url", "depth").checkpoint()
    last = seen
    for d in range(1, depth + 1):
        found = last.join(links, last["url"] == links["src"]).select(F.col("dst").alias("url")).distinct()
        fresh = found.join(seen, "url", "left_anti").withColumn("depth", F.lit(d)).withColumn("host", F.coalesce(host(F.col("url")), F.lit("")))
        last = round_robin(fresh, "host", per_host, limit, F.col("url")).select("url", "depth").checkpoint()
        seen = seen.unionByName(last).checkpoint()
    return seen
