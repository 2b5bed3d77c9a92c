"""URL filters: rules by host and path, and trust spread over the links between hosts.

Hosts of allowed pages are the trusted seeds of a personalised PageRank along the links; hosts of blocked
pages are the seeds of distrust, which runs against them (who links to a blocked host is suspect). Where
no rule fits a page, its host is blocked if its share of distrust reaches a threshold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

DAMPING = 0.85
LEFT = 0.01  # share of a walk that may still be under way when the steps end
STEPS = math.ceil(math.log(LEFT) / math.log(DAMPING))
THRESHOLD = 0.5  # share of distrust from which a host is blocked
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values.
RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[Rule] = RULES) -> Column:
    """verdict and name of the longest rule that fits; null if none does."""
    out = None
    for r in sorted(rules, key=lambda r: len(r.name), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.name).alias("name"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: how many absolute links the pages of one host have to another. Hosts are read as host_of() reads
    them, with user and port."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    found = found.select("src", ascii_lower(F.col("dst")).alias("dst"))
    return found.filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def personalised(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """kind, host and mass: PageRank whose walks restart at their kind's seeds (kind, host, seed; a kind's seeds sum to 1).

    A walk at a host without links restarts too. Links (kind, src, dst, n) weigh by their number. After
    the steps no more than damping ** steps of a walk is still under way.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    steps_of = checkpointed(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("total")).alias("share")))
    seeds = checkpointed(seeds.select("kind", "host", "seed"))
    mass = seeds.select("kind", "host", F.col("seed").alias("mass"))
    for _ in range(steps if not steps_of.isEmpty() else 0):
        # what a walk does not carry over a link restarts: one number for each kind
        moving = mass.join(steps_of, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("mass") * F.col("share") * damping).alias("got"))
        kept = moving.groupBy("kind").agg(F.sum("got").alias("kept"))
        start = seeds.join(kept, "kind", "left").select("kind", "host", (F.col("seed") * (1 - F.coalesce("kept", F.lit(0.0)))).alias("got"))
        mass = checkpointed(moving.unionByName(start).groupBy("kind", "host").agg(F.sum("got").alias("mass")))
    return mass


def judge(pages: DataFrame, rules: list[Rule] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), trust and distrust of the host for every page.

    A url that is null or has no :// has an empty host, which no rule fits and no link reaches: allowed.
    Pages of hosts that neither seed reaches are allowed. Other columns are ignored.
    """
    rows = pages.select("page_id", "url", "html").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    tally = lambda v: F.count_if(F.col("found.verdict") == v)
    hosts = checkpointed(rows.filter("host <> ''").groupBy("host").agg(tally("allow").alias("allowed"), tally("block").alias("blocked")))
    sums = hosts.agg(F.coalesce(F.sum("allowed"), F.lit(0)).alias("a"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b")).first()
    # trust runs along the links, distrust against them
    links = host_links(rows)
    edges = checkpointed(links.withColumn("kind", F.lit("trust")).unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit("distrust").alias("kind"))))
    trusted = hosts.filter("allowed > 0").select(F.lit("trust").alias("kind"), "host", (F.col("allowed") / max(1, sums["a"])).alias("seed"))
    blocked = hosts.filter("blocked > 0").select(F.lit("distrust").alias("kind"), "host", (F.col("blocked") / max(1, sums["b"])).alias("seed"))
    mass = personalised(edges, trusted.unionByName(blocked))
    # both are weighed by how many pages their seeds were, so a page counts the same on either side
    of = lambda kind, pages: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))) * pages, F.lit(0.0)).alias(kind)
    scored = mass.groupBy("host").agg(of("trust", sums["a"]), of("distrust", sums["b"]))
    suspect = F.coalesce(F.col("distrust") / (F.col("trust") + F.col("distrust")) >= threshold, F.lit(False))
    own = F.coalesce(F.col("found.verdict"), F.when(suspect, F.lit("block")).otherwise(F.lit("allow")))
    return rows.drop("html", "url").join(scored, "host", "left").select("page_id", "host", "path", F.col("found.name").alias("rule"), own.alias("verdict"), "trust", "distrust")
