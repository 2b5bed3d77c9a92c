"""Hosts and canonical addresses, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track where a visit came from.
TRACKING = "(?:utm_[a-z]+|gclid|fbclid|mc_cid|mc_eid|ref|source)"
# Hosts that publish officially; one with a leading dot is a suffix, others are parts.
OFFICIAL = [".edu", ".gov", ".ac.uk", ".org", ".int", ".edu.au", ".ac.in", ".gov.in", "europa.eu", "un.org", "daad.de"]


def host(url: Column) -> Column:
    """Lower case, without www., user and port; null if the text is no http address."""
    found = F.lower(F.regexp_extract(url, "^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(found, "^www\\.", ""), F.lit(""))


def canonical(url: Column) -> Column:
    """https, host without www., no fragment and no closing slash; the text itself if it is no http address."""
    own = F.lower(F.regexp_extract(url, "^(?i:https?)://([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(url, "^(?i:https?)://[^/?#]+([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, "^(?i:https?)://[^?#]*(\\?[^#]*)", 1)
    return F.when(own == "", url).otherwise(F.concat(F.lit("https://"), F.regexp_replace(own, "^www\\.", ""), path, query))


def without_tracking(url: Column) -> Column:
    """url without its tracking parameters."""
    out = F.regexp_replace(url, f"(?i)([?&]){TRACKING}=[^&#]*", "$1")
    out = F.regexp_replace(F.regexp_replace(out, "&{2,}", "&"), "\\?&+", "?")
    return F.regexp_replace(out, "[?&]+(?=#|$)", "")


def looks_official(name: Column) -> Column:
    tests = [F.endswith(name, F.lit(o)) if o.startswith(".") else F.contains(name, F.lit(o)) for o in OFFICIAL]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def is_public(url: Column) -> Column:
    """Whether an http address names a public host: no local name, no private or link-local number."""
    name = host(url)
    private = "^(?:localhost|.*\\.local|.*\\.internal|10\\..*|127\\..*|0\\..*|169\\.254\\..*|192\\.168\\..*|172\\.(?:1[6-9]|2\\d|3[01])\\..*|\\[.*)$"
    return F.coalesce(~F.rlike(name, F.lit(private)), F.lit(False))
