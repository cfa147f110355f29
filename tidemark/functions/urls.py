"""Hosts and source tiers. Hosts are compared by label, never as a substring of the URL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Registered domains by class, and declared source types.
REGULATOR = "sec.gov"
AGGREGATOR = "seekingalpha.com"
PUBLISHERS = {
    "reuters": ("reuters.com",),
    "bloomberg": ("bloomberg.com",),
    "wsj": ("wsj.com",),
    "cnbc": ("cnbc.com",),
    "dowjones": ("dowjones.com", "wsj.com"),
}
ISSUER_TYPES = ("company_ir", "ir", "earnings_presentation")
REGULATOR_TYPES = ("sec", "8-k", "10-k", "10-q")
AGGREGATOR_TYPES = ("seeking_alpha", "seekingalpha", "sa")
TRANSCRIPT_TYPES = ("official_transcript", "transcript")


def hostname(url: Column) -> Column:
    """The lower-case host of a URL without a trailing dot; NULL without one."""
    host = F.rtrim(F.lower(F.try_parse_url(F.trim(url), F.lit("HOST"))), F.lit("."))
    return F.when(host != "", host)


def under(host: Column, domain: Column | str) -> Column:
    """The host is the domain or a subdomain of it."""
    d = F.lit(domain) if isinstance(domain, str) else domain
    return F.coalesce((host == d) | host.endswith(F.concat(F.lit("."), d)), F.lit(False))


def under_any(host: Column, domains: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [under(host, d) for d in domains])


def suffixes(host: Column) -> Column:
    """The host and every parent domain of it: joins on them are equi-joins."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def is_generic_issuer(host: Column) -> Column:
    return F.coalesce(host.rlike(r"^(investor|investors)\."), F.lit(False)) | (F.coalesce(host.startswith("ir."), F.lit(False)) & ~under(host, AGGREGATOR))


def source_tier(url: Column, declared: Column, official: Column) -> Column:
    """Tier as text. ``official``: the host is on the issuer's own list. A declared type that the host contradicts is a mismatch; one
    that is not known leaves the decision to the host."""
    host, kind = hostname(url), F.lower(F.trim(declared))
    has_url = F.coalesce(F.trim(url) != "", F.lit(False))
    official = F.coalesce(official, F.lit(False))
    typed = lambda fits, tier: F.when(~has_url | fits, tier).otherwise("source_mismatch")
    by_type = (
        F.when(kind.isin(*ISSUER_TYPES), typed(official, "1"))
        .when(kind.isin(*REGULATOR_TYPES), typed(under(host, REGULATOR), "1"))
        .when(kind.isin(*TRANSCRIPT_TYPES), typed(official | under(host, REGULATOR), "official"))
        .when(kind.isin(*AGGREGATOR_TYPES), typed(under(host, AGGREGATOR), "4"))
    )
    for name, domains in PUBLISHERS.items():
        by_type = by_type.when(kind == name, typed(under_any(host, domains), "3"))
    published = tuple(dict.fromkeys(d for x in PUBLISHERS.values() for d in x))
    by_host = (
        F.when(~has_url, F.lit(None).cast("string"))
        .when(under(host, REGULATOR) | official, "1")
        .when(is_generic_issuer(host), "unverified_ir_candidate")
        .when(under_any(host, published), "3")
        .when(under(host, AGGREGATOR), "4")
        .otherwise("Unknown")
    )
    return F.coalesce(by_type, by_host)
