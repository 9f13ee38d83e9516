"""URLs as documents: the destination guard, the per-URL pipeline and source specifications."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.operators.extract import html_text, html_title

# IPv4 blocks that are not globally routable, as (network, prefix length).
RESERVED_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
OUTCOMES = ("Indexed", "Unchanged", "Gone", "Blocked", "Unsupported", "Empty", "FetchError", "ParseFailed")


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it isn't one."""
    parts = F.split(ip, r"\.")
    good = ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    number = sum((F.get(parts, F.lit(k)).try_cast("bigint") * (1 << (24 - 8 * k)) for k in range(4)), F.lit(0).cast("bigint"))
    return F.when(good & F.forall(parts, lambda p: p.try_cast("int") <= 255), number)


def globally_routable(ip: Column) -> Column:
    """False for addresses in reserved IPv4 blocks and for anything that isn't an IPv4 address."""
    n = ip_number(ip)
    reserved = F.lit(False)
    for network, bits in RESERVED_V4:
        low = sum(int(x) << (24 - 8 * k) for k, x in enumerate(network.split(".")))
        reserved = reserved | n.between(low, low + (1 << (32 - bits)) - 1)
    return F.coalesce(~reserved, F.lit(False))


def url_outcomes(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """uri, outcome, title, text, content_hash of fetched pages (url, html and, optionally, status).

    known (uri, content_hash) tells what is unchanged. 404 and 410 are Gone, 401 and 403 Blocked, other errors FetchError.
    """
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    body = html_text(F.col("html"))
    rows = pages.select(F.col("url").alias("uri"), status.alias("status"), "html", html_title(F.col("html")).alias("title"), body.alias("text"))
    rows = rows.withColumn("content_hash", F.sha2(F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))), 256))
    if known is not None:
        rows = rows.join(known.select("uri", F.col("content_hash").alias("__known")), "uri", "left")
    else:
        rows = rows.withColumn("__known", F.lit(None).cast("string"))
    outcome = (
        F.when(F.col("status").isin(404, 410), "Gone").when(F.col("status").isin(401, 403), "Blocked").when(F.col("status") >= 400, "FetchError")
        .when(F.col("html").isNull(), "FetchError").when(~F.coalesce(F.col("html").rlike(r"^\s*<"), F.lit(False)), "Unsupported")
        .when(F.col("text") == "", "Empty").when(F.col("content_hash") == F.col("__known"), "Unchanged").otherwise("Indexed")
    )
    return rows.select("uri", outcome.alias("outcome"), "title", "text", "content_hash")


@dataclass(frozen=True)
class SourceSpec:
    """kind is path (root, include, exclude), url (urls) or feed (url, max_entries, mode)."""

    kind: str
    root: str | None = None
    urls: tuple[str, ...] = ()
    include: tuple[str, ...] | None = None
    exclude: tuple[str, ...] | None = None
    max_entries: int | None = None
    mode: str = "discovery"
    refresh: int | None = None
    extra: dict = field(default_factory=dict)


def parse_spec(raw: dict) -> SourceSpec:
    """A validated specification; ValueError says what is wrong."""
    kind = raw.get("kind")
    web = lambda u: isinstance(u, str) and re.match(r"^https?://[^/\s]+", u)
    every = raw.get("refresh")
    refresh = None
    if every is not None:
        m = re.fullmatch(r"([0-9]{1,12})([smhd]?)", str(every))
        refresh = int(m[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]] if m else 0
        if refresh <= 0:
            raise ValueError("refresh must be a positive duration")
    if kind == "path":
        if not raw.get("root"):
            raise ValueError("a path source needs a root")
        return SourceSpec("path", root=raw["root"], include=tuple(raw["include"]) if "include" in raw else None, exclude=tuple(raw["exclude"]) if "exclude" in raw else None, refresh=refresh)
    if kind == "url":
        urls = tuple(raw.get("urls") or ([raw["url"]] if raw.get("url") else []))
        if not urls or not all(map(web, urls)):
            raise ValueError("a url source needs http or https urls")
        return SourceSpec("url", urls=urls, refresh=refresh)
    if kind == "feed":
        if not web(raw.get("url")):
            raise ValueError("a feed source needs an http or https url")
        most = raw.get("max_entries")
        if most is not None and not (isinstance(most, int) and 1 <= most < 1 << 32):
            raise ValueError("max_entries must be from 1 to 4294967295")
        if raw.get("mode", "discovery") not in ("discovery", "single"):
            raise ValueError("mode must be discovery or single")
        return SourceSpec("feed", urls=(raw["url"],), max_entries=most, mode=raw.get("mode", "discovery"), refresh=refresh)
    raise ValueError(f"unknown kind {kind!r}")
