"""Feeds: parsing RSS, Atom and JSON feeds into entries, and the plan from entries to documents."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRY = (
    "feed string, feed_title string, feed_description string, feed_authors array<struct<name:string,email:string>>, ordinal int, id string, title string, "
    "links array<struct<href:string,rel:string>>, authors array<struct<name:string,email:string>>, published string, updated string, content string, summary string, status string"
)
#: Fixed value: a name that stands for no name.
PLACEHOLDER = "author"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _iso(value: str | None) -> str | None:
    if not value or not value.strip():
        return None
    try:
        return parsedate_to_datetime(value).astimezone().strftime("%Y-%m-%dT%H:%M:%SZ") if value.strip()[:1].isalpha() else value.strip()
    except (TypeError, ValueError):
        return value.strip()


def _text(node: ET.Element, *names: str) -> str | None:
    for name in names:
        for kid in node:
            if _local(kid.tag) == name:
                inner = "".join(kid.itertext()).strip()
                if inner:
                    return inner
    return None


def _people(node: ET.Element) -> list[dict]:
    out = []
    for kid in node:
        if _local(kid.tag) in ("author", "creator", "managingeditor"):
            name, email = _text(kid, "name"), _text(kid, "email")
            out.append({"name": name or (None if email else (kid.text or "").strip() or None), "email": email})
    return [p for p in out if p["name"] or p["email"]]


def parse_feed(body: str) -> tuple[dict, list[dict]]:
    """The feed's title, description and authors, and its entries in document order; ValueError if it is no feed."""
    if body.lstrip()[:1] == "{":
        raw = json.loads(body)
        people = lambda x: [{"name": a.get("name"), "email": None} for a in x.get("authors") or ([x["author"]] if x.get("author") else [])]
        entries = [
            {
                "id": e.get("id"), "title": e.get("title"), "links": [{"href": e[k], "rel": None} for k in ("url", "external_url") if e.get(k)], "authors": people(e),
                "published": e.get("date_published"), "updated": e.get("date_modified"), "content": e.get("content_html") or e.get("content_text"), "summary": e.get("summary"),
            }
            for e in raw.get("items", [])
        ]
        return {"title": raw.get("title"), "description": raw.get("description"), "authors": people(raw)}, entries
    try:
        root = ET.fromstring(body)
    except ET.ParseError as e:
        raise ValueError(str(e)) from e
    if _local(root.tag) not in ("rss", "feed", "rdf"):
        raise ValueError("not a feed")
    channel = next((k for k in root if _local(k.tag) == "channel"), root)
    items = [k for parent in {id(channel): channel, id(root): root}.values() for k in parent if _local(k.tag) in ("item", "entry")]

    def links(node: ET.Element) -> list[dict]:
        found = [k for k in node if _local(k.tag) == "link"]
        return [{"href": (k.get("href") or k.text or "").strip(), "rel": k.get("rel")} for k in found if (k.get("href") or k.text or "").strip()]

    entries = [
        {
            "id": _text(k, "id", "guid"), "title": _text(k, "title"), "links": links(k), "authors": _people(k), "published": _iso(_text(k, "published", "pubdate", "date")),
            "updated": _iso(_text(k, "updated")), "content": _text(k, "content", "encoded"), "summary": _text(k, "summary", "description"),
        }
        for k in items
    ]
    return {"title": _text(channel, "title"), "description": _text(channel, "description", "subtitle"), "authors": _people(channel)}, entries


def entries(feeds: DataFrame) -> DataFrame:
    """The entries of feeds (url, body); a body that is no feed gives one row with status error and no entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in ENTRY.replace("array<struct<name:string,email:string>>", "a").replace("array<struct<href:string,rel:string>>", "a").split(", ")]
        for batch in batches:
            rows = []
            for url, body in zip(batch["url"], batch["body"], strict=True):
                try:
                    feed, found = parse_feed(body or "")
                    head = [url, feed["title"], feed["description"], feed["authors"]]
                    rows += [[*head, k, *(e[c] for c in ("id", "title", "links", "authors", "published", "updated", "content", "summary")), "ok"] for k, e in enumerate(found)]
                except Exception:  # one bad feed must not stop the others
                    rows.append([url, None, None, [], None, None, None, [], [], None, None, None, None, "error"])
            yield pd.DataFrame(rows, columns=columns)

    return feeds.select("url", "body").mapInPandas(run, ENTRY)


def entry_uri(feed: Column, entry_id: Column, links: Column) -> Column:
    """The first link that is the entry itself (no rel, or alternate), else a synthetic URI of the feed and the entry's id."""
    own = F.filter(links, lambda x: x["rel"].isNull() | (x["rel"] == "alternate"))
    return F.coalesce(F.get(own, F.lit(0))["href"], F.concat(feed, F.lit("#entry:"), entry_id))


def fetchable(uri: Column) -> Column:
    return uri.rlike("(?i)^https?://") & ~F.contains(uri, F.lit("#entry:"))


def inherited_authors(own: Column, feeds: Column) -> Column:
    """Names of the entry's authors, else of the feed's; the placeholder name gives way to the address."""
    chosen = F.when(F.size(own) > 0, own).otherwise(feeds)
    names = F.transform(chosen, lambda a: F.when(F.lower(F.trim(a["name"])) == PLACEHOLDER, a["email"]).otherwise(F.coalesce(a["name"], a["email"])))
    return F.filter(names, lambda x: x.isNotNull() & (x != ""))


def newest(rows: DataFrame, max_entries: int | None = None) -> DataFrame:
    """One row for each feed and URI, the newest; of these the max_entries newest of each feed, with position (from 0).

    Newest by published, else updated time; rows without either come last; equal ones stay in document order.
    """
    when = F.coalesce("published", "updated")
    order = [when.desc_nulls_last(), F.col("ordinal")]
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy("feed", "uri").orderBy(*order))).filter("__r = 1").drop("__r")
    out = first.withColumn("position", F.row_number().over(Window.partitionBy("feed").orderBy(*order)) - 1)
    return out if max_entries is None else out.filter(F.col("position") < max_entries)


def fallback_body(outcome: Column, fetched: Column, content: Column, summary: Column, title: Column) -> Column:
    """What an entry's document holds: the fetched page if it was indexed; on a lasting failure the entry's own content, summary or title; null after a passing error."""
    clean = lambda x: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]*>", " "), r"\s+", " ")), F.lit(""))
    own = F.coalesce(clean(content), clean(summary), clean(title))
    return F.when(outcome.isin("Indexed", "Unchanged"), fetched).when(outcome.isin("Gone", "Unsupported", "Empty", "Blocked"), own)


def single_document(rows: DataFrame) -> DataFrame:
    """feed, markdown: one document for each feed, with its title, description and a section for each entry in order of position."""
    byline = F.nullif(F.concat_ws(" · ", F.nullif(F.array_join("names", ", "), F.lit("")), F.coalesce("published", "updated")), F.lit(""))
    section = F.concat_ws("\n\n", F.concat(F.lit("## "), F.coalesce("title", F.lit("Untitled"))), F.when(byline.isNotNull(), F.concat(F.lit("*"), byline, F.lit("*"))), "entry_body")
    parts = rows.groupBy("feed").agg(F.min("feed_title").alias("t"), F.min("feed_description").alias("d"), F.array_sort(F.collect_list(F.struct("position", section.alias("s")))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: x["s"]), "\n\n")
    return parts.select("feed", F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("t", F.col("feed"))), "d", body).alias("markdown"))


def resolved(found: DataFrame) -> DataFrame:
    """The entries that entries() gives with uri, names (of authors) and fetchable; rows without an entry are left out."""
    rows = found.filter("status = 'ok'").withColumn("uri", entry_uri(F.col("feed"), F.col("id"), F.col("links"))).filter("uri IS NOT NULL")
    return rows.withColumns({"names": inherited_authors(F.col("authors"), F.col("feed_authors")), "fetchable": fetchable(F.col("uri"))})


def own_documents(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Parsed documents (as of extract.parse_documents) that entries make of their own content, where their pages lastingly give none or they have none to fetch.

    outcomes (uri, outcome) are those of fetched pages. An entry with nothing of its own is empty.
    """
    told = rows.join(outcomes.select("uri", "outcome"), "uri", "left").withColumn("told", F.when(~F.col("fetchable"), "Gone").otherwise(F.col("outcome")))
    own = fallback_body(F.col("told"), F.lit(None).cast("string"), F.col("content"), F.col("summary"), F.col("title"))
    lasting = told.filter("told IN ('Gone', 'Unsupported', 'Empty', 'Blocked')").withColumn("markdown", own)
    meta = F.map_from_entries(F.filter(F.array(F.struct(F.lit("dc.creator").alias("k"), F.nullif(F.array_join("names", "; "), F.lit("")).alias("v")), F.struct(F.lit("dc.source").alias("k"), F.col("feed").alias("v"))), lambda x: x["v"].isNotNull()))
    return lasting.select("uri", F.when(F.col("markdown").isNull(), "empty").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit("feed").alias("parser"), F.coalesce("markdown", F.lit("")).alias("markdown"), "title", meta.alias("meta"))


def one_document(rows: DataFrame) -> DataFrame:
    """A parsed document for each feed, of all its entries' own content; its uri is the feed's."""
    body = fallback_body(F.lit("Gone"), F.lit(None).cast("string"), F.col("content"), F.col("summary"), F.lit(None).cast("string"))
    made = single_document(rows.withColumn("entry_body", body))
    titles = rows.groupBy("feed").agg(F.min("feed_title").alias("title"))
    return made.join(titles, "feed").select(F.col("feed").alias("uri"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit("feed").alias("parser"), "markdown", F.coalesce("title", "feed").alias("title"), F.create_map(F.lit("dc.source"), F.col("feed")).alias("meta"))
