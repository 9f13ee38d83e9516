"""Urls and feeds through the engine: outcomes, validators, fallbacks, and entries as a stream."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loamline.engine import Engine
from loamline.operators import maintenance
from loamline.operators.retrieval import RetrievalError
from loamline.sources import crawl, feeds
from loamline.streaming import feed_entries

PAGES = "url string, status int, body string, etag string, blocked boolean"
U = "https://e.example/"


def pages(spark, rows):
    return spark.createDataFrame([(u, s, b, e, x) for u, s, b, e, x in rows], PAGES)


def test_every_outcome_and_what_it_leaves(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "root"))
    engine.add_store("web")
    names = ["same", "304", "404", "403", "refused", "503", "none", "pdf", "blank", "changed"]
    spec = {"kind": "url", "urls": [U + n for n in names]}
    first = pages(spark, [(U + n, 200, f"<title>{n}</title><p>words of {n}</p>", "e-" + n, False) for n in names])
    with pytest.raises(RetrievalError, match="fetcher"):
        engine.index("web", spec)
    assert engine.index("web", spec, pages=first)["indexed"] == len(names)
    again = [("same", 200, "<title>same</title><p>words of same</p>"), ("304", 304, None), ("404", 404, None), ("403", 403, None), ("refused", None, None), ("503", 503, None), ("none", None, None), ("pdf", 200, "%PDF-1.4"), ("blank", 200, "<p> </p>"), ("changed", 200, "<p>other words</p>")]
    second = pages(spark, [(U + n, s, b, "f-" + n, n == "refused") for n, s, b in again] + [(U + "foreign", 404, None, None, False), (None, 200, "x", None, False)])
    counts = engine.index("web", spec, pages=second)
    assert counts == {"indexed": 1, "skipped": 5, "unsupported": 1, "errors": 2, "deleted": 0, "docs_prunable": 1}
    wanted = {"same": "Unchanged", "304": "Unchanged", "404": "Gone", "403": "Blocked", "refused": "Blocked", "503": "FetchError", "none": "FetchError", "pdf": "Unsupported", "blank": "Empty", "changed": "Indexed"}
    assert {r["uri"].removeprefix(U): r["outcome"] for r in engine.fetch_outcomes("web").collect()} == wanted
    assert engine.list_documents("web", limit=50).count() == len(names)
    assert {r["uri"].removeprefix(U): r["etag"] for r in crawl.requests(second.select("url").dropna(), engine.tables.read("fetches")).withColumnRenamed("url", "uri").collect() if r["etag"]} == {n: ("f-" if n in ("same", "304", "changed") else "e-") + n for n in names if n != "404"}
    assert engine.index("web", spec, prune=True, pages=second)["deleted"] == 1
    # A deleted document comes back with the next fetch, though its body is the same.
    gone = engine.list_documents("web", limit=50).filter(F.col("uri") == U + "changed").first()["resource_id"]
    engine.delete_document("web", gone)
    assert engine.index("web", spec, pages=second)["indexed"] == 1


def test_responses_of_one_url_and_odd_columns(spark):
    rows = spark.createDataFrame([("a", "<p>1", "2026-01-01"), ("a", "<p>2", "2026-01-02"), ("a", "<p>2", "2026-01-02"), ("b", None, None), (None, "x", None)], "url string, html string, fetched_at string")
    got = {r["url"]: (r["status"], r["body"]) for r in crawl.responses(rows).collect()}
    assert got == {"a": (200, bytearray(b"<p>2")), "b": (200, None)}
    assert crawl.responses(rows.limit(0)).count() == 0


def test_fetcher_gets_validators(spark, tmp_path):
    def fetcher(url, etag=None, modified=None, pacer=None):
        from loamline.sources.fetch import Fetched

        if url.endswith("bad"):
            raise RuntimeError("no")
        return Fetched("Unchanged", etag=etag) if etag == "v1" else Fetched("Fetched", b"<p>text of " + url.encode() + b"</p>", "v1")

    engine = Engine(spark, str(tmp_path / "root"))
    engine.add_store("web")
    spec = {"kind": "url", "urls": [U + "a", U + "bad"]}
    got = [engine.index("web", spec, fetcher=fetcher) for _ in range(2)]
    assert [(g["indexed"], g["skipped"], g["errors"]) for g in got] == [(1, 0, 1), (0, 1, 1)]


def feed(entries):
    return json.dumps({"title": "News", "items": [{"id": i, "url": u, "title": t, "content_html": c, "date_modified": d} for i, u, t, c, d in entries]})


def test_feed_source(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "root"))
    engine.add_store("web")
    body = feed([("1", U + "1", "One", "<p>own words of one</p>", "2026-01-01"), ("2", U + "2", "Two", "own words of two", "2026-01-03"), ("3", None, "Three", "own words of three", "2026-01-02"), ("4", U + "4", "Four", "own four", None), ("5", U + "2", "Older two", "older", "2025-01-01")])
    got = pages(spark, [(U + "feed", 200, body, None, False), (U + "1", 200, "<p>page of one</p>", "e", False), (U + "2", 410, None, None, False), (U + "4", 503, None, None, False)])
    counts = engine.index("web", {"kind": "feed", "url": U + "feed"}, pages=got)
    assert (counts["indexed"], counts["errors"]) == (3, 1)
    texts = {r["uri"]: engine.get_document(r["resource_id"]).first()["text"] for r in engine.list_documents("web").collect()}
    assert texts == {U + "1": "page of one", U + "2": "own words of two", U + "feed#entry:3": "own words of three"}
    again = engine.index("web", {"kind": "feed", "url": U + "feed"}, pages=got)
    assert (again["indexed"], again["deleted"], again["docs_prunable"]) == (0, 0, 0)
    engine.add_store("one")
    assert engine.index("one", {"kind": "feed", "url": U + "feed", "mode": "single", "max_entries": 2}, pages=got)["indexed"] == 1
    text = engine.get_document(engine.list_documents("one").first()["resource_id"]).first()["text"]
    assert "own words of two" in text and "own words of three" in text and "own words of one" not in text
    bad = engine.index("web", {"kind": "feed", "url": U + "feed"}, pages=pages(spark, [(U + "feed", 200, "no feed", None, False)]))
    assert bad["deleted"] == bad["docs_prunable"] == 0 and engine.list_documents("web").count() == 3


def test_entries_of_many_batches_give_the_newest(spark, tmp_path):
    """Late, repeated and replayed versions in several batches, against a plain maximum; a second query over the same files changes nothing."""
    rng, folder = random.Random(7), tmp_path / "in"
    os.makedirs(folder)
    schema, best = "feed string, uri string, published string, updated string, ordinal int, title string", {}
    for k in range(3):
        rows = []
        for _ in range(60):
            when = rng.choice([None, f"2026-01-{rng.randint(1, 28):02}"])
            rows.append((rng.choice(["f", "g"]), rng.choice(["u1", "u2", "u3", "u4", None]), when, rng.choice([None, "2026-01-15"]), rng.choice([None, 0, 1, 2]), f"t{rng.randint(0, 1)}"))
        rows += rows[:20]
        for f, u, p, d, o, _ in rows:
            if u:
                rank = ((p or d) is not None, p or d or "", -o if o is not None else -(2**62))
                best[f, u] = max(best.get((f, u), rank), rank)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    store = maintenance.Snapshots(spark, str(tmp_path / "root"))
    for k in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        query = feed_entries.follow(stream, store, "s", str(tmp_path / f"checkpoint{k}"))
        query.awaitTermination()
        got = store.read("entries").collect()
        assert {(r["feed"], r["uri"]): (r["dated"], r["at"], r["back"]) for r in got} == best and len(got) == len(best)
        if k:
            assert sorted(map(str, got)) == before
        before = sorted(map(str, got))
    with pytest.raises(ValueError, match="processingTime"):
        feed_entries.follow(stream, store, "s", str(tmp_path / "c"), expiry=5)


def test_followed_feeds_become_documents(spark, tmp_path):
    folder = tmp_path / "in"
    engine = Engine(spark, str(tmp_path / "root"))
    engine.add_store("web")
    put = lambda rows: spark.createDataFrame([(U + "feed", feed(rows))], "url string, body string").coalesce(1).write.mode("append").parquet(str(folder))

    def run():
        stream = spark.readStream.schema("url string, body string").option("maxFilesPerTrigger", 1).parquet(str(folder))
        engine.follow_feeds("web", stream, str(tmp_path / "checkpoint")).awaitTermination()
        return {r["uri"]: engine.get_document(r["resource_id"]).first()["text"] for r in engine.list_documents("web").collect()}

    put([("1", U + "1", "One", "first words", "2026-01-02"), ("2", U + "2", "Two", "second words", "2026-01-02")])
    assert run() == {U + "1": "first words", U + "2": "second words"}
    put([("1", U + "1", "One", "late words", "2026-01-01"), ("2", U + "2", "Two", "newer words", "2026-01-05")])
    assert run() == {U + "1": "first words", U + "2": "newer words"}
    assert feeds.newest(engine.tables.read("entries").select("feed", "uri", "published", "updated", "ordinal")).count() == 2
