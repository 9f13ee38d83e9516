"""Files, feeds, specifications, change plans, snapshots and the file stream."""

import pytest
from pyspark.sql import functions as F

from loamline.operators import maintenance
from loamline.sources import feeds, files, web
from loamline.streaming import ingest

RSS = """<rss><channel><title>Feed</title><description>D</description><item><guid>1</guid><title>One</title><link>https://e.example/1</link><pubDate>Thu, 01 Jan 2026 00:00:00 +0000</pubDate><description>sum</description></item>
<item><guid>2</guid><title>Two</title><author>author</author></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><author><name>Ann</name></author><entry><id>x</id><title>X</title><link rel="self" href="https://e.example/self"/><link rel="alternate" href="https://e.example/x"/><updated>2026-01-02T00:00:00Z</updated></entry></feed>"""


def test_feeds(spark):
    head, entries = feeds.parse_feed(RSS)
    assert head["title"] == "Feed" and [e["id"] for e in entries] == ["1", "2"] and entries[0]["links"] == [{"href": "https://e.example/1", "rel": None}]
    assert feeds.parse_feed('{"title": "J", "items": [{"id": "1", "url": "https://e.example/j"}]}')[1][0]["links"][0]["href"] == "https://e.example/j"
    with pytest.raises(ValueError):
        feeds.parse_feed("<html/>")
    rows = feeds.entries(spark.createDataFrame([("f1", RSS), ("f2", ATOM), ("f3", "junk"), ("f4", None)], "url string, body string"))
    rows = rows.withColumn("uri", feeds.entry_uri(F.col("feed"), F.col("id"), F.col("links"))).cache()
    assert {(r["feed"], r["uri"], r["status"]) for r in rows.collect()} == {("f1", "https://e.example/1", "ok"), ("f1", "f1#entry:2", "ok"), ("f2", "https://e.example/x", "ok"), ("f3", None, "error"), ("f4", None, "error")}
    named = rows.filter("status = 'ok'").withColumn("names", feeds.inherited_authors(F.col("authors"), F.col("feed_authors")))
    assert {r["uri"]: r["names"] for r in named.collect()}["https://e.example/x"] == ["Ann"]
    doc = feeds.single_document(feeds.newest(named).withColumn("entry_body", F.col("summary"))).filter("feed = 'f1'").first()["markdown"]
    assert doc.startswith("# Feed\n\nD\n\n## One") and "sum\n\n## Two" in doc


def test_globs(spark):
    rows = spark.createDataFrame([(p,) for p in ("a.md", "x/a.md", "x/y/b.rs", ".git/a.md", "x/node_modules/b.md", "a.bin", "Cargo.lock")], "path string")
    pick = lambda *a: {r["path"] for r in rows.filter(files.selected(F.col("path"), *a)).collect()}
    assert pick() == {"a.md", "x/a.md", "x/y/b.rs", "Cargo.lock"} and pick(["*.md"], []) == {"a.md"} and pick(["**/*.md"], ["x"]) == {"a.md", ".git/a.md"} and pick(["x/**"], ["y"]) == {"x/a.md", "x/node_modules/b.md"}
    assert {r["path"]: r["m"] for r in rows.withColumn("m", files.stored_mime(F.col("path"))).collect()}["x/y/b.rs"] == "text/x-rust"


def test_enumeration(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "d" / "b.txt").write_text("b")
    (tmp_path / "c.bin").write_bytes(b"\0")
    assert {r["path"] for r in files.enumerate_files(spark, str(tmp_path)).collect()} == {"a.md", "d/b.txt"}
    assert [r["path"] for r in files.enumerate_files(spark, str(tmp_path / "a.md")).collect()] == ["a.md"]
    with pytest.raises(files.RootUnavailable):
        files.enumerate_files(spark, str(tmp_path / "none"))


def test_destinations(spark):
    ips = {"8.8.8.8": True, "10.1.1.1": False, "172.31.0.1": False, "172.32.0.1": True, "127.0.0.1": False, "192.168.1.1": False, "169.254.1.1": False, "255.1.1.1": False, "999.1.1.1": False, "x": False}
    rows = spark.createDataFrame([(x,) for x in ips], "ip string").withColumn("ok", web.globally_routable(F.col("ip")))
    assert {r["ip"]: r["ok"] for r in rows.collect()} == ips


def test_specs():
    assert web.parse_spec({"kind": "path", "root": "/x", "refresh": "24h"}).refresh == 86400 and web.parse_spec({"kind": "url", "url": "https://e.example"}).urls == ("https://e.example",)
    for bad in ({"kind": "path"}, {"kind": "url", "urls": ["ftp://x"]}, {"kind": "feed", "url": "https://e.example", "max_entries": 0}, {"kind": "x"}, {"kind": "path", "root": "/", "refresh": "0"}):
        with pytest.raises(ValueError):
            web.parse_spec(bad)


def test_nothing_seen_deletes_nothing(spark):
    current = spark.createDataFrame([("u1", "r1", "h", "p")], "uri string, resource_id string, content_hash string, policy_version string")
    seen = spark.createDataFrame([("u2", "h", "ok")], "uri string, content_hash string, status string")
    plan = lambda **kw: {(r["uri"], r["action"]) for r in maintenance.plan_changes(current, seen, None, "p", **kw).collect()}
    assert plan(prune=True) == {("u2", "insert")}
    both = seen.unionByName(spark.createDataFrame([("u1", "h2", "ok")], seen.schema))
    assert {(r["uri"], r["action"]) for r in maintenance.plan_changes(current, both, None, "p").collect()} == {("u2", "insert"), ("u1", "replace")}


def test_snapshots(spark, tmp_path):
    store = maintenance.Snapshots(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("s", "a", 1)], "store_id string, resource_id string, n int")
    store.write({"resources": rows})
    store.write({"resources": maintenance.upsert(store.read("resources"), spark.createDataFrame([("s", "a", 2), ("s", "b", 3)], rows.schema), ["store_id", "resource_id"])})
    assert {(r["resource_id"], r["n"]) for r in store.read("resources").collect()} == {("a", 2), ("b", 3)}
    assert store.vacuum() > 0 and store.read("resources").count() == 2 and store.sizes().count() == 1


def test_file_stream(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    store = maintenance.Snapshots(spark, str(tmp_path / "store"))

    def go():
        ingest.watch(spark, str(folder), store, str(tmp_path / "cp"), "s", "src", "p1", progress=lambda k, n: seen.append(n)).awaitTermination()
        return {r["uri"].rsplit("/", 1)[1]: r["title"] for r in store.read("resources").collect()}

    (folder / "a.md").write_text("# A\n\nbody")
    (folder / "e.md").write_text(" ")
    assert go() == {"a.md": "A"}
    (folder / "b.md").write_text("# B\n\nmore")
    assert go() == {"a.md": "A", "b.md": "B"} and seen == [2, 1] and store.read("chunks").count() >= 4
