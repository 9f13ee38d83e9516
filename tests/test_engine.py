"""The public interface from files to citations, and fetching without a network."""

import io
import urllib.error
from email.message import Message

import pytest

from loamline.engine import Engine
from loamline.operators import embedding, maintenance
from loamline.operators.retrieval import RetrievalError
from loamline.sources import fetch


def test_engine(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "cats.md").write_text("# Cats\n\nA cat sleeps in the warm sun all day.")
    (notes / "dogs.md").write_text("# Dogs\n\nA dog barks at the postman.\n\n## Food\n\nDogs eat bones.")
    (notes / "blank.md").write_text("\n")
    (notes / "scan.pdf").write_bytes(b"%PDF-1.4")
    engine = Engine(spark, str(tmp_path / "root"))
    store = engine.add_store("notes")
    with pytest.raises(RetrievalError):
        engine.add_store("notes")
    with pytest.raises(RetrievalError):
        engine.add_store("a/b")
    spec = {"kind": "path", "root": str(notes)}
    assert engine.index("notes", spec) == {"indexed": 2, "skipped": 1, "unsupported": 1, "errors": 0, "deleted": 0, "docs_prunable": 0}
    assert engine.index("notes", spec)["skipped"] == 3
    hits = engine.search("cat sun", ["notes"]).orderBy("position").collect()
    assert hits[0]["provenance"]["uri"].endswith("cats.md") and "warm sun" in hits[0]["excerpt"] and hits[0]["scores"]["bm25"] > 0
    with pytest.raises(RetrievalError):
        engine.search("cat", ["other"])
    dogs = next(r for r in engine.list_documents(store).collect() if r["uri"].endswith("dogs.md"))
    assert engine.get_document(dogs["resource_id"]).first()["text"] == "Dogs\n\nA dog barks at the postman.\n\nFood\n\nDogs eat bones."
    page = engine.get_chunks(dogs["resource_id"], anchor_block_seq=2, limit=3).orderBy("pos").collect()
    assert [r["anchor_index"] for r in page] == [1, 1, 1] and len(page) == 3
    with pytest.raises(RetrievalError, match="no chunk"):
        engine.get_chunks(dogs["resource_id"], anchor_chunk_id="zz")

    (notes / "dogs.md").unlink()
    (notes / "cats.md").write_text("# Cats\n\nCats purr.")
    assert engine.index("notes", spec)["docs_prunable"] == 1 and engine.list_documents("notes").count() == 2
    assert engine.index("notes", spec, prune=True)["deleted"] == 1 and engine.list_documents("notes").count() == 1
    assert engine.search("purr").count() >= 1 and not any("warm sun" in r["excerpt"] for r in engine.search("cats").collect())
    status = engine.status()
    assert status["stores"][0]["document_count"] == 1 and status["bytes"] > 0 and status["stale_stores"] == []
    page = spark.createDataFrame([("https://e.example/a", "<title>T</title><p>url text here</p>", 200), ("https://e.example/b", None, 404)], "url string, html string, status int")
    assert engine.index("notes", {"kind": "url", "urls": ["https://e.example/a", "https://e.example/b"]}, pages=page)["indexed"] == 1
    assert engine.delete_document("notes", engine.list_documents("notes").filter("uri like 'https%'").first()["resource_id"]) >= 1
    engine.delete_store("notes")
    assert engine.list_stores().count() == 0 and engine.tables.read("chunks").count() == 0


class Answer(io.BytesIO):
    headers = {"ETag": "e1"}


def error(code, **headers):
    m = Message()
    for k, v in headers.items():
        m[k.replace("_", "-")] = v
    return urllib.error.HTTPError("u", code, "x", m, None)


def test_fetch():
    def play(*steps):
        left, seen, naps = list(steps), [], []

        def opener(request):
            seen.append(dict(request.headers))
            step = left.pop(0)
            if isinstance(step, Exception):
                raise step
            return step

        return fetch.fetch("https://e.example/x", etag="e0", opener=opener, sleep=naps.append), seen, naps

    got, seen, _ = play(Answer(b"hi"))
    assert (got.outcome, got.body, got.etag) == ("Fetched", b"hi", "e1") and seen[0] == {"If-none-match": "e0"}
    assert [play(error(c))[0].outcome for c in (304, 404, 410, 403, 400)] == ["Unchanged", "Gone", "Gone", "Blocked", "FetchError"]
    got, _, naps = play(error(429, Retry_After="7"), error(503), Answer(b"ok"))
    assert got.outcome == "Fetched" and naps[0] == 7 and 0.5 <= naps[1] <= 1.5
    assert play(error(429), error(429), error(429))[0].outcome == "RateLimited" and play(OSError("x"), OSError("x"), OSError("x"))[0].outcome == "FetchError"
    assert fetch.fetch("https://h/", opener=None, guard=lambda h: False).outcome == "Blocked"
    resolve = lambda ip: lambda *_: [(0, 0, 0, "", (ip, 0))]
    assert fetch.routable_host("h", resolve("8.8.8.8")) and not fetch.routable_host("h", resolve("10.0.0.1")) and not fetch.routable_host("h", resolve("::1"))


def test_pacer():
    now, naps = [0.0], []
    pacer = fetch.Pacer(1.0, 2, clock=lambda: now[0], sleep=naps.append)
    assert [pacer.wait("a") for _ in range(3)] == [0, 0, 1.0] and pacer.wait("b") == 0


def test_batched_provider():
    provider = embedding.batched(lambda texts: [(k, [float(len(t))]) for k, t in reversed(list(enumerate(texts)))], 2)
    assert provider([["a", "bb"], ["ccc"]]) == [[[1.0], [2.0]], [[3.0]]]
    with pytest.raises(ValueError):
        embedding.batched(lambda texts: [], 2)([["a"]])
    with pytest.raises(ValueError):
        embedding.embed_query("x", lambda documents: [])


def test_stores_that_share_documents(spark, tmp_path):
    """Replacing, pruning and deleting in one store leave the other alone, and every store change has its own manifest."""
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# One\n\nalpha text about rivers")
    (folder / "b.md").write_text("# Two\n\nbeta text about bridges")
    engine = Engine(spark, str(tmp_path / "root"))
    spec = {"kind": "path", "root": str(folder)}
    for name in ("one", "two"):
        engine.add_store(name)
        assert engine.index(name, spec)["indexed"] == 2
    counts = lambda: {r["name"]: (r["document_count"], r["chunk_count"]) for r in engine.list_stores().collect()}
    before = counts()
    (folder / "b.md").unlink()
    (folder / "a.md").write_text("# One\n\nalpha text about mountains")
    assert engine.index("one", spec, prune=True)["deleted"] == 1
    assert counts()["two"] == before["two"] and counts()["one"][0] == 1
    said = lambda name: engine.search("rivers", stores=[name]).filter("scores.bm25 IS NOT NULL").count()
    assert said("two") == 1 and said("one") == 0
    chunk = engine.tables.read("chunks").filter(f"store_id = '{engine.store_id('two')}'").first()
    assert engine.get_chunk("two", chunk["chunk_id"]).count() == 1 and engine.get_chunk("one", chunk["chunk_id"]).count() <= 1 and engine.get_chunk("two", "none").count() == 0
    assert [b["seq"] for b in engine.get_blocks(chunk["resource_id"], "two").collect()] == [0, 1]
    source = engine.list_sources("one").first()["source_id"]
    assert engine.delete_source("one", source) and not engine.delete_source("one", source)
    assert counts()["two"] == before["two"] and counts()["one"] == (0, 0)


def test_manifests(spark, tmp_path):
    """A draft that never got its number changes nothing; of two writers from one state the later fails."""
    root = str(tmp_path / "root")
    one, two = maintenance.Snapshots(spark, root), maintenance.Snapshots(spark, root)
    one.write({"t": spark.range(3)})
    (tmp_path / "root" / "manifests" / "draft-x").write_text("{")
    assert one.read("t").count() == 3
    state = two._current()
    one.write({"t": spark.range(5)})
    two._current = lambda: state
    with pytest.raises(OSError):
        two.write({"t": spark.range(7)})
    assert one.read("t").count() == 5 and one.vacuum() > 0 and one.read("t").count() == 5 and len(one._numbers()) == 1


def test_excerpts_end_at_sentences(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("Rivers run to the sea and carry sand with them. Then they rest for a while in wide valleys before they go on.")
    engine = Engine(spark, str(tmp_path / "root"))
    engine.add_store("one")
    engine.index("one", {"kind": "path", "root": str(folder)})
    assert engine.search("rivers", content_length=50).first()["excerpt"] == "Rivers run to the sea and carry sand with them."


def test_kept_index(spark, tmp_path):
    """The index follows every change, a search through it gives what the texts give, and a store without one is searched and mended."""
    folder = tmp_path / "docs"
    folder.mkdir()
    texts = {"a": "the river runs by the old mill", "b": "a mill by the sea", "c": "the sea, the sea-wind and the river mill"}
    for name, body in texts.items():
        (folder / f"{name}.md").write_text(f"# {name}\n\n{body}")
    engine = Engine(spark, str(tmp_path / "root"))
    for store in ("one", "two"):
        engine.add_store(store)
        engine.index(store, {"kind": "path", "root": str(folder)})
    found = lambda q, stores=None: [(r["position"], r["store_id"], r["chunk_id"], round(r["scores"]["fused"], 9), r["scores"]["bm25"] and round(r["scores"]["bm25"], 9)) for r in engine.search(q, stores).orderBy("position").collect()]
    read = lambda n: sorted(map(str, engine.tables.read(n).select("store_id", "resource_id", "chunk_id", "len", *(["term", "tf", "positions"] if n == "postings" else [])).collect()))

    def agrees():
        fresh = maintenance.with_index({"chunks": engine.tables.read("chunks")})
        assert read("lengths") == sorted(map(str, fresh["lengths"].select("store_id", "resource_id", "chunk_id", "len").collect()))
        assert read("postings") == sorted(map(str, fresh["postings"].select("store_id", "resource_id", "chunk_id", "len", "term", "tf", "positions").collect()))

    agrees()
    asked = [("mill", None), ("the sea", ["two"]), ("sea-wind river", None), ("sea sea", ["one"]), ("...", None)]
    through = [found(*x) for x in asked]
    full = engine.tables.manifest

    def without():
        state = full()
        return {**state, "tables": {n: t for n, t in state["tables"].items() if n not in ("postings", "lengths")}}

    engine.tables.manifest = without
    assert [found(*x) for x in asked] == through and any(x[-1] for x in through[0])
    engine.tables.manifest = full
    (folder / "b.md").write_text("# b\n\na lighthouse now")
    (folder / "a.md").unlink()
    engine.tables.manifest = without
    engine.index("one", {"kind": "path", "root": str(folder)}, prune=True)
    engine.tables.manifest = full
    agrees()
    engine.delete_document("one", engine.list_documents("one").filter("uri like '%c.md'").first()["resource_id"])
    agrees()
    assert engine.delete_source("one", engine.list_sources("one").first()["source_id"])
    agrees()
    engine.delete_store("two")
    assert engine.tables.read("postings").isEmpty() and engine.tables.read("lengths").isEmpty()


def test_changes_write_their_parts_only(spark, tmp_path):
    """Files of untouched parts stay in place; a whole store leaves without a write of rows; a stale state and a row of another store are errors."""
    folder = tmp_path / "docs"
    folder.mkdir()
    for k in range(30):
        (folder / f"{k}.md").write_text(f"# Title {k}\n\ntext number {k} about rivers")
    engine = Engine(spark, str(tmp_path / "root"))
    spec = {"kind": "path", "root": str(folder)}
    for name in ("one", "two"):
        engine.add_store(name)
        engine.index(name, spec)
    held = lambda: {(n, k): d for n in maintenance.OWNED for k, d in engine.tables.manifest()["tables"][n]["parts"].items()}
    before = held()
    assert engine.index("one", spec)["skipped"] == 30 and held() == before
    (folder / "3.md").write_text("# Title 3\n\nmountains")
    assert engine.index("one", spec)["indexed"] == 1
    after = held()
    changed = {key for key in {*before, *after} if before.get(key) != after.get(key)}
    assert 0 < len({k for _, k in changed}) <= 2 and all(k.startswith(engine.store_id("one")) for _, k in changed)
    lengths = engine.tables.read("lengths")
    assert engine.tables.lengths() == (lengths.count(), lengths.selectExpr("avg(len)").first()[0])
    assert engine.search("mountains", ["one"]).filter("scores.bm25 is not null").count() == 1 and engine.search("rivers", ["one"], limit=100).filter("scores.bm25 is not null").count() == 29
    since = engine.tables.number()
    engine.add_store("three")
    with pytest.raises(OSError):
        engine.tables.write({"stores": engine.stores()}, since=since)
    rows = engine.tables.read("resources")
    with pytest.raises(Exception, match="tenant mismatch"):
        maintenance.replace_resources(rows, spark.createDataFrame([], "action string, old_id string"), rows, engine.store_id("one")).collect()
    two = engine.store_id("two")
    one = {key: d for key, d in held().items() if not key[1].startswith(two)}
    engine.delete_store("two")
    assert held() == one and engine.tables.read("chunks").filter(f"store_id = '{two}'").isEmpty()
    assert engine.tables.vacuum(3600) == 0 and engine.tables.vacuum() > 0 and engine.search("mountains").count() >= 1
    assert held() == one and engine.tables.read("resources").count() == 30
