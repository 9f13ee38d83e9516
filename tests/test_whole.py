"""Queries over the whole of their input, where the ones of older SQL take a part of it."""

import math
import re

from pyspark.sql import functions as F

from loamline.operators import retrieval
from loamline.plans import catalog
from loamline.sources import corpus

SF = "/root/testdata/sf0.01"


def test_search_takes_chunks_without_vector(spark):
    texts = ["cat", "cat and dog", "a dog", "cat cat dog"]
    rows = [("s", f"c{k}", f"r{k}", "src", f"doc://{k}", "text/plain", "2026-01-01T00:00:00Z", t, [1.0, 0.0] if k == 2 else None) for k, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "store_id string, chunk_id string, resource_id string, source_id string, uri string, mime string, fetched_at string, text string, embedding array<double>")
    got = {r["chunk_id"]: r["scores"] for r in retrieval.search(chunks, "cat", [1.0, 0.0]).collect()}
    assert set(got) == {"c0", "c1", "c2", "c3"} and {k for k, s in got.items() if s["dense"] is not None} == {"c2"}
    # Without a vector a chunk has no rank in the dense leg.
    assert all(s["fused"] <= 1 / 61 + 1e-12 for s in got.values())


def test_flagship_searches_all_documents(spark):
    held = {r["vec_id"] for r in corpus.table(spark, SF, "embeddings").select("vec_id").collect()}
    want = {(r["store_id"], r["chunk_id"]): r["score"] for r in retrieval.bm25_scores(corpus.chunks(spark, SF), catalog.QUERY).collect()}
    hits = catalog.flagship(spark, SF).select("store_id", "chunk_id", F.col("scores.bm25").alias("bm25"), F.regexp_extract("provenance.uri", "[0-9]+$", 0).cast("long").alias("id")).collect()
    assert any(h["id"] not in held for h in hits)
    assert all(math.isclose(h["bm25"], want[h["store_id"], h["chunk_id"]], rel_tol=1e-9) for h in hits if h["bm25"] is not None)


def test_keywords_and_uris_of_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in corpus.table(spark, SF, "documents").select("doc_id", "text").collect()}
    words = {r["doc_id"]: r["keywords"] for r in catalog.queries()["X20_keywords_whole"](spark, SF).collect()}
    assert len(words) == len(texts) and any(len(t) > 200 for t in texts.values())
    # Of ASCII texts only, where Python and Spark agree on blanks.
    assert all(words[k] == "|".join(w for w in (x.strip(" ") for x in re.split("[,;]", t)) if w) for k, t in texts.items() if t and t.isascii() and not re.search(r"[\t\n\r\x0b\x0c\x1c-\x1f]", t))
    shown = {r["doc_id"]: r["shown"] for r in catalog.queries()["fn_display_uri_whole"](spark, SF).collect()}
    assert all(shown[k] == f"https://e.example/{t}+x" for k, t in texts.items() if t and t.isascii() and t.isprintable())


def test_every_address_is_judged(spark, tmp_path):
    texts = {0: "10.0.0.1 then 8.8.8.8 then 300.1.1.1 and 8.8.8.8", 1: "none", 2: None, 3: "1.1.1.1"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.queries()["S18_globally_routable_all"](spark, str(tmp_path)).select("doc_id", "ip", "routable").collect()))
    assert got == [(0, "10.0.0.1", False), (0, "300.1.1.1", False), (0, "8.8.8.8", True), (0, "8.8.8.8", True), (3, "1.1.1.1", True)]
    # One row for each address of the tables, not one for each document.
    pattern = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
    hits = sum(len(re.findall(pattern, r["text"] or "")) for r in corpus.table(spark, SF, "documents").select("text").collect())
    assert catalog.queries()["S18_globally_routable_all"](spark, SF).count() == hits > catalog.queries()["S18_globally_routable"](spark, SF).count()
