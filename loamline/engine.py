"""The public interface: named stores over one root, indexed from sources and answered by search and reading calls.

    engine = Engine(spark, "/data/loam")
    engine.add_store("notes")
    engine.index("notes", {"kind": "path", "root": "/data/notes"})
    engine.search("how to prune", limit=5).show()

Results are DataFrames; errors are RetrievalError with a stable code.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions import ids, text
from loamline.operators import embedding, maintenance, reading, registry, retrieval
from loamline.operators.retrieval import Filters, RetrievalError
from loamline.session import ship
from loamline.sources import crawl, feeds, files, web
from loamline.streaming import feed_entries, ingest

STORES = "store_id string, name string, visibility string, policy_version string, created_at string"
SOURCES = "source_id string, store_id string, kind string, root string, url string, refresh long, refreshed_at long, created_at string"
EXCERPT = 400


def _now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


class Engine:
    def __init__(self, spark: SparkSession, root: str, provider: embedding.Provider | None = None, model: str = "rolling-hash"):
        self.spark, self.tables = ship(spark), maintenance.Snapshots(spark, root)
        self.provider = provider or embedding.rolling_hash()
        self.policy = ids.policy_version("native", {}, model, "local", ["pdf", "epub", "office", "csv", "html", "markdown", "plaintext"])

    # --- registry ---

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.tables.read(name) if name in self.tables.manifest()["tables"] else self.spark.createDataFrame([], schema)

    def stores(self) -> DataFrame:
        return self._table("stores", STORES)

    def sources(self) -> DataFrame:
        return self._table("sources", SOURCES)

    def add_store(self, name: str, visibility: str = "private") -> str:
        """The id of a new store. The name must be valid and free."""
        if not self.spark.range(1).select(text.valid_store_name(F.lit(name)).alias("ok")).first()["ok"]:
            raise RetrievalError("invalid_request", f"{name!r} is no store name")
        row = (registry.ulid(), name, visibility, self.policy, _now())
        self.tables.write({"stores": registry.upsert_store(self.stores(), self.spark.createDataFrame([row], STORES))})
        return row[0]

    def store_id(self, name_or_id: str) -> str:
        return retrieval.resolve_stores(self.stores(), [name_or_id])[0]

    def delete_store(self, name_or_id: str) -> None:
        """The store goes, with its sources, documents, blocks and chunks."""
        store = self.store_id(name_or_id)
        have = self.tables.manifest()["tables"]
        small = {n: self._table(n, schema).filter(F.col("store_id") != store) for n, schema in (("stores", STORES), ("sources", SOURCES), ("fetches", crawl.FETCHES)) if n in have}
        if self.tables.parted(maintenance.OWNED):
            self.tables.forget(store, small)
            return
        gone = self.spark.createDataFrame([(store,)], "store_id string")
        self.tables.write(maintenance.cascade({n: self.tables.read(n) for n in have}, stores=gone))

    def delete_document(self, name_or_id: str, resource_id: str) -> int:
        """How many chunks went with the document."""
        gone = reading.find_document(self.tables.read("resources"), resource_id, [self.store_id(name_or_id)]).select("store_id", "resource_id")
        parts = {r["part"] for r in gone.select(maintenance.part_key().alias("part")).collect()} if self.tables.parted(maintenance.OWNED) else None
        n = self.tables.read("chunks", parts=parts).join(gone, ["store_id", "resource_id"], "left_semi").count()
        have = self.tables.manifest()["tables"]
        self.tables.write({t: self.tables.read(t, parts=parts).join(gone, ["store_id", "resource_id"], "left_anti") for t in maintenance.OWNED if t in have}, parts=parts)
        return n

    def delete_source(self, name_or_id: str, source_id: str) -> bool:
        """Whether the store had the source; it goes with its documents, blocks and chunks."""
        gone = self.sources().filter((F.col("store_id") == self.store_id(name_or_id)) & (F.col("source_id") == source_id))
        if gone.isEmpty():
            return False
        names = ("sources", *maintenance.OWNED)
        have = [n for n in self.tables.manifest()["tables"] if n in names]
        none = self.spark.createDataFrame([], "store_id string, resource_id string, source_id string")
        left = maintenance.cascade({n: self.tables.read(n) if n in have else none for n in names}, sources=gone)
        self.tables.write({n: left[n] for n in have})
        return True

    # --- indexing ---

    def index(self, name_or_id: str, spec: dict, prune: bool = False, pages: DataFrame | None = None, fetcher=None) -> dict:
        """Bring the store in step with a source and return the counters of the run.

        Path sources list files below a root. Url and feed sources take responses (see sources.crawl) as pages, or a fetcher as
        sources.fetch.fetch, which is asked with the validators of the last fetch and has to reach every executor. What can't be listed or read deletes nothing; what is gone is deleted only with prune.
        """
        store, parsed = self.store_id(name_or_id), web.parse_spec(spec)
        place = parsed.root or ",".join(parsed.urls)
        known = registry.find_source(self.sources(), store, place).collect()
        source = known[0]["source_id"] if known else registry.ulid()
        if parsed.kind != "path" and pages is None and fetcher is None:
            raise RetrievalError("invalid_request", f"a {parsed.kind} source needs fetched pages or a fetcher")
        fresh = self.spark.createDataFrame([(source, store, parsed.kind, place if parsed.kind == "path" else None, None if parsed.kind == "path" else place, parsed.refresh, int(time.time()), known[0]["created_at"] if known else _now())], SOURCES)
        since = self.tables.number()
        with self.tables.scratch() as keep:
            more, lost = {"sources": maintenance.upsert(self.sources(), fresh, ["source_id"])}, None
            if parsed.kind == "path":
                found = files.enumerate_files(self.spark, parsed.root, parsed.include, parsed.exclude, keep)
                new = ingest.index(found.select("uri", "modified", "content"), store, source, self.policy, keep)
                status = new["outcomes"]
            else:
                docs, status, lost, state = self._fetched(parsed, store, source, pages, fetcher, keep)
                new = ingest.index(docs.select("uri", F.current_timestamp().alias("modified")), store, source, self.policy, keep, docs)
                others = self._table("fetches", crawl.FETCHES).filter((F.col("store_id") != store) | (F.col("source_id") != source))
                more["fetches"] = others.unionByName(state)
            # Embeddings are made once, too, and all new rows before the pointer moves.
            new["chunks"] = keep(embedding.embed_chunks(new["chunks"].dropDuplicates(["store_id", "chunk_id"]), self.provider))
            observed = status.join(new["resources"].select("uri", "content_hash"), "uri", "left")
            old = self.tables.read("resources", [store]) if "resources" in self.tables.manifest()["tables"] else new["resources"].filter("false")
            own = old.filter((F.col("store_id") == store) & (F.col("source_id") == source)).select("uri", "resource_id", "content_hash", "policy_version")
            plan = keep(maintenance.plan_changes(own, observed, lost, self.policy, prune=prune, complete=parsed.kind == "path", feed=parsed.kind == "feed"))
            counts = maintenance.counters(plan).first().asDict()
            ingest.apply(self.tables, plan, new, store, more, since)
        return counts

    def _fetched(self, spec: web.SourceSpec, store: str, source: str, pages: DataFrame | None, fetcher, keep) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Parsed documents of a url or feed source, uri and status of what was seen, uris that are confirmed gone, and the source's fetches after the run."""
        fetches = self._table("fetches", crawl.FETCHES).filter((F.col("store_id") == store) & (F.col("source_id") == source))
        # A document that has been deleted since is fetched as a new one.
        held = self.tables.read("resources", [store]) if "resources" in self.tables.manifest()["tables"] else self.spark.createDataFrame([], "store_id string, source_id string, uri string")
        held = held.filter((F.col("store_id") == store) & (F.col("source_id") == source)).select("uri", F.lit(True).alias("held")).distinct()
        fetches = keep(fetches.join(held, "uri", "left").withColumn("body_hash", F.when(F.col("held"), F.col("body_hash"))).select(*fetches.columns))

        def get(urls: DataFrame) -> DataFrame:
            if pages is not None:
                return keep(crawl.responses(pages).join(urls.select("url").distinct(), "url", "left_semi"))
            return keep(crawl.responses(crawl.fetch(crawl.requests(urls, fetches), fetcher)))

        first = get(self.spark.createDataFrame([(u,) for u in spec.urls], "url string"))
        if spec.kind == "url":
            told, parsed = crawl.outcomes(first, fetches, self.policy, keep)
            told = keep(told)
            return parsed, crawl.observed(told), told.filter("outcome = 'Gone'").select("uri"), keep(crawl.after(fetches, told, store, source, self.policy))
        # The feed itself is never a document: it has no body to vouch for, so it is always asked for whole.
        entries = keep(feeds.resolved(feeds.entries(first.filter("status BETWEEN 200 AND 299").select("url", F.col("body").cast("string").alias("body")))))
        entries = keep(feeds.newest(entries, spec.max_entries))
        none = self.spark.createDataFrame([], "uri string")
        if spec.mode == "single":
            docs = keep(feeds.one_document(entries))
            return docs, docs.select("uri", "status"), none, fetches
        told, parsed = crawl.outcomes(get(entries.filter("fetchable").select(F.col("uri").alias("url"))), fetches, self.policy, keep)
        told = keep(told)
        own = keep(feeds.own_documents(entries, told))
        docs = parsed.join(own.select("uri"), "uri", "left_anti").unionByName(own)
        seen = own.select("uri", "status").unionByName(crawl.observed(told).join(own.select("uri"), "uri", "left_anti"))
        unanswered = entries.select("uri").join(seen.select("uri"), "uri", "left_anti").select("uri", F.lit("error").alias("status"))
        return docs, keep(seen.unionByName(unanswered)), none, keep(crawl.after(fetches, told, store, source, self.policy))

    def follow_feeds(self, name_or_id: str, responses: DataFrame, checkpoint: str, expiry: int | None = None, trigger: dict | None = None):
        """Start a streaming query that keeps the newest version of each entry of fetched feeds (url, body) in the table `entries`, and indexes the own content of entries that change.

        Replayed and late feeds change nothing; see streaming.feed_entries.
        """
        store = self.store_id(name_or_id)
        rows = feeds.resolved(feeds.entries(responses))

        def then(changed: DataFrame) -> None:
            with self.tables.scratch() as keep:
                docs = keep(feeds.own_documents(changed.withColumn("fetchable", F.lit(False)), self.spark.createDataFrame([], "uri string, outcome string")))
                since = self.tables.number()
                new = ingest.index(docs.select("uri", F.current_timestamp().alias("modified")), store, "feeds", self.policy, keep, docs)
                new["chunks"] = keep(embedding.embed_chunks(new["chunks"].dropDuplicates(["store_id", "chunk_id"]), self.provider))
                seen = docs.select("uri", "status").join(new["resources"].select("uri", "content_hash"), "uri", "left")
                old = self.tables.read("resources", [store]) if "resources" in self.tables.manifest()["tables"] else new["resources"].filter("false")
                own = old.filter((F.col("store_id") == store) & (F.col("source_id") == "feeds")).select("uri", "resource_id", "content_hash", "policy_version")
                ingest.apply(self.tables, keep(maintenance.plan_changes(own, seen, None, self.policy, complete=False)), new, store, since=since)

        return feed_entries.follow(rows, self.tables, store, checkpoint, expiry, then, trigger)

    def fetch_outcomes(self, name_or_id: str, source_id: str | None = None) -> DataFrame:
        """uri, outcome, fetched_at of the last fetch of each URL of the store."""
        rows = self._table("fetches", crawl.FETCHES).filter(F.col("store_id") == self.store_id(name_or_id))
        return (rows if source_id is None else rows.filter(F.col("source_id") == source_id)).select("source_id", "uri", "outcome", "fetched_at")

    def due(self) -> DataFrame:
        return registry.due(self.sources(), int(time.time()))

    # --- queries ---

    def _chunks(self, stores: list[str] | None = None) -> DataFrame:
        head = self.tables.read("resources", stores).select("store_id", "resource_id", "uri", F.col("modified_at").alias("fetched_at"), "policy_version", files.stored_mime(F.col("uri")).alias("mime"))
        return self.tables.read("chunks", stores).join(head, ["store_id", "resource_id"])

    def search(self, query: str, stores: list[str] | None = None, limit: int | None = None, offset: int = 0, content_length: int = EXCERPT, filters: Filters | None = None) -> DataFrame:
        """Citations of the best chunks for a query over the named stores, or over all."""
        if not query.strip():
            raise RetrievalError("invalid_request", "the query is blank")
        scope = retrieval.resolve_stores(self.stores(), stores)
        wanted = Filters(**{**(filters.__dict__ if filters else {}), "stores": scope})
        kept = ("postings", "lengths")
        index = tuple(self.tables.read(n) for n in kept) if all(n in self.tables.manifest()["tables"] for n in kept) else None
        if index is None:
            # Without an index the statistics come from all texts, so all are read.
            return retrieval.search(self._chunks(), query, embedding.embed_query(query, self.provider), wanted, top_n=retrieval.clamp_limit(limit), offset=offset, snippet=content_length, excerpt=text.snippet)
        return retrieval.search(self._chunks(scope), query, embedding.embed_query(query, self.provider), wanted, top_n=retrieval.clamp_limit(limit), offset=offset, snippet=content_length, excerpt=text.snippet, index=index, lengths=self.tables.lengths() if index else None)

    def get_document(self, resource_id: str, store: str | None = None) -> DataFrame:
        """The document's row with its text."""
        row = reading.find_document(self.tables.read("resources"), resource_id, [self.store_id(store)] if store else None)
        own = lambda n: self.tables.read(n).join(row.select("store_id", "resource_id"), ["store_id", "resource_id"], "left_semi")
        return row.join(reading.document_text(own("blocks"), own("chunks")), ["store_id", "resource_id"], "left")

    def get_chunks(self, resource_id: str, store: str | None = None, **page) -> DataFrame:
        """A page of the document's chunks; see reading.get_chunks()."""
        row = reading.find_document(self.tables.read("resources"), resource_id, [self.store_id(store)] if store else None).first()
        chunks = self.tables.read("chunks")
        anchor = page.get("anchor_chunk_id")
        if anchor is not None and chunks.filter((F.col("resource_id") == resource_id) & (F.col("chunk_id") == anchor)).isEmpty():
            raise RetrievalError("chunk_not_found", f"no chunk {anchor} in the document")
        return reading.get_chunks(chunks, resource_id, row["store_id"], **page).drop("embedding")

    def get_chunk(self, store: str, chunk_id: str) -> DataFrame:
        """The chunk's row, or no row, without its embedding."""
        return self.tables.read("chunks").filter((F.col("store_id") == self.store_id(store)) & (F.col("chunk_id") == chunk_id)).drop("embedding")

    def get_blocks(self, resource_id: str, store: str | None = None) -> DataFrame:
        """The document's blocks in order."""
        row = reading.find_document(self.tables.read("resources"), resource_id, [self.store_id(store)] if store else None)
        return self.tables.read("blocks").join(row.select("store_id", "resource_id"), ["store_id", "resource_id"], "left_semi").orderBy("seq")

    def list_sources(self, store: str) -> DataFrame:
        """The store's sources, oldest first."""
        return self.sources().filter(F.col("store_id") == self.store_id(store)).orderBy("created_at", "source_id")

    def list_documents(self, store: str, source_id: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
        rows = self.tables.read("resources").withColumns({"fetched_at": F.col("modified_at"), "mime": files.stored_mime(F.col("uri"))})
        return reading.list_documents(rows, self.store_id(store), source_id, offset, limit)

    def list_stores(self) -> DataFrame:
        """Stores by name with their counts of documents and chunks."""
        stores = self.stores()
        if "chunks" not in self.tables.manifest()["tables"]:
            return stores.select("store_id", "name", "visibility", F.lit(0).cast("long").alias("chunk_count"), F.lit(0).cast("long").alias("document_count")).orderBy("name")
        counts = stores.join(reading.store_stats(self.tables.read("chunks")), "store_id", "left")
        return counts.select("store_id", "name", "visibility", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("document_count", F.lit(0)).alias("document_count")).orderBy("name")

    def status(self) -> dict:
        """Counts by store, bytes in all and for each chunk, the largest tables, and stores that another policy has indexed."""
        sizes = reading.table_sizes(self.tables.sizes()).collect()
        stores = [r.asDict() for r in self.list_stores().collect()]
        chunks, size = sum(s["chunk_count"] for s in stores), sum(r["bytes"] for r in sizes)
        stale = maintenance.stale_stores(self.tables.read("resources"), self.policy).filter("stale").collect() if "resources" in self.tables.manifest()["tables"] else []
        return {"stores": stores, "bytes": size, "bytes_per_chunk": size / chunks if chunks else None, "largest_tables": [(r["table"], r["bytes"]) for r in sizes], "stale_stores": [r["store_id"] for r in stale]}
