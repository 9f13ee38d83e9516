"""File-stream ingestion: new files under a folder are parsed, chunked and merged into the store in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.functions import ids
from loamline.operators import maintenance
from loamline.operators.blocks import blocks_of
from loamline.operators.chunking import chunk_blocks, preset_for
from loamline.operators.extract import parse_documents
from loamline.session import ship

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def index(files: DataFrame, store_id: str, source_id: str, policy: str, keep: Callable[[DataFrame], DataFrame] = lambda frame: frame, parsed: DataFrame | None = None) -> dict[str, DataFrame]:
    """resources, blocks and chunks of files (uri, modified, content), and outcomes (uri, status: ok, empty, unsupported, error). Files without text give none.

    keep() may write a frame and read it back: files are then parsed once. With parsed (as of parse_documents), files need no content.
    """
    parsed = keep(parse_documents(files.select("uri", "content"))) if parsed is None else parsed
    outcomes, parsed = parsed.select("uri", "status"), parsed.filter("status = 'ok'")
    blocks = keep(blocks_of(parsed))
    hashes = blocks.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "text", "page"))).alias("b")).select("uri", ids.content_hash(F.col("b")).alias("content_hash"))
    head = parsed.join(hashes, "uri").join(files.select("uri", "modified"), "uri")
    stamp = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    resources = keep(head.select(
        F.lit(store_id).alias("store_id"), ids.resource_id(F.col("uri"), F.col("content_hash")).alias("resource_id"), F.lit(source_id).alias("source_id"), "uri", "title",
        "content_hash", F.lit(policy).alias("policy_version"), stamp.alias("added_at"), stamp.alias("modified_at"),
    ))
    named = blocks.join(resources.select("uri", "store_id", "resource_id"), "uri").withColumn("preset", preset_for(F.col("uri"), F.lit(None).cast("string")))
    chunks = chunk_blocks(named, "resource_id").join(resources.select("resource_id", "store_id", "source_id"), "resource_id")
    return {"resources": resources, "blocks": named.drop("uri", "preset"), "chunks": chunks, "outcomes": outcomes}


def apply(store: maintenance.Snapshots, plan: DataFrame, new: dict[str, DataFrame], store_id: str, more: dict[str, DataFrame] | None = None, since: int | None = None) -> None:
    """Put a plan's new rows (resources, blocks, chunks) in place of what it replaces and deletes, index included, in one manifest together with more.

    Only the parts that hold a resource of the plan are read and written.
    """
    wanted = plan.filter(F.col("action").isin("insert", "replace")).select("uri").join(new["resources"].select("uri", "resource_id"), "uri").select("resource_id")
    come = maintenance.with_index({n: new[n].join(wanted, "resource_id", "left_semi") for n in ("resources", "blocks", "chunks")})
    have = store.manifest()["tables"]
    leaving = plan.filter(F.col("action").isin("replace", "delete")).select(F.col("old_id").alias("resource_id"))
    # At most BUCKETS keys.
    touched = {r["part"] for r in wanted.unionByName(leaving).filter("resource_id is not null").select(F.lit(store_id).alias("store_id"), "resource_id").select(maintenance.part_key().alias("part")).distinct().collect()}
    if "chunks" in have and not all(n in have for n in maintenance.OWNED) or not store.parted(maintenance.OWNED):
        # A store from before the index, or from before tables had parts, is written whole once.
        old = {n: store.read(n) for n in maintenance.OWNED if n in have}
        old = maintenance.with_index(old) | old
        store.write({**{n: maintenance.replace_resources(old[n], plan, come[n], store_id) for n in come}, **(more or {})}, since=since)
        return
    old = {n: store.read(n, parts=touched) if n in have else come[n].filter("false") for n in come}
    tables = {n: maintenance.replace_resources(old[n], plan, come[n], store_id) for n in come} if touched or not have.get("resources") else {}
    store.write({**tables, **(more or {})}, parts=touched, since=since)


def merge(store: maintenance.Snapshots, files: DataFrame, store_id: str, source_id: str, policy: str) -> None:
    """Index files into the store: unchanged ones are skipped, changed ones replace their earlier version, empty ones change nothing."""
    since = store.number()
    with store.scratch() as keep:
        new = index(files, store_id, source_id, policy, keep)
        new["chunks"] = keep(new["chunks"])
        none = new["resources"].filter("false")
        current = store.read("resources", [store_id]) if "resources" in store.manifest()["tables"] else none
        observed = new["outcomes"].join(new["resources"].select("uri", "content_hash"), "uri", "left")
        own = current.filter((F.col("store_id") == store_id) & (F.col("source_id") == source_id)).select("uri", "resource_id", "content_hash", "policy_version")
        apply(store, keep(maintenance.plan_changes(own, observed, None, policy, complete=False)), new, store_id, since=since)


def watch(spark: SparkSession, folder: str, store: maintenance.Snapshots, checkpoint: str, store_id: str, source_id: str, policy: str, pattern: str = "*", trigger: dict | None = None, progress: Callable[[int, int], None] | None = None):
    """Start a streaming query that merges files as they appear; with the default trigger it ends when all there are now are done.

    progress is called with each micro-batch's number and count of files.
    """
    ship(spark)
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col("path").alias("uri"), F.col("modificationTime").alias("modified"), "content").persist()
        try:
            n = rows.count()
            if n:
                merge(store, rows, store_id, source_id, policy)
            if progress:
                progress(number, n)
        finally:
            rows.unpersist()

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
