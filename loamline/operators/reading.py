"""Reading around a hit: documents, their chunks by page or anchor, listings and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators.retrieval import RetrievalError, clamp_limit

CHUNK_PAGE, MAX_PAGE = 50, 200
CHUNK_ORDER = ("block_seq", "seq_in_block", "chunk_id")


def find_document(resources: DataFrame, resource_id: str, stores: list[str] | None = None) -> DataFrame:
    """The one resource with the id. It must exist, in no more than one of the stores asked for."""
    found = resources.filter((F.col("resource_id") == resource_id) & (F.col("store_id").isin(stores) if stores else F.lit(True)))
    n = found.select("store_id").distinct().limit(2).count()
    if n == 0:
        raise RetrievalError("resource_not_found", f"no document {resource_id}")
    if n > 1:
        raise RetrievalError("invalid_request", f"document {resource_id} is in several stores; name one")
    return found


def document_text(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """store_id, resource_id, text: blocks in order joined by a blank line; without blocks, chunks joined by a line break."""
    joined = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c, "text"))), lambda x: x["text"]), sep)
    one = blocks.groupBy("store_id", "resource_id").agg(joined(["seq"], "\n\n").alias("a"))
    two = chunks.groupBy("store_id", "resource_id").agg(joined(["block_seq", "seq_in_block"], "\n").alias("b"))
    return one.join(two, ["store_id", "resource_id"], "full_outer").select("store_id", "resource_id", F.coalesce("a", "b").alias("text"))


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with pos, their place (from 0) in their resource, and total."""
    own = Window.partitionBy("store_id", "resource_id")
    return chunks.withColumn("pos", F.row_number().over(own.orderBy(*CHUNK_ORDER)) - 1).withColumn("total", F.count("*").over(own))


def get_chunks(chunks: DataFrame, resource_id: str, store_id: str | None = None, offset: int | None = None, anchor_chunk_id: str | None = None, anchor_block_seq: int | None = None, limit: int | None = None) -> DataFrame:
    """A page of a resource's chunks, from an offset or around an anchor, with anchor_index, the anchor's place in the page.

    The page is centred on the anchor and shifted inward at either end. An anchor block that has no chunk stands for the first later one.
    """
    if sum(x is not None for x in (offset, anchor_chunk_id, anchor_block_seq)) > 1:
        raise RetrievalError("invalid_request", "offset and anchors exclude each other")
    size = clamp_limit(limit, CHUNK_PAGE, MAX_PAGE)
    own = (F.col("resource_id") == resource_id) & (F.col("store_id") == store_id if store_id else F.lit(True))
    rows = numbered(chunks.filter(own))
    if anchor_chunk_id is None and anchor_block_seq is None:
        start = offset or 0
        return rows.filter((F.col("pos") >= start) & (F.col("pos") < start + size)).withColumn("anchor_index", F.lit(None).cast("int"))
    return centred(rows, F.col("chunk_id") == anchor_chunk_id if anchor_chunk_id is not None else F.col("block_seq") >= anchor_block_seq, size)


def centred(rows: DataFrame, is_anchor, size: int) -> DataFrame:
    """Of each resource of numbered() rows, the page around its first row that fits is_anchor; resources without one have no page."""
    own = Window.partitionBy("store_id", "resource_id")
    at = F.min(F.when(is_anchor, F.col("pos"))).over(own)
    start = F.greatest(F.lit(0), F.least(F.col("__at") - F.floor(F.lit(size / 2)), F.col("total") - size)).cast("int")
    rows = rows.withColumn("__at", at).withColumn("__start", start)
    rows = rows.filter(F.col("__at").isNotNull() & (F.col("pos") >= F.col("__start")) & (F.col("pos") < F.col("__start") + size))
    return rows.withColumn("anchor_index", (F.col("__at") - F.col("__start")).cast("int")).drop("__at", "__start")


def list_documents(resources: DataFrame, store_id: str, source_id: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of a store's documents by URI, with position and total; a limit of -1 has no end.

    Each task keeps the first rows only, and a page's worth of them meet; the total is counted apart.
    """
    rows = resources.filter((F.col("store_id") == store_id) & (F.col("source_id") == source_id if source_id else F.lit(True)))
    rows = rows.select("store_id", "resource_id", "source_id", "uri", "mime", "fetched_at")
    total, order = rows.agg(F.count("*").alias("total")), Window.orderBy("uri", "resource_id")
    page = rows if limit == -1 else rows.orderBy("uri", "resource_id").limit(offset + clamp_limit(limit, CHUNK_PAGE, MAX_PAGE))
    return page.withColumn("position", F.row_number().over(order)).filter(F.col("position") > offset).join(F.broadcast(total))


def first_per_uri(resources: DataFrame) -> DataFrame:
    """One row for each store and URI: the earliest fetched, then the least id."""
    own = Window.partitionBy("store_id", "uri").orderBy("fetched_at", "resource_id")
    return resources.withColumn("__r", F.row_number().over(own)).filter("__r = 1").drop("__r")


def store_stats(chunks: DataFrame) -> DataFrame:
    """store_id, chunk_count, document_count."""
    return chunks.groupBy("store_id").agg(F.count("*").alias("chunk_count"), F.count_distinct("resource_id").alias("document_count"))


def count_documents(resources: DataFrame, store_id: str, source_id: str | None = None) -> int:
    return resources.filter((F.col("store_id") == store_id) & (F.col("source_id") == source_id if source_id else F.lit(True))).count()


def table_sizes(files: DataFrame, limit: int = 5) -> DataFrame:
    """The largest tables of files (table, bytes)."""
    return files.groupBy("table").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "table").limit(limit)
