"""The synthetic tables as the entities of the data model, and loaders for stored ones."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions import ids, text
from loamline.session import ship

#: Stand-in for fetch times: an hour for each document from this second on.
EPOCH = 1_767_225_600
POLICY = ids.policy_version("native", {}, "rolling-hash", "local", ["markdown", "html", "plaintext"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder's path, never given before, below spark.checkpoint.dir, or below a temporary one where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: files need a folder that all executors share")
        base = tempfile.mkdtemp(prefix="loamline-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as resources: the language is the store, the source column the source."""
    docs = table(spark, sf_dir, "documents").withColumn("uri", F.concat(F.lit("doc://"), F.col("doc_id").cast("string")))
    docs = docs.withColumn("content_hash", F.sha2(ids.block_piece(F.lit("text"), F.col("text")), 256))
    return docs.select(
        F.col("lang").alias("store_id"),
        F.col("source").alias("source_id"),
        ids.resource_id(F.col("uri"), F.col("content_hash")).alias("resource_id"),
        "uri",
        F.when(F.col("doc_id") % 3 == 0, "text/markdown").otherwise("text/plain").alias("mime"),
        text.rfc3339(F.lit(EPOCH) + F.col("doc_id") * 3600).alias("fetched_at"),
        F.when(F.col("doc_id") % 10 == 0, "stale").otherwise(POLICY).alias("policy_version"),
        "content_hash",
        "text",
        "doc_id",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each document."""
    rows = resources(spark, sf_dir).withColumn("block_seq", F.lit(0)).withColumn("seq_in_block", F.lit(0))
    return rows.withColumn("chunk_id", ids.chunk_id(F.col("resource_id"), F.col("block_seq"), F.col("text"), F.col("seq_in_block")))


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each non-blank line of each document, numbered from 0 over all of its lines."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("resource_id"), F.posexplode(F.split("text", "\n", -1)).alias("block_seq", "text"))
    rows = docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("seq_in_block", F.lit(0))
    return rows.withColumn("chunk_id", ids.chunk_id(F.col("resource_id"), F.col("block_seq"), F.col("text"), F.col("seq_in_block")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunk vectors: the label is the store."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.concat(F.lit("s"), F.col("label").cast("string")).alias("store_id"), F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("chunk_id"), "embedding")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as message blocks: the role is the sender."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("resource_id"), F.col("turn").cast("int").alias("seq"), F.col("role").alias("sender"), "text")
