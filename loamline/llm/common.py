"""Shared pieces: tables, keys, let-bindings and durable cuts of lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.session import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that separate the words of documents: a space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Most bytes of a table that is broadcast.
BROADCAST_BYTES = 16 << 20
#: A Bloom filter has this many bits for each key, up to 2^MAX_BITS (32 MB) and no fewer than 2^MIN_BITS.
BITS_EACH, MIN_BITS, MAX_BITS = 16, 20, 28
_OWN: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a column reference inside a lambda may be inlined into it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that tell rows apart by id and text; never null, so plain equi-joins keep null ids."""
    return F.unhex(F.md5(F.concat_ws("", F.when(doc_id.isNull(), "-").otherwise("+"), doc_id.cast("string"), F.lit(":"), text)))


def unused(name: str, frame: DataFrame) -> str:
    """name, with underscores added until no column of the table is called so."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def blank_words(text: Column) -> Column:
    """The maximal runs of characters other than blanks; an empty array for null."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RUN, -1)),
    )


def shared_base(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir, or a temporary one where that is unset and the master is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        base = tempfile.mkdtemp(prefix="loamline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def kept_dir(spark: SparkSession, name: str) -> str:
    """A new folder below shared_base() for files that stay after the application."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below shared_base(). All of an application's folders are in one, which goes when its driver ends."""
    own = f"{shared_base(spark)}/loamline-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        at, fs = _path(spark, own)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{own}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def _path(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(frame: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends and a lost executor costs nothing."""
    spark = frame.sparkSession
    path = shared_dir(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


class Scratch:
    """Tables cut() within a with block, deleted at its end. What leaves the block must be cut outside of it first."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def cut(self, frame: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        self.held[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads, and let Spark's cleaner find the shuffles of finished jobs."""
        for frame in frames:
            delete(self.spark, self.held.pop(id(frame))[1])
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def __exit__(self, *_) -> None:
        for _, path in self.held.values():
            delete(self.spark, path)
        self.held.clear()


def small(frame: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The table, cut, and marked for broadcast if its values take at most so many bytes; otherwise joins shuffle."""
    out = cut(frame)
    wide = [f.name for f in out.schema if f.dataType.typeName() in ("string", "binary")]
    size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in wide), F.lit(16 * len(out.columns)))
    return F.broadcast(out) if (out.agg(F.sum(size)).first()[0] or 0) <= most else out


def bloom(hashes: DataFrame):
    """A broadcast Bloom filter (see arrays.in_bloom) of a column x of 64-bit hashes.

    Its size follows their number: two of 16 bits for each, so about one other key in 70 passes. It ends at 2^28 bits: of others, 0.28 pass at
    10^8 keys and nearly all from 10^9 on. Rows that pass by chance are for a later join to drop, so results never depend on it.
    """
    import numpy as np

    power = min(MAX_BITS, max(MIN_BITS, (BITS_EACH * hashes.count()).bit_length()))
    spots = hashes.select(F.explode(F.array(F.expr(f"cast(shiftrightunsigned(x, {64 - power}) as int)"), F.expr(f"cast(shiftrightunsigned(x, 12) & {(1 << power) - 1} as int)"))).alias("spot"))
    masks = spots.groupBy(F.expr("spot div 64").cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, spot % 64))").alias("mask")).toArrow()
    words = np.zeros((1 << power) // 64, np.int64)
    words[masks.column("word").to_numpy()] = masks.column("mask").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(words)
