"""Token counts by scanning for separators in flat token files.

A token file is a run of unsigned 16-bit ids in which each document ends with a separator id; nothing says where
documents begin. It is held as blocks of a fixed number of tokens, cut without regard to documents. A block is
scanned at once for its separators; a running maximum of separator positions over a file's blocks, a prefix scan of two levels over a
handful of numbers for each block, then completes the counts of documents that begin in one block and end in another.

Defined results: an empty document, two separators in a row, has no tokens; tokens after a file's last separator are no document; an empty table has no rows. A null text is an empty one. Repeated rows stay repeated.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.llm import bpe
from loamline.llm.common import cut
from loamline.session import shipped

BLOCK_TOKENS = 1 << 17
#: Rows that are encoded before their tokens are cut into blocks.
ROWS = 256
#: Blocks that one task of the scan's lower level goes through at most, for each file.
SPAN = 4096


def flat(ids: np.ndarray) -> bytes:
    """The ids as a token file holds them; one that 16 bits can't hold is an error, never another id."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError(f"token id {int(ids.max())} doesn't fit into 16 bits")
    return ids.astype("<u2").tobytes()


def pack(documents: DataFrame, path: str | None = None, separator: int | None = None, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token files of the encoded documents, one for each partition: file, block, tokens (binary) and doc_ids, the ids of the
    documents that end in the block, in order. Special tokens in a text are encoded as ordinary text."""
    path = path or bpe.default_path()
    rows = shipped(documents).select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches):
        codec = bpe.codec(path)
        end = flat(np.array([max(codec.special.values()) if separator is None else separator]))
        file, block, held, size, ends = TaskContext.get().partitionId(), 0, [], 0, []
        width = 2 * block_tokens

        def cut_off(flush: bool):
            nonlocal block, held, size, ends
            data, at = b"".join(held), 0
            while size - at >= width or flush and at < size:
                inside = [x for x in ends if x[0] <= at + width]
                ends = ends[len(inside) :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([data[at : at + width]], pa.binary()), pa.array([[x[1] for x in inside]], pa.list_(kind))],
                    ["file", "block", "tokens", "doc_ids"],
                )
                block, at = block + 1, at + width
            held, size = [data[at:]], max(0, size - at)
            ends = [(x - at, k) for x, k in ends]

        for batch in batches:
            kind = batch.column(0).type
            for start in range(0, batch.num_rows, ROWS):
                for doc, text in zip(batch.column(0).slice(start, ROWS).to_pylist(), batch.column(1).slice(start, ROWS), strict=True):
                    ids = flat(np.frombuffer(codec.encode_ordinary(text.as_py()), "<u4")) + end
                    held.append(ids)
                    size += len(ids)
                    ends.append((size, doc))
                yield from cut_off(False)
        if size:
            yield from cut_off(True)

    return rows.mapInArrow(run, f"file int, block int, tokens binary, doc_ids array<{rows.schema['doc_id'].dataType.simpleString()}>")


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of flat files of little-endian unsigned 16-bit ids: file (the path), block, tokens.

    A file is one row, read by one task, so it has to stay below 2 GB (Spark's limit of a binary value, which fails with Spark's own error); larger ones are to be cut
    at any even byte. A file with an odd number of bytes holds half an id and is an error that names it; an empty one has no blocks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    odd = F.raise_error(F.concat(F.lit("a token file of an odd number of bytes: "), "path")).cast("binary")
    files = files.withColumn("content", F.when(F.length("content") % 2 == 0, F.col("content")).otherwise(odd))
    spans = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("content") / (2 * block_tokens)).cast("int") - 1, F.lit(0)))
    blocks = files.select(F.col("path").alias("file"), "content", F.explode(spans).alias("block"))
    return blocks.select("file", "block", F.substring("content", F.col("block") * (2 * block_tokens) + 1, F.lit(2 * block_tokens)).alias("tokens")).filter(F.length("tokens") > 0)


def scan(blocks: DataFrame, separator: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, place (of the document among those that end in the block) and n_tokens of each document.

    With doc_ids in blocks (see pack()), doc_id as well.
    """
    ids = [f for f in blocks.schema if f.name == "doc_ids"]
    kind = blocks.schema["file"].dataType.simpleString()
    names = ["file", "block", "first", "last", "inner", *(f.name for f in ids)]

    def run(batches):
        for batch in batches:
            first, last, inner = [], [], []
            for block, tokens in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                at = np.flatnonzero(np.frombuffer(tokens.as_buffer(), "<u2") == separator).astype(np.int64) + block * block_tokens
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                inner.append(np.diff(at) - 1)
            columns = [batch.column(0), batch.column(1), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(inner, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *([batch.column(3)] if ids else [])], names)

    extra = "".join(f", doc_ids {f.dataType.simpleString()}" for f in ids)
    # Written once: blocks are made, and their documents encoded, one time, and a lost task can't deal rows to files anew. A number for each document and two for each block.
    ends = cut(shipped(blocks).select("file", "block", "tokens", *(f.name for f in ids)).mapInArrow(run, f"file {kind}, block int, first long, last long, inner array<bigint>{extra}"))
    # A scan of two levels: the last separator of each span of blocks, scanned over a file's spans, then the blocks within a span.
    ends = ends.withColumn("span", F.floor(F.col("block") / SPAN))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    spans = ends.groupBy("file", "span").agg(F.max("last").alias("top")).withColumn("before", F.max("top").over(earlier("file").orderBy("span"))).drop("top")
    # Only the last separators go through the window and the joins; a block's counts and ids stay where they are but for one join by block.
    tops = ends.select("file", "span", "block", "last").join(spans.withColumnsRenamed({"file": "of", "span": "at"}), F.col("file").eqNullSafe(F.col("of")) & (F.col("span") == F.col("at")))
    tops = tops.select(F.col("file").alias("of"), F.col("block").alias("at"), F.coalesce(F.max("last").over(earlier("file", "span").orderBy("block")), "before", F.lit(-1)).alias("open"))
    ends = ends.filter("first is not null").join(tops, F.col("file").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    counts = ends.withColumn("counts", F.concat(F.array(F.col("first") - F.col("open") - 1), "inner"))
    if not ids:
        return counts.select("file", "block", F.posexplode("counts").alias("place", "n_tokens"))
    out = counts.select("file", "block", F.posexplode(F.arrays_zip("counts", "doc_ids")).alias("place", "x"))
    return out.select("file", "block", "place", F.col("x.doc_ids").alias("doc_id"), F.col("x.counts").alias("n_tokens"))


def token_counts(documents: DataFrame, path: str | None = None, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens (without its separator) for each row, through packed token files."""
    path = path or bpe.default_path()
    separator = max(bpe.codec(path).special.values())
    return scan(pack(documents, path, separator, block_tokens, id_col, text_col), separator, block_tokens).select("doc_id", "n_tokens")
