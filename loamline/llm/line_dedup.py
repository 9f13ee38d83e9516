"""Substring dedup by hashing lines and passages.

A unit's normal form is its words, split at blanks, with A-Z lower-cased. Units are the lines of at least MIN_WORDS words and the
passages of a row (see passages): windows of 25 words at places that their own words choose, so that a repeated text of
50 words is found wherever it begins, in the middle of a line, too. Units of a kind are grouped over all rows by a 128-bit digest of
that form; the earliest occurrence, by row id, then by place in the row, stays, and all others go, a line with its
break, a passage from its first word to its last. The ranges removed are bytes of the original text.

Lines of fewer words stay, however often they occur, as do parts of a repeated text between its passages of under 25 words at its ends:
short lines repeat by chance or by form. A passage that overlaps its own repeat (one word over and over) leaves its first word.
Each word that goes has an earlier copy, and the earliest of all copies stays.

The digests of units travel, not their text; a digest's first and last occurrence combine before the
shuffle, and texts travel only for rows that lose bytes.

Defined results: null and empty texts have no units; rows with equal id and text count as one row, which
is kept or cut alike; null ids come first.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm import arrays, passages, suffix_dedup
from loamline.llm.common import Scratch, cut
from loamline.session import ship

#: Words from which a line is long enough for a repeat to be a copy rather than chance.
MIN_WORDS = 10


def _keys(batch: pa.RecordBatch) -> list[bytes]:
    data, ends = arrays.buffers(batch.column(1))
    raw = memoryview(np.ascontiguousarray(data))
    return [hashlib.blake2b(raw[a:b], digest_size=16, key=repr(i).encode()[:64]).digest() for i, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def remove_lines(documents: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed (array<struct<low,high>> of the original text's bytes; one for each run of units), kept (bytes; null if nothing is removed),
    kept_sha256 and n_passages (the row's passages that occur elsewhere, the earliest occurrence included)."""
    texts = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    with Scratch(ship(texts.sparkSession)) as scratch:
        units = scratch.cut(passages.units(texts, min_words, _keys))
        place = F.struct("doc_id", "row", "low")
        first = units.groupBy("one", "two").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).select("one", "two", "first")
        # Written first, so that the join deals both sides anew and Spark can split a very frequent unit.
        first = scratch.cut(first)
        met = units.join(first, ["one", "two"]).withColumn("gone", (F.col("row") != F.col("first.row")) | (F.col("low") != F.col("first.low")))
        found = met.groupBy("row").agg(F.collect_set(F.when(F.col("gone"), F.struct("low", "high"))).alias("ranges"), F.size(F.collect_set(F.when(F.col("passage"), F.col("low")))).cast("long").alias("n_passages"))
        found = cut(found)
    return suffix_dedup.strip(texts, found.withColumnRenamed("row", "digest"), _keys, ["n_passages"])


def digest(found: DataFrame) -> DataFrame:
    """Byte counts, the digest of what stays, the removed ranges as start:end, comma-joined, and n_passages."""
    spans = F.transform("removed", lambda x: F.concat_ws(":", x["low"].cast("string"), x["high"].cast("string")))
    return suffix_dedup.digest(found.withColumn("spans", F.array_join(spans, ",")), "spans", "n_passages")
