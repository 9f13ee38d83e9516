"""Removal of every byte that a repeated byte string of LENGTH bytes covers.

Sorting all suffixes of a corpus would shuffle hundreds of times its size. Only suffixes that can have a partner are sorted:

1. Each start of a LENGTH-byte window belongs to the window's anchor, the leftmost least-hashed K-gram in it. Equal windows
   have their anchors at the same distance, so windows meet only through equal anchors. Consecutive starts with
   one anchor form a segment, about one for each (LENGTH - K) / 2 bytes, which travels as two 64-bit hashes: of the anchor and of the segment's bytes.
2. Anchors that occur once are dropped. Equal segments are repeated as a whole; their bytes don't travel.
3. The different segments of one anchor travel once each. Deep-shallow sorting orders their suffixes from the anchor and,
   reversed, their prefixes before it; common prefixes in both orders give all windows that two of them share, byte for byte.
   An anchor with more than HOT different segments is instead resolved by digests of single windows,
   which are counted with combining before the shuffle, so no group is ever unbounded.
4. Ranges go back to the rows through the digest of the text. Texts travel only for rows that lose bytes.

Defined results: a null text is an empty one; texts below LENGTH bytes lose nothing; copies of a text lose everything
from LENGTH bytes on, the first one, too; repeated rows are copies.
"""

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm import arrays
from loamline.llm.common import Scratch, bloom, cut
from loamline.llm.passages import window_least
from loamline.llm.suffixes import shared_windows
from loamline.session import ship

LENGTH = 400
#: Bytes of the shorter strings that are counted: 99 of 100 passages of 51 words have more.
SHORT = 240
#: Bytes of an anchor; at most LENGTH. A longer one meets fewer strangers, but there are more of them.
ANCHOR = 128
#: Most different segments of an anchor that are sorted in one group.
HOT = 5000
#: Starts that are worked on at once in a long text.
TILE = 1 << 21
_SEEDS = (71, 72)


def segments(data: np.ndarray, ends: np.ndarray, length: int, anchor: int, hasher: arrays.Hasher) -> tuple[np.ndarray, ...]:
    """first start, last start, anchor position, row, anchor hash and segment hash of each segment, by position in data."""
    n, width = len(data), length - anchor + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, arrays.U64, arrays.U64))
    prefix = hasher.prefix(data)
    grams = arrays.quick_grams(data, anchor)
    low = arrays.U64((1 << 24) - 1)
    least = window_least((grams & ~low) | np.arange(len(grams), dtype=arrays.U64), width)
    at = (least & low).astype(np.int64)  # of the window from each start
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(at)]
    inside = np.arange(len(at)) + length <= ends[row + 1]
    edge = np.ones(len(at), bool)
    edge[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(edge & inside)
    stop = np.flatnonzero(inside & np.append(edge[1:] | ~inside[1:], True))
    where = at[first]
    whole = hasher.ranges(prefix, first, stop + length)
    return first, stop, where, row[first], grams[where], arrays.mix(whole + (where - first).astype(arrays.U64) * arrays.U64(0xE7037ED1A0B428DB))


def tiles(column: pa.Array, length: int):
    """Like arrays.chunks(), with the offset of the piece in its row; windows of a long row are dealt over several pieces."""
    for low, high, data, ends in arrays.chunks(column):
        if high - low == 1 and len(data) > TILE + length:
            for start in range(0, len(data) - length + 1, TILE):
                piece = data[start : start + TILE + length - 1]
                yield low, high, piece, np.array([0, len(piece)]), start
        else:
            yield low, high, data, ends, 0


def _digests(column: pa.Array) -> list[bytes]:
    data, ends = arrays.buffers(column)
    raw = memoryview(np.ascontiguousarray(data))
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _anchors(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """fp of anchors that occur at least twice, and kinds, how many different segments each has."""

    def emit(batches):
        hasher = arrays.Hasher(_SEEDS[0])
        for batch in batches:
            for _, _, data, ends, _ in tiles(batch.column(0), length):
                *_, fp, cx = segments(data, ends, length, anchor, hasher)
                order = np.lexsort((cx, fp))
                fp, cx = fp[order], cx[order]
                new = np.ones(len(fp), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (cx[1:] != cx[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(fp)))
                yield pa.RecordBatch.from_arrays([pa.array(fp[at].view(np.int64)), pa.array(cx[at].view(np.int64)), pa.array(times)], ["fp", "cx", "times"])

    pairs = texts.select("text").mapInArrow(emit, "fp long, cx long, times long").groupBy("fp", "cx").agg(F.sum("times").alias("times"))
    return pairs.groupBy("fp").agg(F.sum("times").alias("times"), F.count("*").alias("kinds")).filter("times > 1").select("fp", "kinds")


def _members(texts: DataFrame, length: int, anchor: int, repeated: DataFrame) -> DataFrame:
    """digest, fp, cx, times, anchors (positions), low, high (distances of starts before the anchor), segment (bytes; null where not needed)."""
    any_of, differ = bloom(repeated.select(F.col("fp").alias("x"))), bloom(repeated.filter("kinds > 1").select(F.col("fp").alias("x")))

    def emit(batches):
        hasher, texts_seen, segments_seen = arrays.Hasher(_SEEDS[0]), set(), set()
        for batch in batches:
            digests = _digests(batch.column(0))
            for base, _, data, ends, offset in tiles(batch.column(0), length):
                first, stop, where, row, fp, cx = segments(data, ends, length, anchor, hasher)
                some = np.flatnonzero(arrays.in_bloom(any_of.value, fp))
                if not len(some):
                    continue
                some = some[np.lexsort((where[some], cx[some], fp[some], row[some]))]
                first, stop, where, row, fp, cx = (x[some] for x in (first, stop, where, row, fp, cx))
                new = np.ones(len(fp), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (cx[1:] != cx[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(fp)))
                names = [digests[base + k] for k in row[at].tolist()]
                again = np.array([(x, offset) in texts_seen for x in names], bool)
                texts_seen.update((x, offset) for x in set(names))
                need = arrays.in_bloom(differ.value, fp[at])
                raw, bodies = memoryview(np.ascontiguousarray(data)), []
                for k, wanted, f, c in zip(at.tolist(), need.tolist(), fp[at].tolist(), cx[at].tolist(), strict=True):
                    wanted = wanted and (f, c) not in segments_seen
                    if wanted:
                        segments_seen.add((f, c))
                    bodies.append(bytes(raw[first[k] : stop[k] + length]) if wanted else None)
                own = where - ends[row] + offset
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.binary()),
                        pa.array(fp[at].view(np.int64)),
                        pa.array(cx[at].view(np.int64)),
                        pa.array(times),
                        arrays.long_lists(own[np.repeat(~again, times)], np.where(again, 0, times)),
                        pa.array((where - stop)[at].astype(np.int32)),
                        pa.array((where - first)[at].astype(np.int32)),
                        pa.array(bodies, pa.binary()),
                    ],
                    ["digest", "fp", "cx", "times", "anchors", "low", "high", "segment"],
                )

    return texts.select("text").mapInArrow(emit, "digest binary, fp long, cx long, times long, anchors array<bigint>, low int, high int, segment binary")


_SPANS = "fp long, cx long, spans array<struct<low:int,high:int>>"


def _compared(kinds: DataFrame, length: int, anchor: int) -> DataFrame:
    """fp, cx, spans of segments by deep-shallow sorting of each anchor's group; groups arrive together, in any order."""
    spans_type = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))

    def solve(group: list[tuple]) -> Iterator[tuple]:
        # Anchors are compared byte by byte: equal hashes alone prove nothing.
        by_anchor: dict[bytes, list[tuple]] = {}
        for row in group:
            by_anchor.setdefault(row[5][row[4] : row[4] + anchor], []).append(row)
        for rows in by_anchor.values():
            yield from solved(rows)

    def solved(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) > 1:
            left, right = zip(*((s[: high][::-1], s[high:]) for _, _, _, _, high, s in rows), strict=True)
            shared = shared_windows(list(left), list(right), length, anchor)
        else:
            shared = [[]]
        for (fp, cx, times, low, high, _), spans in zip(rows, shared, strict=True):
            spans = [(low, high)] if times > 1 else spans
            if spans:
                yield fp, cx, [{"low": a, "high": b} for a, b in spans]

    def batched(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], spans_type)], ["fp", "cx", "spans"])

    def compare(batches):
        group: list[tuple] = []
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if group and group[0][0] != row[0]:
                    found += solve(group)
                    group = []
                group.append(row)
            yield batched(found)
        yield batched(list(solve(group)) if group else [])

    return kinds.select("fp", "cx", "times", "low", "high", "segment").repartition("fp").sortWithinPartitions("fp").mapInArrow(compare, _SPANS)


def _digested(kinds: DataFrame, length: int) -> DataFrame:
    """fp, cx, spans by digests of single windows: for anchors with very many different segments."""
    ways = kinds.select("fp", "cx", "times", "high", "segment", F.explode(F.sequence("low", "high")).alias("s"))
    ways = ways.select("fp", "cx", "times", "s", F.unhex(F.md5(F.substring(F.col("segment"), F.col("high") - F.col("s") + 1, F.lit(length)))).alias("window"))
    often = ways.groupBy("fp", "s", "window").agg(F.sum("times").alias("all")).filter("all > 1").select("fp", "s", "window")
    return ways.join(often, ["fp", "s", "window"], "left_semi").groupBy("fp", "cx").agg(F.collect_set(F.struct(F.col("s").alias("low"), F.col("s").alias("high"))).alias("spans"))


def repeated_ranges(texts: DataFrame, scratch: Scratch, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """digest (of a text), ranges: array<struct<low,high>> of byte ranges, end exclusive, that repeated strings cover; they may overlap. It reads tables of scratch."""
    cut = scratch.cut
    repeated = cut(_anchors(texts, length, anchor))
    members = cut(_members(texts, length, anchor, repeated))
    kinds = members.groupBy("fp", "cx").agg(F.sum("times").alias("times"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("segment", ignorenulls=True).alias("segment"))
    kinds = cut(kinds.join(repeated.withColumnRenamed("kinds", "of"), "fp"))
    whole = kinds.filter("times > 1 and of = 1").select("fp", "cx", F.array(F.struct("low", "high")).alias("spans"))
    spans = whole.unionByName(_compared(kinds.filter((F.col("of") > 1) & (F.col("of") <= hot)), length, anchor)).unionByName(_digested(kinds.filter(F.col("of") > hot), length))
    met = members.filter("size(anchors) > 0").select("digest", "fp", "cx", "anchors").join(spans, ["fp", "cx"])
    ranges = F.flatten(F.transform("anchors", lambda a: F.transform("spans", lambda s: F.struct((a - s["high"]).alias("low"), (a - s["low"] + length).alias("high")))))
    return met.select("digest", ranges.alias("ranges")).groupBy("digest").agg(F.flatten(F.collect_set("ranges")).alias("ranges"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlaps; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def covered(ranges: Column) -> Column:
    """How many bytes the ranges (array<struct<low,high>>, which may overlap) cover."""
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["high"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["high"] - F.greatest(acc["end"], x["low"]))).alias("n"))
    return F.aggregate(F.array_sort(ranges), none, step)["n"]


def remove_repeats(documents: DataFrame, length: int = LENGTH, anchor: int | None = None, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", short: int | None = SHORT) -> DataFrame:
    """doc_id, n_bytes, removed (array<struct<low,high>> of the text's bytes), kept (the remaining bytes; null if nothing is removed), kept_sha256 and
    n_repeated for each row: how many bytes recurring strings of short bytes cover, by the same sort. Those are counted, not removed; without short there is no such column."""
    anchor = anchor or min(ANCHOR, length)
    texts = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    with Scratch(ship(texts.sparkSession)) as scratch:
        ranges = repeated_ranges(texts, scratch, length, anchor, hot)
        if short:
            also = scratch.cut(repeated_ranges(texts, scratch, short, max(1, short // 3), hot).select("digest", covered(F.col("ranges")).alias("n_repeated")))
            ranges = ranges.join(also, "digest", "full")
        ranges = cut(ranges)
    return strip(texts, ranges, lambda batch: _digests(batch.column(1)), ["n_repeated"] if short else [])


def strip(texts: DataFrame, ranges: DataFrame, keys, more: Sequence[str] = ()) -> DataFrame:
    """remove_repeats()'s columns for texts (doc_id, text) and ranges (digest, ranges, and the counts named by more), where keys gives the digests of a batch of texts.

    Texts that lose nothing are finished where they are read; a Bloom filter tells which others have to meet their ranges.
    """
    losing = bloom(ranges.filter(F.size("ranges") > 0).select(F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long").alias("x")))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def mark(batches):
        for batch in batches:
            digests = keys(batch)
            lose = arrays.in_bloom(losing.value, np.array([int.from_bytes(x[:8], "big") for x in digests], arrays.U64))
            _, ends = arrays.buffers(batch.column(1))
            text = pa.compute.if_else(pa.array(lose), batch.column(1), pa.scalar(None, batch.column(1).type))
            same = pa.compute.if_else(pa.array(lose), pa.scalar(None, batch.column(1).type), batch.column(1))
            sha = [hashlib.sha256(x.as_buffer()).hexdigest() if x.is_valid else None for x in same]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(np.diff(ends)), text, pa.array(sha, pa.string())], ["doc_id", "digest", "n_bytes", "text", "sha"])

    marked = texts.mapInArrow(mark, f"doc_id {kind}, digest binary, n_bytes long, text string, sha string").join(ranges, "digest", "left")
    names = ["doc_id", "n_bytes", "removed", "kept", "kept_sha256", *more]

    def strip(batches):
        spans_type = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        for batch in batches:
            removed, kept, shas = [], [], []
            for text, sha, spans in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                spans = merged([(x["low"], x["high"]) for x in spans or ()])
                if sha is None:
                    raw, at, parts = memoryview(text.as_buffer()), 0, []
                    for low, high in spans:
                        parts.append(raw[at:low])
                        at = high
                    body = b"".join([*parts, raw[at:]])
                    sha = hashlib.sha256(body).hexdigest()
                    kept.append(body if spans else None)
                else:
                    kept.append(None)
                removed.append([{"low": a, "high": b} for a, b in spans])
                shas.append(sha)
            counts = [batch.column(5 + k) for k in range(len(more))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, spans_type), pa.array(kept, pa.binary()), pa.array(shas, pa.string()), *counts], names)

    counted = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in more]
    schema = f"doc_id {kind}, n_bytes long, removed array<struct<low:bigint,high:bigint>>, kept binary, kept_sha256 string" + "".join(f", {c} long" for c in more)
    return marked.select("doc_id", "n_bytes", "text", "sha", "ranges", *counted).mapInArrow(strip, schema)


def digest(found: DataFrame, *more: str) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["high"] - x["low"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256", *more)
