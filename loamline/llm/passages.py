"""Passages: windows of WORDS words at places that their own words choose.

A window's key comes from its first two words. Of each GROUP consecutive windows of a text the one with the least key, the first
of equals, is a passage. So two texts with WORDS + GROUP - 1 words in common, wherever those begin, have a passage in common,
and there is about one for each GROUP / 2 words. A text with fewer windows than GROUP has one passage, one with fewer words than WORDS none.

The key of a word is the first 32 bits of its MD5, which SQL has too; it is computed once for each different word of a task.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loamline.llm import arrays

WORDS, GROUP = 25, 26
#: Words whose keys a task remembers.
HELD = 1 << 18
_PLACE = 28
_SEEDS = (51, 52)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window, by running minima from both ends of blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, arrays.U64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class WordKeys:
    """32-bit keys of words given by their hashes and bytes."""

    def __init__(self):
        self.held: dict[int, int] = {}

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if len(self.held) > HELD:
            self.held.clear()
        kinds, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        raw, held, keys = memoryview(np.ascontiguousarray(data)), self.held, np.empty(len(kinds), arrays.U64)
        for k, (h, a, b) in enumerate(zip(kinds.tolist(), start[at].tolist(), end[at].tolist(), strict=True)):
            key = held.get(h)
            if key is None:
                key = held[h] = int.from_bytes(hashlib.md5(raw[a:b]).digest()[:4], "big")
            keys[k] = key
        return keys[back]


def passages(keys: np.ndarray, row: np.ndarray, rows: int, words: int = WORDS, group: int = GROUP) -> np.ndarray:
    """The first word (its place among all words) of each passage, for words with keys and rows in order."""
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    windows = np.maximum(count - words + 1, 0)
    some = np.flatnonzero(windows)
    if not len(some):
        return np.zeros(0, np.int64)
    opens = np.cumsum(windows[some]) - windows[some]
    owner = np.repeat(np.arange(len(some)), windows[some])
    place = np.arange(len(owner)) - opens[owner]
    word = first[some][owner] + place
    after = keys[np.minimum(word + 1, len(keys) - 1)] if words > 1 else np.zeros(len(word), arrays.U64)
    ranked = ((keys[word] + arrays.U64(3) * after) << arrays.U64(_PLACE)) | place.astype(arrays.U64)
    short = windows[some] < group
    chosen, owners = [np.minimum.reduceat(ranked, opens)[short]], [np.flatnonzero(short)]
    if not short.all():
        least = window_least(ranked, group)
        inside = np.flatnonzero(place[: len(least)] + group <= windows[some][owner[: len(least)]])
        chosen.append(least[inside])
        owners.append(owner[inside])
    at = np.concatenate(chosen) & arrays.U64((1 << _PLACE) - 1)
    return np.unique(first[some][np.concatenate(owners)] + at.astype(np.int64))


class Units:
    """Finds the units of a run of texts; equal words give equal digests in every process."""

    def __init__(self, min_words: int):
        self.min_words, self.hashers, self.keys = min_words, [arrays.Hasher(x) for x in _SEEDS], WordKeys()

    def __call__(self, data: np.ndarray, ends: np.ndarray):
        """row, first byte, byte after the last, two digests and whether it is a passage, of each unit; bytes count from the row's start. Without min_words, passages only."""
        low = _LOWER[data]
        start, end, row = arrays.word_bounds(~_BLANK[low], ends)
        named = [h.ranges(h.prefix(low), start, end) for h in self.hashers]
        a = passages(self.keys(low, start, end, named[0]), row, len(ends) - 1)
        b = a + WORDS
        first, stop, whole = start[a], end[b - 1], np.ones(len(a), bool)
        if self.min_words:
            edge = np.zeros(len(data) + 1, bool)
            edge[np.flatnonzero(data == 10) + 1] = True
            edge[ends] = True
            cuts = np.flatnonzero(edge)
            c, d = np.searchsorted(start, cuts[:-1]), np.searchsorted(start, cuts[1:])
            some = np.flatnonzero(d - c >= self.min_words)
            a, b = np.concatenate([a, c[some]]), np.concatenate([b, d[some]])
            first, stop = np.concatenate([first, cuts[:-1][some]]), np.concatenate([stop, cuts[1:][some]])
            whole = np.concatenate([whole, np.zeros(len(some), bool)])
        names = [h.runs(x, a, b) for h, x in zip(self.hashers, named, strict=True)]
        owner = row[a] if len(a) else np.zeros(0, np.int64)
        return owner, first - ends[owner], stop - ends[owner], arrays.mix(names[0] + whole.astype(arrays.U64)), names[1], whole


def units(texts: DataFrame, min_words: int, keys) -> DataFrame:
    """doc_id, row (a name of the row, by keys), low, high, one, two and passage of each unit."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def emit(batches):
        find = Units(min_words)
        for batch in batches:
            names = pa.array(keys(batch), pa.binary())
            for low, _, data, ends in arrays.chunks(batch.column(1)):
                row, first, stop, one, two, whole = find(data, ends)
                at = pa.array(row + low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), names.take(at), pa.array(first, pa.int32()), pa.array(stop, pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(whole)],
                    ["doc_id", "row", "low", "high", "one", "two", "passage"],
                )

    return texts.mapInArrow(emit, f"doc_id {kind}, row binary, low int, high int, one long, two long, passage boolean")
