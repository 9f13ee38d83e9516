"""Embedding chunks by document: providers are callables, and what they return is checked."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType, IntegerType, StructField, StructType

from loamline.functions import vectors

#: A provider takes documents, each a list of chunk texts, and returns as many lists of vectors.
Provider = Callable[[list[list[str]]], list[list[list[float]]]]

#: Dimension and encoding by (provider, model).
SHAPES = {("local", "rolling-hash"): (64, "f32"), ("local", "rolling-hash-bit"): (1024, "bit")}


def rolling_hash(dim: int = 64) -> Provider:
    return lambda documents: [[vectors.embed(t, dim) for t in chunks] for chunks in documents]


@dataclass(frozen=True)
class TokenModel:
    """A contextual model by its parts: ids of a text's tokens, and the states of a sequence of ids. Chunks that share a window are told apart by the separator."""

    tokenize: Callable[[str], list[int]]
    states: Callable[[list[int]], np.ndarray]
    separator: int = 0
    budget: int = 4096
    int8: bool = True


def words_as_tokens(text: str) -> list[int]:
    """A crc32 for each lower-cased word; a null text has none."""
    # Bytes are split at 0x20 and 0x09 to 0x0D, which no other character's UTF-8 holds.
    return list(map(zlib.crc32, (text or "").lower().encode().split()))


def hashed_context(dim: int = 64, budget: int = 4096) -> TokenModel:
    """The offline token model: words as tokens, states by hashing."""
    return TokenModel(words_as_tokens, vectors.TokenStates(dim), budget=budget)


def checked(documents: list[list[str]], found: list[list[list[float]]]) -> list[list[list[float]]]:
    """The vectors, if there is a document's list for each document and a vector for each chunk."""
    if len(found) != len(documents) or any(len(a) != len(b) for a, b in zip(documents, found, strict=True)):
        raise ValueError("the provider returned as many vectors as it was asked for neither by document nor by chunk")
    return found


def pooled(tokens: list[list[int]], model: TokenModel) -> np.ndarray:
    """For each chunk of one window, given by its tokens: states of all of them joined by separators, then their mean over the chunk's own.

    Tokens beyond the budget are cut off, as a model would; only a chunk that is longer by itself loses any. A chunk without tokens gets zeros.
    """
    joined: list[int] = []
    spans = []
    for k, found in enumerate(tokens):
        if k:
            joined.append(model.separator)
        joined.extend(found)
        spans.append((len(joined) - len(found), len(joined)))
    rows = np.asarray(model.states(joined[: model.budget]), dtype=np.float64)
    if len(rows) != min(len(joined), model.budget):
        raise ValueError("the model returned as many states as it was given tokens in no window")
    return vectors.mean_pool(rows, [(a, min(b, len(rows))) for a, b in spans])


def finished(means: np.ndarray, model: TokenModel) -> np.ndarray:
    return (vectors.quantised(means) if model.int8 else means).astype(np.float32)


def window_vectors(texts: list[str], model: TokenModel) -> list[list[float]]:
    """The vectors of the chunks of one window."""
    return finished(pooled([model.tokenize(t) for t in texts], model), model).tolist()


class Windows:
    """Greedy windows of chunks that come resource by resource, in order. A repeated chunk, which has the same place and id, counts once."""

    def __init__(self, budget: int):
        self.budget, self.last, self.used, self.window = budget, None, 0, 0

    def repeats(self, resource: str | None, place: tuple) -> bool:
        return self.last == (resource, place)

    def add(self, resource: str | None, place: tuple, size: int) -> bool:
        """Whether another chunk, of so many tokens, begins a window."""
        if self.last is None or self.last[0] != resource:
            new, self.used, self.window = True, size, 0
        else:
            new, self.used = vectors.next_window(self.used, size, 1, self.budget)
            self.window += new
        self.last = (resource, place)
        return new


_PLACE = ("block_seq", "seq_in_block", "chunk_id")


def _places(batch: pa.RecordBatch) -> Iterator[tuple]:
    """resource_id and place of each row."""
    return zip(batch.column("resource_id").to_pylist(), zip(*(batch.column(c).to_pylist() for c in _PLACE), strict=True), strict=True)


def _in_order(chunks: DataFrame) -> DataFrame:
    """Each resource's chunks in one task, in document order."""
    return chunks.repartition("resource_id").sortWithinPartitions("resource_id", *_PLACE)


def _and(chunks: DataFrame, name: str, kind: DataType) -> StructType:
    return StructType([*(StructField(f.name, f.dataType) for f in chunks.schema.fields), StructField(name, kind)])


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])


def late_windows(chunks: DataFrame, model: TokenModel) -> DataFrame:
    """resource_id, block_seq, seq_in_block, chunk_id, n_tokens and window (from 0 in each resource) of each row of chunks (these four, text).

    Windows are packed greedily in document order; a chunk over the budget stands alone. Texts are tokenized where they lie:
    ids and counts alone are shuffled, once. Rows of a repeated chunk share its window and count once; rows without a resource count as one resource.
    """
    tokenize, budget = model.tokenize, model.budget

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([len(tokenize(t)) for t in batch.column("text").to_pylist()], pa.int32())
            yield _with(batch.select(["resource_id", *_PLACE]), "n_tokens", sizes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(budget)
        for batch in batches:
            found = []
            for (resource, place), size in zip(_places(batch), batch.column("n_tokens").to_pylist(), strict=True):
                if not windows.repeats(resource, place):
                    windows.add(resource, place, size)
                found.append(windows.window)
            yield _with(batch, "window", pa.array(found, pa.int32()))

    keys = chunks.select("resource_id", *_PLACE)
    sized = chunks.select(*keys.columns, "text").mapInArrow(count, _and(keys, "n_tokens", IntegerType()))
    return _in_order(sized).mapInArrow(pack, _and(sized, "window", IntegerType()))


def embed_late(chunks: DataFrame, model: TokenModel) -> DataFrame:
    """chunks with embedding by late chunking: texts are shuffled once, by resource, and tokenized once.

    A task goes through its resources in order and holds one window at a time, never the document; a window's rows, repeated ones too, wait for its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(model.budget)
        waiting: deque[pa.RecordBatch] = deque()
        own: list[list[int]] = []  # tokens of the open window's chunks
        rows: list[int] = []  # for each of its rows, which of them it holds
        found: list[np.ndarray] = []  # means of the waiting rows whose windows have ended

        def close() -> None:
            if rows:
                means = pooled(own, model)
                found.append(means if len(rows) == len(own) else means[rows])
            own.clear()
            rows.clear()

        def ended() -> Iterator[pa.RecordBatch]:
            values = finished(np.concatenate(found), model) if found else []
            found.clear()
            at = 0
            while at < len(values):
                batch = waiting.popleft()
                part = batch.slice(0, len(values) - at)
                if len(part) < len(batch):
                    waiting.appendleft(batch.slice(len(part)))
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * values.shape[1], pa.int32())
                yield _with(part, "embedding", pa.ListArray.from_arrays(ends, pa.array(values[at : at + len(part)].ravel())))
                at += len(part)

        for batch in batches:
            waiting += [batch] if len(batch) else []
            for (resource, place), text in zip(_places(batch), batch.column("text").to_pylist(), strict=True):
                if not windows.repeats(resource, place):
                    tokens = model.tokenize(text)
                    if windows.add(resource, place, len(tokens)):
                        close()
                    own.append(tokens)
                rows.append(len(own) - 1)
            yield from ended()
        close()
        yield from ended()

    return _in_order(chunks).mapInArrow(run, _and(chunks, "embedding", ArrayType(FloatType())))


def embed_chunks(chunks: DataFrame, provider: Provider | TokenModel | None = None) -> DataFrame:
    """Chunks with embedding. A document's chunks are embedded together, in order; with a TokenModel by late chunking, window by window."""
    model = provider or rolling_hash()
    if isinstance(model, TokenModel):
        return embed_late(chunks, model)
    names = chunks.columns
    whole = chunks.groupBy("resource_id").agg(F.array_sort(F.collect_list(F.struct("block_seq", "seq_in_block", "chunk_id", "text"))).alias("own"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            documents = [[c["text"] for c in own] for own in batch["own"]]
            found = checked(documents, model(documents))
            rows = [(c["chunk_id"], v) for own, vs in zip(batch["own"], found, strict=True) for c, v in zip(own, vs, strict=True)]
            yield pd.DataFrame(rows, columns=["chunk_id", "embedding"])

    embedded = whole.mapInPandas(run, "chunk_id string, embedding array<float>").dropDuplicates(["chunk_id"])
    return chunks.join(embedded, "chunk_id").select(*names, "embedding")


def embed_query(text: str, provider: Provider | TokenModel | None = None) -> list[float]:
    """The vector of a query, a document of one chunk."""
    if isinstance(provider, TokenModel):
        return window_vectors([text], provider)[0]
    return checked([[text]], (provider or rolling_hash())([[text]]))[0][0]


def batched(call: Callable[[list[str]], list[tuple[int, list[float]]]], size: int = 32) -> Provider:
    """A provider of a hosted model that takes up to size texts and answers with (index, vector) in any order; a missing index is an error."""

    def run(documents: list[list[str]]) -> list[list[list[float]]]:
        texts = [t for d in documents for t in d]
        found: list[list[float]] = []
        for k in range(0, len(texts), size):
            part = dict(call(texts[k : k + size]))
            if sorted(part) != list(range(len(texts[k : k + size]))):
                raise ValueError("the provider left out some vectors")
            found += [part[j] for j in range(len(part))]
        rest = iter(found)
        return [[next(rest) for _ in d] for d in documents]

    return run
