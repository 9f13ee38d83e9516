"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features: words, pairs of adjacent words and pairs with one word skipped, hashed to BITS bits; each
distinct feature of a text counts once, weighted by SCALE / sqrt(number of features), so long texts don't drown. Hashing is vectorised
over Arrow buffers. FTRL-proximal keeps per-coordinate rates and L1 sparsity, so that few weights remain
and a broadcast of them is bounded by 2^BITS * 12 bytes whatever the corpus.

The model is fitted on at most TRAIN_ROWS labelled rows (those of least id hash), featurised in parallel and passed EPOCHS times
in a fixed order by one task. The bound is a parameter; scoring covers every whole text.

Defined results: null and empty texts score as the bias alone; without training rows every score is 0.
Repeated rows get equal scores. Labels for ids without a document, and null labels, are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm import arrays
from loamline.session import shipped

BITS = 20
TRAIN_ROWS = 12_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 4.0, 1.0
#: Feature values are SCALE / sqrt(features), the bias' is 1.
SCALE = 8.0
THRESHOLD = 0.3
_SEED = 31
_WORD = np.ones(256, bool)
_WORD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def features(data: np.ndarray, ends: np.ndarray, hasher: arrays.Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Rows and feature numbers, distinct in each row and in order of both."""
    data = _LOWER[data]
    start, end, row = arrays.word_bounds(_WORD[data], ends)
    word = hasher.ranges(hasher.prefix(data), start, end)
    numbers, rows = [word], [row]
    for gap in (1, 2):
        same = row[gap:] == row[:-gap]
        numbers.append(arrays.mix(word[:-gap] * arrays.U64(2 * gap + 1) + arrays.mix(word[gap:]))[same])
        rows.append(row[gap:][same])
    keys = np.unique(np.concatenate(rows).astype(arrays.U64) << arrays.U64(BITS) | np.concatenate(numbers) >> arrays.U64(64 - BITS))
    return (keys >> arrays.U64(BITS)).astype(np.int64), (keys & arrays.U64((1 << BITS) - 1)).astype(np.int64)


def _featurised(rows: DataFrame, keep: str) -> DataFrame:
    """keep columns and features (array<bigint>) of each row; text must be the first column."""
    names = [f.name for f in rows.schema][1:]

    def run(batches):
        hasher = arrays.Hasher(_SEED)
        for batch in batches:
            for low, high, data, ends in arrays.chunks(batch.column(0)):
                row, number = features(data, ends, hasher)
                lists = arrays.long_lists(number, np.bincount(row, minlength=high - low))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(low, high - low) for k in range(1, batch.num_columns)), lists], [*names, "features"])

    return rows.mapInArrow(run, f"{keep}, features array<bigint>")


def ftrl(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers and weights of the features that are not zero, and the bias, after epochs over the examples."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[(np.abs(zs) <= l1) & (at < size)] = 0.0
        return w

    for _ in range(epochs):
        for at, label in examples:
            x = np.full(len(at) + 1, SCALE / np.sqrt(len(at) + 1))
            x[-1] = 1.0
            at = np.append(at, size)
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip((w * x).sum(), -35, 35)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    every = np.arange(size + 1)
    w = weights(every)
    at = np.flatnonzero(w[:size])
    return at, w[at], float(w[size])


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of the rows that are not held out: feature numbers, weights and bias. An id with several labels or texts is one example, of its least label and features."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(train_rows)
    texts = shipped(documents).select(F.coalesce(text_col, F.lit("")).alias("text"), F.col(id_col).alias("id")).join(F.broadcast(chosen), "id").select("text", "id", "label")
    kind = texts.schema["id"].dataType.simpleString()
    rows = _featurised(texts, f"id {kind}, label int").withColumn("turn", F.xxhash64("id"))
    rows = rows.groupBy("turn", "id").agg(F.min(F.struct("label", "features")).alias("x")).select("turn", "x.*")

    def learn(batches):
        seen = []
        for batch in batches:
            lists = batch.column(2)
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            seen += [(turn, values[ends[k] : ends[k + 1]].astype(np.int32), label) for k, (turn, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))]
        seen.sort(key=lambda x: (x[0], x[2]))
        at, w, bias = ftrl([(x, label) for _, x, label in seen], epochs) if seen else (np.zeros(0, np.int64), np.zeros(0), -35.0)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w, bias))], ["at", "w"])

    model = rows.coalesce(1).mapInArrow(learn, "at long, w double").toArrow()
    at, w = model.column("at").to_numpy(), model.column("w").to_numpy()
    return at[at >= 0], w[at >= 0], float(w[at < 0].sum())


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    rows = shipped(documents).select(F.coalesce(text_col, F.lit("")).alias("text"), F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hasher = arrays.Hasher(_SEED)
        at, w, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        for batch in batches:
            for low, high, data, ends in arrays.chunks(batch.column(0)):
                row, number = features(data, ends, hasher)
                count = np.bincount(row, minlength=high - low) + 1
                total = np.bincount(row, weights=dense[number], minlength=high - low)
                p = 1.0 / (1.0 + np.exp(-np.clip(total * SCALE / np.sqrt(count) + bias, -35, 35)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
