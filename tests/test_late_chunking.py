"""Late chunking: windows and pooled vectors against plain Python, and what stands alone, repeats or is empty."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.operators import embedding
from loamline.plans import catalog
from loamline.sources import corpus

SF = "/root/testdata/sf0.001"


def plain_rows(texts, budget, dim):
    """The vector of each text: windows token by token, states by their definition, one number at a time."""
    tokens = [[zlib.crc32(w.encode()) for w in " ".join(t.lower().replace("\x0b", " ").replace("\x0c", " ").split("\t")).split()] for t in texts]
    windows, used = [], 0
    for k, own in enumerate(tokens):
        if windows and used + 1 + len(own) <= budget:
            windows[-1].append(k)
            used += 1 + len(own)
        else:
            windows.append([k])
            used = len(own)
    sign = lambda t, d: 1.0 if ((x := (t * 0x9E3779B97F4A7C15 + d * 0xD1B54A32D192ED03) % 2**64) ^ x >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> 63 else -1.0
    out = []
    for window in windows:
        flat, owner = [], []
        for k in window:
            flat += ([0] if flat or owner else []) + tokens[k]
            owner += ([-1] if owner else []) + [k] * len(tokens[k])
        flat, owner = flat[:budget], owner[:budget]
        own = [[sign(t, d) for d in range(dim)] for t in flat]
        mean = [sum(r[d] for r in own) / max(1, len(own)) for d in range(dim)]
        for k in window:
            at = [j for j, o in enumerate(owner) if o == k]
            beside = lambda j, d: sum(own[i][d] for i in (j - 1, j + 1) if 0 <= i < len(own)) / 2
            value = [sum(own[j][d] + beside(j, d) + mean[d] / 4 for j in at) / max(1, len(at)) for d in range(dim)]
            scaled = [np.tanh(v) * 127 for v in value]
            out.append([int(np.sign(v) * np.floor(abs(v) + 0.5)) for v in scaled])
    return out


@pytest.mark.parametrize("budget", [1, 7, 512])
def test_vectors_by_document(spark, budget):
    texts = {"a": ["one two three", "four", "five six seven eight nine ten eleven twelve", "x", "One two"], "b": ["only"], "c": ["p q r", "s t u"]}
    rows = spark.createDataFrame([(r, f"{r}{k}", k, 0, t, "kept") for r, own in texts.items() for k, t in enumerate(own)], "resource_id string, chunk_id string, block_seq int, seq_in_block int, text string, window string")
    got = embedding.embed_chunks(rows.repartition(5), embedding.hashed_context(8, budget))
    assert got.columns == [*rows.columns, "embedding"]
    found = {r["chunk_id"]: [int(x) for x in r["embedding"]] for r in got.collect()}
    wanted = {f"{r}{k}": v for r, own in texts.items() for k, v in enumerate(plain_rows(own, budget, 8))}
    assert found == wanted


def test_the_query_equals_plain_python_on_whole_documents(spark):
    rows = corpus.line_chunks(spark, SF).orderBy("resource_id", "block_seq").collect()
    some = sorted({r["resource_id"] for r in rows}, key=lambda x: -sum(len(r["text"]) for r in rows if r["resource_id"] == x))[5:25]
    found = {(r["resource_id"], r["block_seq"]): r["q"] for r in catalog.queries()["E5_late_chunks"](spark, SF).collect()}
    assert len(found) == len(rows)
    for name in some:
        own = [r for r in rows if r["resource_id"] == name]
        for r, v in zip(own, plain_rows([r["text"] for r in own], 512, 64), strict=True):
            assert found[name, r["block_seq"]] == ",".join(map(str, v))


def test_oversized_empty_null_and_repeated_chunks(spark):
    schema = "resource_id string, chunk_id string, block_seq int, seq_in_block int, text string"
    rows = spark.createDataFrame([("r", "1", 0, 0, "a b"), ("r", "2", 1, 0, "w " * 50), ("r", "3", 2, 0, None), ("r", "4", 3, 0, ""), ("r", "1", 0, 0, "a b")], schema)
    model = embedding.hashed_context(4, 10)
    plan = {r["chunk_id"]: (r["n_tokens"], r["window"]) for r in embedding.late_windows(rows, model).collect()}
    assert plan == {"1": (2, 0), "2": (50, 1), "3": (0, 2), "4": (0, 2)}
    got = [(r["chunk_id"], list(r["embedding"])) for r in embedding.embed_chunks(rows, model).collect()]
    assert len(got) == 5 and dict(got)["3"] == dict(got)["4"] == [0.0] * 4 and any(dict(got)["2"])
    assert embedding.embed_chunks(rows.filter("false"), model).count() == 0
    assert embedding.embed_query("a b", model) == [float(x) for x in plain_rows(["a b"], 10, 4)[0]]


def test_context_counts_and_wrong_models_are_errors(spark):
    model = embedding.hashed_context(16, 100)
    together, alone = embedding.window_vectors(["a b c", "d e f"], model), embedding.window_vectors(["a b c"], model)
    assert together[0] != alone[0]
    with pytest.raises(ValueError):
        embedding.window_vectors(["a b"], embedding.TokenModel(embedding.words_as_tokens, lambda t: np.zeros((len(t) + 1, 4))))


def test_a_document_is_never_one_row_of_texts(spark):
    rows = spark.range(3000).select(F.lit("r").alias("resource_id"), F.col("id").cast("string").alias("chunk_id"), F.col("id").cast("int").alias("block_seq"), F.lit(0).alias("seq_in_block"), F.repeat(F.lit("w "), 20).alias("text"))
    plan = embedding.late_windows(rows, embedding.hashed_context(8, 105))
    assert plan.groupBy("window").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).filter("n + k - 1 <= 105 AND k = 5").count() == 600
