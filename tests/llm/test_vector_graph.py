"""Near-duplicate vectors against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import queries, vector_graph
from loamline.session import ship

SF = "/root/testdata/sf0.001"


def plain(rows, cosine=0.9):
    """Sorted (vec_id, n_links, component_id, kept) for rows (vec_id, embedding)."""
    n, least = [0] * len(rows), list(range(len(rows)))
    good = {k: np.array(x, float) for k, (_, x) in enumerate(rows) if x and all(v is not None and math.isfinite(v) for v in x) and any(x)}

    def top(k):
        while least[k] != k:
            k = least[k]
        return k

    units = {k: vector_graph.unit(v[None])[0] for k, v in good.items()}
    for a in good:
        for b in good:
            if a < b and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= cosine:
                n[a], n[b] = n[a] + 1, n[b] + 1
                least[max(top(a), top(b))] = min(top(a), top(b))
    low = {}
    for k, (name, _) in enumerate(rows):
        if name is not None:
            low[top(k)] = min(low.get(top(k), name), name)
    return sorted(repr((name, n[k], low.get(top(k)), name == low.get(top(k)))) for k, (name, _) in enumerate(rows))


def told(found):
    return sorted(repr((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in found.collect())


def frame(spark, rows):
    out = ship(spark).createDataFrame(rows, "vec_id long, embedding array<float>")
    return out.withColumns({c: F.lit("clash") for c in ("uid", "length", "vec", "ball", "name", "links", "root")}).repartition(4)


def rounded(rows):
    return [(k, None if x is None else [None if v is None else float(np.float32(v)) for v in x]) for k, x in rows]


def groups(rng, sizes, noise, dims=24):
    """Vectors around random directions, as many as sizes say for each."""
    out = []
    for size in sizes:
        centre = rng.normal(size=dims)
        out += [(centre / np.linalg.norm(centre) + noise * rng.normal(size=dims) / dims**0.5).tolist() for _ in range(size)]
    return out


def test_hard_rows(spark):
    """What can't link, other lengths, scaled and repeated vectors, opposite ones, and huge and tiny components."""
    rng = np.random.default_rng(4)
    one, two = rng.normal(size=24).tolist(), rng.normal(size=8).tolist()
    odd = [None, [], [0.0] * 24, [float("nan")] + one[1:], [float("inf")] + one[1:], [None] + one[1:], one, one, [3 * x for x in one], [-x for x in one], two, two, [x * 1e30 for x in one], [x * 1e-30 for x in one]]
    rows = [(100 - k, x) for k, x in enumerate(odd)] + [(94, one), (None, one), (None, None)] + [(200 + k, x) for k, x in enumerate(groups(rng, [1] * 60, 0))]
    rows = rounded(rows)
    assert told(vector_graph.near_duplicates(frame(spark, rows))) == plain(rows)


def test_groups_chains_and_parts(spark, monkeypatch):
    """Tight and loose groups, chains of links, shards of several parts, and groups that a small sample misses."""
    rng = np.random.default_rng(5)
    vectors = groups(rng, [90, 40, 1, 1, 7], 0.12) + groups(rng, [30, 25], 0.33) + groups(rng, [1] * 80, 0)
    a, b = (x / np.linalg.norm(x) for x in np.linalg.qr(rng.normal(size=(24, 2)))[0].T)
    vectors += [(math.cos(t) * a + math.sin(t) * b).tolist() for t in np.arange(0, 2.2, 0.21)]
    rows = rounded([(int(k), v) for k, v in zip(rng.permutation(len(vectors)), vectors)])
    want = plain(rows)
    assert told(vector_graph.near_duplicates(frame(spark, rows))) == want
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", 60)
    monkeypatch.setattr(vector_graph, "SAMPLE", 50)
    assert told(vector_graph.near_duplicates(frame(spark, rows))) == want


def test_recall_is_measured(spark):
    rng = np.random.default_rng(6)
    rows = rounded(list(enumerate(groups(rng, [5] * 20, 0.1))))
    read = vector_graph._read(frame(spark, rows)).cache()
    counts = read.select("uid", F.lit(4).alias("links"))
    assert vector_graph.recall(read, counts, 0.9) == 1.0
    assert vector_graph.recall(read, counts.withColumn("links", F.lit(1)), 0.9) == 0.25
    assert vector_graph.recall(read, counts.filter("false"), 0.9) == 0.0


def test_graph_and_search():
    """Every node can be reached, lists are bounded, and the search finds what brute force finds."""
    rng = np.random.default_rng(7)
    vectors = vector_graph.unit(np.array(groups(rng, [6] * 60 + [1] * 400, 0.1)))
    graph = vector_graph.pruned(vectors)
    assert graph.shape == (len(vectors), 2 * vector_graph.EDGES + 1)
    seen, front = {0}, [0]
    while front:
        front = [x for x in {int(y) for k in front for y in graph[k] if y >= 0} if x not in seen and not seen.add(x)]
    assert len(seen) == len(vectors)
    q, at = vector_graph.searched(vectors, graph, vectors, np.full(len(vectors), 0.9), vector_graph.BEAM)
    want = {(int(x), int(y)) for x, y in zip(*np.nonzero(vectors @ vectors.T >= 0.9))}
    assert {(int(x), int(y)) for x, y in zip(q, at)} <= want and len(q) >= 0.95 * len(want)


def test_empty_table_and_query(spark):
    assert told(vector_graph.near_duplicates(frame(spark, []))) == []
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert told(queries.op11_embedding_dedup(spark, SF)) == plain(rows)


@pytest.mark.parametrize("cosine", [0.5, 0.98])
def test_other_thresholds(spark, cosine):
    rows = rounded(list(enumerate(groups(np.random.default_rng(8), [20, 5, 5, 1, 1], 0.2))))
    assert told(vector_graph.near_duplicates(frame(spark, rows), cosine)) == plain(rows, cosine)
