"""The vector index against the exact scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.operators import retrieval
from loamline.operators.vector_index import REST, VectorIndex
from loamline.session import ship


def rows_of(found):
    return [(r["store_id"], r["chunk_id"], round(r["score"], 9), r["rank"]) for r in found.orderBy("rank").collect()]


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    """Clustered vectors of three stores, one of them small, with a null, a zero and a short vector."""
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(40, 16))
    made = [(f"s{0 if k % 50 else k % 3}", f"c{k:05d}", (middle[k % 40] + 0.5 * rng.normal(size=16)).tolist(), ("a", "b")[k % 2]) for k in range(2000)]
    made += [("s1", "none", None, "a"), ("s1", "zero", [0.0] * 16, "a"), ("s1", "short", [1.0, 2.0], "b")]
    vectors = ship(spark).createDataFrame(made, "store_id string, chunk_id string, embedding array<float>, mime string")
    return vectors.cache(), VectorIndex.build(vectors.repartition(3), str(tmp_path_factory.mktemp("index") / "v")), middle


def test_every_row_is_indexed_once(held):
    vectors, index, _ = held
    assert sorted(r[0] for r in index.rows.select("chunk_id").collect()) == sorted(r[0] for r in vectors.select("chunk_id").collect())
    assert {r[0] for r in index.rows.filter(F.col("cell") == REST).select("chunk_id").collect()} == {"none", "zero", "short"}
    assert sum(index.counts.values()) == 2003 and 20 <= len(index.centres) <= 60


def test_recall_and_bytes(held, spark):
    """At least 0.9 of the exact 50 best, from a part of the files."""
    _, index, middle = held
    queries = spark.createDataFrame([(k, [float(x) for x in m]) for k, m in enumerate(middle)], "query_id int, vector array<double>")
    assert index.recall(queries, 50) >= 0.9
    every = [REST, *index.order(middle[0].tolist())]
    assert index.bytes(index.cells(middle[0].tolist(), 50, retrieval.Filters(stores=["s0"]))) < 0.6 * index.bytes(every)
    assert index.recall(queries, 50, len(index.centres)) == 1.0


def test_probing_goes_on_until_it_is_enough(held):
    """Filters widen the search; what few rows pass is found by the exact scan."""
    vectors, index, middle = held
    query = middle[3].tolist()
    exact = lambda k, f: rows_of(retrieval.leg(retrieval.dense_scores(vectors.filter("embedding is not null"), query), k, f))
    some = retrieval.Filters(stores=["s0"])
    few, more = index.cells(query, 5, some, 1), index.cells(query, 400, some, 1)
    assert len(few) < len(more) <= len(index.centres) + 1 and few == more[: len(few)]
    assert rows_of(index.search(query, 5, some)) == exact(5, some)
    rare = retrieval.Filters(stores=["s1", "s2"], mime="b")
    assert len(index.cells(query, 60, rare, 1)) == len(index.centres) + 1
    assert [r for r in rows_of(index.search(query, 60, rare, 1)) if r[1] != "none"] == exact(60, rare)


def test_empty_table(spark, tmp_path):
    empty = ship(spark).createDataFrame([], "store_id string, chunk_id string, embedding array<float>")
    index = VectorIndex.build(empty, str(tmp_path / "e"))
    assert index.search([1.0, 2.0]).count() == 0 and index.cells([1.0, 2.0], 5) == [REST]
