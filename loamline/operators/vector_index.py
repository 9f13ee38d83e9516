"""A vector index for the dense leg: vectors by the cell of their nearest centre, so that a query reads a few cells in place of all.

A search probes the nearest cells and doubles their number until every store asked for has its k rows that pass the filters, or all it holds; once all cells are probed it is the exact scan.
Centres are given, or fit on SAMPLE vectors at most; all vectors are indexed. How many rows of each store a cell holds is kept beside, so that a search without further
filters reads no vector to decide how far to go.

Defined results: vectors that are null, zero or of another length than the centres lie in the cell REST, which every search reads, so they score as they do without an index; an empty table has no hits.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.functions import vectors as vec
from loamline.operators import retrieval
from loamline.session import ship

#: Vectors that centres are fit on, most cells, rounds of fitting, and rows that one file of a cell should hold.
SAMPLE, CELLS, FITS, FILE_ROWS = 20_000, 4096, 8, 1 << 18
PROBES = 8
#: Decimals to which centres are equally near: products that differ by rounding alone are ties, and go by cell.
NEAR = 9
REST = -1


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


def fit(vectors: DataFrame, cells: int | None = None) -> np.ndarray:
    """Unit centres, by k-means on a sample by hash of the ids; about the square root of the rows, unless cells says how many."""
    good = vectors.filter("embedding IS NOT NULL AND size(embedding) > 0")
    total = good.count()
    if not total:
        return np.zeros((0, 0))
    drawn = good.filter(F.pmod(F.xxhash64("store_id", "chunk_id"), F.lit(1_000_003)) <= min(1.0, SAMPLE / total) * 1_000_003).select("embedding").limit(2 * SAMPLE).collect()
    size = max(len(r[0]) for r in drawn)
    sample = _unit(np.array([r[0] for r in drawn if len(r[0]) == size], float))
    k = min(cells or max(1, round(total**0.5)), CELLS, len(sample))
    centres = sample[np.sort(np.random.Generator(np.random.PCG64(3)).choice(len(sample), k, replace=False))]
    for _ in range(FITS):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        some = np.linalg.norm(sums, axis=1) > 1e-9
        centres[some] = _unit(sums[some])
    return centres


class VectorIndex:
    """rows (all columns given and cell), held by cell; counts by cell and store; and the centres."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{self.root}/{name}")
        self._centres = read("centres", "cell int, centre array<double>")
        found = self._centres.orderBy("cell").collect()  # at most CELLS
        self.centres = np.array([r["centre"] for r in found], float) if found else np.zeros((0, 0))
        self.counts = {(r["cell"], r["store_id"]): r["n"] for r in read("counts", "cell int, store_id string, n long").collect()}  # at most CELLS for each store
        self.rows = read("rows", T.StructType.fromJson(json.loads(spark.read.text(f"{self.root}/schema", wholetext=True).first()[0])))

    @classmethod
    def build(cls, vectors: DataFrame, root: str, centres: np.ndarray | None = None) -> VectorIndex:
        """Index vectors (store_id, chunk_id, embedding, and whatever filters ask for) below root, which must be new."""
        spark = ship(vectors.sparkSession)
        centres = fit(vectors) if centres is None else _unit(np.asarray(centres, float))
        shared, columns = spark.sparkContext.broadcast(centres), vectors.columns
        at = columns.index("embedding")

        def place(batches):
            for batch in batches:
                cells = np.full(batch.num_rows, REST)
                values = batch.column(at).to_pylist()
                fits = [k for k, x in enumerate(values) if x and len(x) == shared.value.shape[1] and None not in x and any(x)]
                if fits and len(shared.value):
                    cells[fits] = np.round(_unit(np.array([values[k] for k in fits], float)) @ shared.value.T, NEAR).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], [*columns, "cell"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
        placed = vectors.mapInArrow(place, f"{kinds}, cell int")
        total = sum(1 for _ in centres) or 1
        # A cell's rows are dealt over as many tasks as its share of all rows asks for, so a hot cell is several files.
        salt = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-vectors.count() // (FILE_ROWS * total)) * 4)))
        placed.repartition("cell", salt).sortWithinPartitions("cell", "store_id").write.partitionBy("cell").parquet(f"{root}/rows")
        spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{root}/centres")
        spark.createDataFrame([(placed.schema.json(),)], "schema string").coalesce(1).write.text(f"{root}/schema")
        spark.read.schema(placed.schema).parquet(f"{root}/rows").groupBy("cell", "store_id").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{root}/counts")
        return cls(spark, root)

    def order(self, query: list[float]) -> list[int]:
        """All cells, nearest first; REST is part of each search."""
        if not len(self.centres) or len(query) != self.centres.shape[1]:
            return list(range(len(self.centres)))
        return np.argsort(-np.round(self.centres @ np.asarray(query, float), NEAR), kind="stable").tolist()

    def cells(self, query: list[float], k: int, filters: retrieval.Filters | None = None, probes: int = PROBES) -> list[int]:
        """The cells that a search reads."""
        order, scope = self.order(query), filters.stores if filters else None
        only_stores = filters is None or filters == retrieval.Filters(stores=scope)
        stores = {s for _, s in self.counts if scope is None or s in scope}
        need = {s: min(k, sum(n for (_, t), n in self.counts.items() if t == s)) for s in stores}
        n = probes
        while n < len(order):
            some = [REST, *order[:n]]
            if only_stores:
                held = {s: sum(self.counts.get((c, s), 0) for c in some) for s in stores}
            else:
                held = {r["store_id"]: r["n"] for r in self.rows.filter(F.col("cell").isin(some) & filters.condition()).groupBy("store_id").agg(F.count("*").alias("n")).collect()}
            if all(held.get(s, 0) >= need[s] for s in stores):
                return some
            n *= 2
        return [REST, *order]

    def search(self, query: list[float], k: int = retrieval.LEG_K, filters: retrieval.Filters | None = None, probes: int = PROBES, encoding: str = "f32") -> DataFrame:
        """retrieval.leg() of the cells read: store_id, chunk_id, score, rank."""
        some = self.rows.filter(F.col("cell").isin(self.cells(query, k, filters, probes)))
        return retrieval.leg(retrieval.dense_scores(some, query, encoding), k, filters)

    def search_many(self, queries: DataFrame, k: int = retrieval.LEG_K, probes: int = PROBES) -> DataFrame:
        """query_id, store_id, chunk_id, score, rank (from 0) of the k best rows for each of queries (query_id, vector), by the probes nearest cells; queries meet cells, never all rows."""
        # At most CELLS centres meet each query.
        near = queries.join(F.broadcast(self._centres)).withColumn("close", F.round(vec.dot(F.col("vector"), F.col("centre")), NEAR))
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("close"), "cell"))).filter(F.col("r") <= probes).select("query_id", "vector", "cell")
        near = near.unionByName(queries.select("query_id", "vector", F.lit(REST).alias("cell")))
        return _best(self.rows.select("store_id", "chunk_id", "embedding", "cell").join(near, "cell"), k)

    def exact_many(self, queries: DataFrame, k: int = retrieval.LEG_K) -> DataFrame:
        """search_many() against all rows: for measuring; queries are a stated set."""
        return _best(self.rows.select("store_id", "chunk_id", "embedding").join(F.broadcast(queries)), k)

    def recall(self, queries: DataFrame, k: int = retrieval.LEG_K, probes: int = PROBES) -> float:
        """The share of exact_many()'s rows that search_many() finds."""
        exact, found = self.exact_many(queries, k), self.search_many(queries, k, probes)
        key = ["query_id", "store_id", "chunk_id"]
        n = exact.count()
        return exact.join(found.select(*key), key, "left_semi").count() / n if n else 1.0

    def bytes(self, cells: list[int]) -> int:
        """Bytes of files in the cells."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        held = (path(f"{self.root}/rows/cell={c}") for c in cells)
        return sum(fs.getContentSummary(p).getLength() for p in held if fs.exists(p))


def _best(met: DataFrame, k: int) -> DataFrame:
    score: Column = vec.cosine_score(F.col("embedding"), F.col("vector"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "store_id", "chunk_id")
    return met.select("query_id", "store_id", "chunk_id", score.alias("score")).withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)
