"""Near-duplicate vectors through a robust-pruned flat graph.

1. A bounded sample gives cluster centres and pivots: centres of dense groups. Vectors within half the angle of a link of a pivot are its ball. By the triangle
   inequality any two of them are linked, so a ball counts its links without comparing them, whatever its size, and is one node of the graph from there on.
2. Every other vector goes to the shards of its two nearest clusters, a ball's centre to three; a cluster of over SHARD_ROWS is several shards, and all its vectors are searched in each.
   A shard's graph links each vector to the pruned list of its nearest ones: robust pruning drops a candidate that a kept one is much nearer to, which leaves long edges
   for navigation; reversed edges are added. The search for each vector begins at the shard's medoid, follows the best BEAM nodes, and then expands from every node in range until no new one is.
3. Adjacency lists are united over shards, and vectors in range of each other spread what they found over them, for pairs that share no shard, until nothing is new.
4. Links of single vectors are verified by cosine in double precision. A ball and what lies near it are linked or not as a whole where angles tell, else member by member.
5. An audit counts the links of up to AUDIT vectors by brute force over all rows. Below a recall of RECALL the search is repeated with a beam twice as wide.

Pivots and centres are fit on SAMPLE rows at most, chosen by a hash of their ids; all rows are indexed and searched. Groups that the sample can't see (fewer than DENSE of its rows) are compared pair by pair.

Defined results: null, empty and zero vectors, and those with null or non-finite components, link with nothing, and vectors of different lengths don't link; repeated rows are vectors that
link with each other; a component's name is its smallest id, nulls aside; an empty table has no rows.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import Scratch, cut, small
from loamline.llm.components import connected
from loamline.session import ship

#: Rows that centres and pivots are fit on; rows of it that make a group dense; most clusters; vectors of a shard.
SAMPLE, DENSE, CLUSTERS, SHARD_ROWS = 16384, 8, 4096, 4096
#: Candidates and edges of a vector, how much nearer a kept edge has to be, and nodes that a search follows.
CANDIDATES, EDGES, ALPHA, BEAM = 48, 24, 1.2, 48
#: Vectors whose links are counted by brute force, the recall that is asked for, and how often the beam is widened.
AUDIT, RECALL, ROUNDS = 256, 0.9, 3
_SLACK = 1e-5
_BLOCK = 512


def angle(x):
    return np.arccos(np.clip(x, -1.0, 1.0))


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows over their length, in double precision; scaled first, so that squares neither overflow nor vanish."""
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


class Fit:
    """Pivots (unit vectors) and cluster centres of one length of vectors."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float):
        self.half = math.acos(cosine) / 2 - 2 * _SLACK
        self.pivots = self._pivots(sample)
        if len(self.pivots):
            loose = sample[angle((sample @ self.pivots.T).max(axis=1)) > self.half]
            sample = np.concatenate([loose, self.pivots])
        k = min(CLUSTERS, max(1, len(sample) // 4), -(-rows // (SHARD_ROWS // 2)))
        rng = np.random.Generator(np.random.PCG64(11))
        self.centres = sample[np.sort(rng.choice(len(sample), k, replace=False))]
        for _ in range(6):
            own = (sample @ self.centres.T).argmax(axis=1)
            total = np.zeros_like(self.centres)
            np.add.at(total, own, sample)
            length = np.linalg.norm(total, axis=1)
            good = length > 1e-9
            self.centres[good] = total[good] / length[good, None]

    def _pivots(self, sample: np.ndarray) -> np.ndarray:
        near = math.cos(0.9 * self.half)
        counts = np.concatenate([(sample[k : k + _BLOCK] @ sample.T >= near).sum(axis=1) for k in range(0, len(sample), _BLOCK)]) if len(sample) else np.zeros(0)
        free, found = np.ones(len(sample), bool), []
        for k in np.argsort(-counts, kind="stable").tolist():
            if counts[k] < DENSE:
                break
            if free[k]:
                group = sample[free & (sample @ sample[k] >= near)]
                if len(group) < DENSE:
                    continue
                centre = group.mean(axis=0)
                centre /= np.linalg.norm(centre)
                found.append(centre)
                free &= sample @ centre < math.cos(self.half)
        return np.array(found).reshape(len(found), sample.shape[1])

    def cells(self, vectors: np.ndarray, count: int) -> np.ndarray:
        return np.argsort(-(vectors @ self.centres.T), axis=1, kind="stable")[:, :count]


def pruned(vectors: np.ndarray) -> np.ndarray:
    """Adjacency (n, 2 * EDGES + 1), filled up with -1, of a shard's unit vectors."""
    n = len(vectors)
    m = min(CANDIDATES, n - 1)
    out = np.full((n, EDGES), -1, np.int64)
    for low in range(0, n, _BLOCK):
        block = vectors[low : low + _BLOCK]
        b = len(block)
        sims = block @ vectors.T
        sims[np.arange(b), np.arange(low, low + b)] = -2
        near = np.argpartition(-sims, m - 1, axis=1)[:, :m] if m else np.zeros((b, 0), np.int64)
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        own = angle(np.take_along_axis(sims, near, 1))
        among = vectors[near]
        between = angle(among @ among.transpose(0, 2, 1))
        alive, row = np.ones((b, m), bool), np.arange(b)
        for e in range(min(EDGES, m)):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)
            out[low + row[some], e] = near[row[some], pick[some]]
            alive &= ALPHA * between[row, pick] > own
            alive[row, pick] = False
    # Reversed edges, the first EDGES of each node; and a ring, so that every node can be reached.
    source, at = np.nonzero(out >= 0)
    target = out[source, at]
    order = np.lexsort((at, target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((n, EDGES), -1, np.int64)
    some = place < EDGES
    back[target[some], place[some]] = source[some]
    ring = np.roll(np.random.Generator(np.random.PCG64(n)).permutation(n), 1)
    follow = np.empty((n, 1), np.int64)
    follow[ring, 0] = np.roll(ring, -1)
    return np.concatenate([out, back, follow], axis=1)


def searched(vectors: np.ndarray, graph: np.ndarray, queries: np.ndarray, reach: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with a cosine of at least reach[query] + the node's own slack, found from the medoid."""
    n = len(vectors)
    centre = vectors.mean(axis=0)
    medoid = int((vectors @ centre).argmax())
    beam = min(beam, n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for low in range(0, len(queries), _BLOCK):
        block, limit = queries[low : low + _BLOCK], reach[low : low + _BLOCK]
        b = len(block)
        row = np.arange(b)
        seen = np.zeros((b, n), bool)
        seen[:, medoid] = True
        hits = np.zeros((b, n), bool)
        nodes, sims, done = np.full((b, beam), medoid), np.full((b, beam), -3.0), np.ones((b, beam), bool)
        sims[:, 0], done[:, 0] = block @ vectors[medoid], False
        hits[:, medoid] = sims[:, 0] >= limit
        while True:
            open_ = np.where(done, -9.0, sims)
            pick = open_.argmax(axis=1)
            live = np.flatnonzero(~done[row, pick])
            if not len(live):
                break
            done[live, pick[live]] = True
            next_ = graph[nodes[live, pick[live]]]
            fresh = (next_ >= 0) & ~seen[live[:, None], next_]
            seen[np.repeat(live, next_.shape[1])[fresh.ravel()], next_[fresh]] = True
            sim = np.where(fresh, np.einsum("qed,qd->qe", vectors[next_], block[live]), -3.0)
            inside = fresh & (sim >= limit[live, None])
            hits[np.repeat(live, next_.shape[1])[inside.ravel()], next_[inside]] = True
            # The same node may stand twice in a list: its second place counts as seen only from the next round on, and does no harm but for a place in the beam.
            nodes_, sims_, done_ = np.concatenate([nodes[live], next_], 1), np.concatenate([sims[live], sim], 1), np.concatenate([done[live], ~fresh], 1)
            best = np.argsort(-sims_, axis=1, kind="stable")[:, :beam]
            nodes[live], sims[live], done[live] = (np.take_along_axis(x, best, 1) for x in (nodes_, sims_, done_))
        # Range expansion: from every node in range over all its edges.
        for q in np.flatnonzero(hits.any(axis=1)).tolist():
            front = np.flatnonzero(hits[q])
            while len(front):
                next_ = np.unique(graph[front])
                next_ = next_[(next_ >= 0)]
                next_ = next_[~hits[q, next_]]
                front = next_[vectors[next_] @ block[q] >= limit[q]]
                hits[q, front] = True
        a, c = np.nonzero(hits)
        found.append((a + low, c))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), length)


def _fits(rows: DataFrame, cosine: float) -> dict[int, Fit]:
    """A Fit for each length of vectors that the sample holds. Only sampled vectors come to the driver."""
    total = rows.count()
    share = F.lit(1.0) if total <= SAMPLE else F.lit(SAMPLE / total)
    drawn = rows.filter(F.abs(F.xxhash64("uid") % 1_000_003) < share * 1_000_003).select("length", "vec").limit(2 * SAMPLE).toArrow()
    fits, lengths = {}, np.array(drawn.column("length").to_pylist(), np.int64)
    for length in np.unique(lengths).tolist():
        some = drawn.filter(pa.array(lengths == length)).column("vec")
        sample = _matrix(some.combine_chunks() if isinstance(some, pa.ChunkedArray) else some, length)
        fits[length] = Fit(sample, max(1, round(total * len(sample) / max(1, drawn.num_rows))), cosine)
    return fits


def _read(vectors: DataFrame) -> DataFrame:
    """uid, vec_id, length and vec (a unit vector as bytes of doubles; null if it can link with nothing) of each row."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lengths, vecs = [], []
            for x in batch.column(2).to_pylist():
                row = np.array([np.nan if v is None else v for v in x], np.float64) if x else np.zeros(0)
                good = len(row) > 0 and bool(np.isfinite(row).all()) and bool(row.any())
                lengths.append(len(row) if good else None)
                vecs.append(unit(row[None])[0].tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int32()), pa.array(vecs, pa.binary())], ["uid", "vec_id", "length", "vec"])

    return vectors.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.col("embedding").cast("array<double>")).mapInArrow(run, f"uid long, vec_id {kind}, length int, vec binary")


def _assigned(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """uid, length, vec, ball (a name below zero, or null), away (angle to its pivot) and cells of each vector that can link."""
    context = rows.sparkSession.sparkContext
    shared, base = context.broadcast(fits), _bases(fits)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            ball, away, cells = [None] * n, [None] * n, [[-1]] * n
            lengths = np.array(batch.column(1).to_pylist(), np.int64)
            for length in np.unique(lengths).tolist():
                fit = shared.value.get(length)
                some = np.flatnonzero(lengths == length)
                if fit is None:
                    continue
                vectors = _matrix(batch.column(2).take(pa.array(some)), length)
                for k, c in zip(some.tolist(), fit.cells(vectors, 2).tolist(), strict=True):
                    cells[k] = c
                if len(fit.pivots):
                    near = vectors @ fit.pivots.T
                    best = near.argmax(axis=1)
                    far = angle(near[np.arange(len(some)), best])
                    for k, p, a in zip(some.tolist(), best.tolist(), far.tolist(), strict=True):
                        if a <= fit.half:
                            ball[k], away[k] = base[length] - p, a
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(ball, pa.int64()), pa.array(away, pa.float64()), pa.array(cells, pa.list_(pa.int32()))], ["uid", "length", "vec", "ball", "away", "cells"])

    return rows.select("uid", "length", "vec").mapInArrow(run, "uid long, length int, vec binary, ball long, away double, cells array<int>")


def _bases(fits: dict[int, Fit]) -> dict[int, int]:
    """The name of each length's first pivot; the next ones count down."""
    out, at = {}, -1
    for length in sorted(fits):
        out[length] = at
        at -= len(fits[length].pivots)
    return out


def _nodes(assigned: DataFrame, fits: dict[int, Fit]) -> tuple[DataFrame, DataFrame]:
    """(nodes, balls): name, length, vec, radius, cells of single vectors and balls; name, size, radius and low of balls, of which there are at most SAMPLE / DENSE."""
    spark, base = assigned.sparkSession, _bases(fits)
    balls = cut(assigned.filter("ball is not null").groupBy(F.col("ball").alias("name")).agg(F.count("*").alias("size"), F.max("away").alias("radius")))
    held = [(base[length] - p, length, bytearray(v.tobytes()), fit.cells(v[None], 3)[0].tolist()) for length, fit in fits.items() for p, v in enumerate(fit.pivots)]
    centres = spark.createDataFrame(held, "name long, length int, vec binary, cells array<int>")
    singles = assigned.filter("ball is null").select(F.col("uid").alias("name"), "length", "vec", F.lit(0.0).alias("radius"), "cells")
    return singles.unionByName(centres.join(balls, "name").select("name", "length", "vec", "radius", "cells")), balls


def _met(nodes: DataFrame, cosine: float, widest: float, beam: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pairs, edges): a, b, dot of nodes in range of each other in a shard; node, next and cells of the united adjacency lists."""
    link = math.acos(cosine)
    spread = nodes.withColumn("cell", F.explode("cells"))
    parts = small(spread.groupBy("length", "cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / SHARD_ROWS)).cast("int").alias("parts")))
    spread = spread.join(parts, ["length", "cell"])
    # Every vector is searched in each part of its cells; it is a node of one.
    spread = spread.select("name", "length", "vec", "radius", "cells", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.expr("pmod(xxhash64(name), parts)").cast("int").alias("home"))
    spread = scratch.cut(spread.withColumn("own", F.col("home") == F.col("part")).drop("home"))

    def shard(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        length = keys[0].as_py()
        own = np.array(rows.column("own").to_pylist(), bool)
        names, radius = np.array(rows.column("name").to_pylist(), np.int64), np.array(rows.column("radius").to_pylist(), np.float64)
        vectors = _matrix(rows.column("vec").combine_chunks() if isinstance(rows.column("vec"), pa.ChunkedArray) else rows.column("vec"), length)
        order = np.argsort(names, kind="stable")
        own, names, radius, vectors = own[order], names[order], radius[order], vectors[order]
        cells = rows.column("cells").take(pa.array(order)).to_pylist()
        nodes = np.flatnonzero(own)
        nothing: list = []
        if len(nodes):
            graph = pruned(vectors[nodes])
            # A ball reaches as far as its farthest member and that of what it meets.
            reach = np.cos(np.minimum(math.pi, link + radius + widest + _SLACK))
            q, at = searched(vectors[nodes], graph, vectors, reach, beam)
            at = nodes[at]
            dots = np.einsum("kd,kd->k", vectors[q], vectors[at]) if len(q) else np.zeros(0)
            near = (names[q] != names[at]) & (angle(dots) <= link + radius[q] + radius[at] + _SLACK)
            q, at, dots = q[near], at[near], dots[near]
            source, place = np.nonzero(graph >= 0)
            edges = (names[nodes[source]], names[nodes[graph[source, place]]], [cells[k] for k in nodes[graph[source, place]].tolist()])
        else:
            q, at, dots, edges = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), (nothing, nothing, nothing)
        flags = pa.array([True] * len(q) + [False] * len(edges[0]))
        yield pa.RecordBatch.from_arrays(
            [
                flags,
                pa.array(np.concatenate([np.minimum(names[q], names[at]), np.asarray(edges[0], np.int64)])),
                pa.array(np.concatenate([np.maximum(names[q], names[at]), np.asarray(edges[1], np.int64)])),
                pa.array(np.concatenate([dots, np.zeros(len(edges[0]))])),
                pa.array([None] * len(q) + list(edges[2]), pa.list_(pa.int32())),
            ],
            ["pair", "a", "b", "dot", "cells"],
        )

    both = scratch.cut(spread.groupBy("length", "cell", "part").applyInArrow(shard, "pair boolean, a long, b long, dot double, cells array<int>"))
    pairs = both.filter("pair").groupBy("a", "b").agg(F.max("dot").alias("dot"))
    edges = both.filter("not pair").select(F.col("a").alias("node"), F.col("b").alias("next"), "cells").distinct()
    return scratch.cut(pairs), edges


def _spread(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """pairs, and those that come of following the united edges of a node in range to nodes in other shards, until none is new."""
    link, known, front = math.acos(cosine), pairs, pairs
    kinds = nodes.select("name", "length", "vec", "radius", "cells")
    while True:
        both = front.select("a", "b").unionByName(front.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.join(edges, F.col("b") == F.col("node")).filter("a <> next").select(F.least("a", "next").alias("a"), F.greatest("a", "next").alias("b"), F.col("a").alias("from"), "cells")
        step = step.join(nodes.select(F.col("name").alias("from"), F.col("cells").alias("has")), "from").filter(~F.arrays_overlap("cells", "has")).select("a", "b").distinct()
        step = step.join(known, ["a", "b"], "left_anti")
        left, right = (kinds.select(*(F.col(c).alias(f"{c}_{s}") for c in kinds.columns)) for s in "ab")
        step = step.join(left, F.col("a") == F.col("name_a")).join(right, (F.col("b") == F.col("name_b")) & (F.col("length_a") == F.col("length_b")))
        front = scratch.cut(_dots(step.select("a", "b", F.col("vec_a").alias("x"), F.col("vec_b").alias("y"), (F.col("radius_a") + F.col("radius_b")).alias("more"))).filter(F.acos(F.least(F.lit(1.0), "dot")) <= link + F.col("more") + _SLACK).select("a", "b", "dot"))
        if front.isEmpty():
            return known
        known = scratch.cut(known.unionByName(front))


def _dots(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, x, y, more) with dot in place of x and y."""

    def run(batches):
        for batch in batches:
            dots = [float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dots, pa.float64()), batch.column(4)], ["a", "b", "dot", "more"])

    return pairs.mapInArrow(run, "a long, b long, dot double, more double")


def _links(assigned: DataFrame, fits: dict[int, Fit], cosine: float, beam: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(links, edges): uid and links of each vector with some, and a, b between nodes of one component."""
    link = math.acos(cosine)
    nodes, balls = _nodes(assigned, fits)
    nodes = scratch.cut(nodes)
    widest = float(balls.agg(F.max("radius")).first()[0] or 0.0)
    pairs, edges = _met(nodes, cosine, widest, beam, scratch)
    pairs = _spread(pairs, edges, nodes, cosine, scratch)
    sizes = F.broadcast(balls)  # at most SAMPLE / DENSE rows
    told = pairs.join(sizes.select(F.col("name").alias("a"), F.col("size").alias("size_a"), F.col("radius").alias("radius_a")), "a", "left").join(sizes.select(F.col("name").alias("b"), F.col("size").alias("size_b"), F.col("radius").alias("radius_b")), "b", "left")
    wide = F.coalesce("radius_a", F.lit(0.0)) + F.coalesce("radius_b", F.lit(0.0))
    alone = F.col("size_a").isNull() & F.col("size_b").isNull()
    whole = F.when(alone, F.col("dot") >= cosine).otherwise(F.acos(F.least(F.lit(1.0), "dot")) + wide <= link - _SLACK)
    told = scratch.cut(told.select("a", "b", F.coalesce("size_a", F.lit(1)).alias("n_a"), F.coalesce("size_b", F.lit(1)).alias("n_b"), whole.alias("whole"), alone.alias("alone")))
    sure, open_ = told.filter("whole"), told.filter("not whole and not alone")
    # Where angles don't tell, members are compared one by one.
    member = assigned.select(F.coalesce("ball", "uid").alias("name"), "uid", "vec")
    one = small(open_.select("a", "b")).join(member.select(F.col("name").alias("a"), F.col("uid").alias("u"), F.col("vec").alias("x")), "a")
    two = scratch.cut(one).join(member.select(F.col("name").alias("b"), F.col("uid").alias("v"), F.col("vec").alias("y")), "b")
    single = scratch.cut(_dots(two.select(F.col("u").alias("a"), F.col("v").alias("b"), "x", "y", F.lit(0.0).alias("more"))).filter(F.col("dot") >= cosine).select("a", "b"))

    by_node = sure.select(F.col("a").alias("name"), F.col("n_b").alias("n")).unionByName(sure.select(F.col("b").alias("name"), F.col("n_a").alias("n"))).unionByName(balls.select("name", (F.col("size") - 1).alias("n")))
    by_node = by_node.groupBy("name").agg(F.sum("n").alias("n"))
    by_row = single.select(F.col("a").alias("uid"), F.lit(1).alias("n")).unionByName(single.select(F.col("b").alias("uid"), F.lit(1).alias("n")))
    named = assigned.select("uid", F.coalesce("ball", "uid").alias("name"))
    counts = named.join(by_node, "name").select("uid", "n").unionByName(by_row).groupBy("uid").agg(F.sum("n").alias("links"))
    node = lambda c: F.col(c)
    member_edges = single.join(named.select(F.col("uid").alias("a"), F.col("name").alias("p")), "a").join(named.select(F.col("uid").alias("b"), F.col("name").alias("q")), "b").select(node("p").alias("a"), node("q").alias("b"))
    return scratch.cut(counts), scratch.cut(sure.select("a", "b").unionByName(member_edges).distinct())


def recall(rows: DataFrame, counts: DataFrame, cosine: float, most: int = AUDIT) -> float:
    """The share of links of up to most vectors, chosen by a hash, that counts has: their true number by brute force over all rows."""
    asked = rows.withColumn("rank", F.xxhash64("uid", F.lit(5))).orderBy("rank").limit(most).join(counts, "uid", "left").select("uid", "length", "vec", F.coalesce("links", F.lit(0)).alias("links")).collect()
    shared = rows.sparkSession.sparkContext.broadcast([(r["length"], np.frombuffer(bytes(r["vec"]), np.float64)) for r in asked])

    def run(batches):
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            lengths = np.array(batch.column(0).to_pylist(), np.int64)
            for length in np.unique(lengths).tolist():
                vectors = _matrix(batch.column(1).take(pa.array(np.flatnonzero(lengths == length))), length)
                some = [k for k, (own, _) in enumerate(shared.value) if own == length]
                if some:
                    total[some] += (vectors @ np.array([shared.value[k][1] for k in some]).T >= cosine).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "n"])

    true = {r["k"]: r["n"] - 1 for r in rows.select("length", "vec").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    all_, met = sum(true.values()), sum(min(true.get(k, 0), r["links"]) for k, r in enumerate(asked))
    return met / all_ if all_ else 1.0


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for each row."""
    plain = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    with Scratch(ship(plain.sparkSession)) as scratch:
        read = scratch.cut(_read(plain))
        rows = read.filter("vec is not null")
        fits = _fits(rows, cosine)
        assigned = scratch.cut(_assigned(rows, fits))
        for k in range(ROUNDS):
            counts, edges = _links(assigned, fits, cosine, beam << k, scratch)
            if recall(assigned, counts, cosine) >= RECALL:
                break
        roots = connected(edges, scratch)
        named = read.join(assigned.select("uid", F.coalesce("ball", "uid").alias("name")), "uid", "left")
        named = scratch.cut(named.join(roots.withColumnRenamed("node", "name"), "name", "left").select("uid", "vec_id", F.coalesce("root", "name").alias("root")))
        lows = scratch.cut(named.filter("root is not null").groupBy("root").agg(F.min("vec_id").alias("low")))
        out = named.join(lows, "root", "left").join(counts, "uid", "left")
        out = cut(out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
