"""Merkle manifest of a dataset: a proof for each row that it is what the dataset's root digest stands for.

A row's leaf is the SHA-256 of its columns. The leaves of a group (such as a language) ascend by id; every FANOUT consecutive nodes
become the digest of their concatenation until one is left, the group's subroot; the subroots of all groups, by name, likewise give the root.

1. Ranks come from digit histograms, not from a sort of all rows. Ids are counted by group and id >> 8; those counts are summed up digit
   by digit (16 bits each) to the group's total, and on the way down a running sum over the siblings below one parent gives each
   bucket the rank of its first row. Within a bucket of 256 ids rows are numbered. Equal rows are one with a count before that, and a bucket of
   over HEAVY different rows (many texts under one id) is counted by further digits, the id's last byte and the leaf's first 16 bits, too.
2. The rank's digits in base FANOUT key the nodes of a trie. Nodes with a common prefix of all but DIGITS digits lie in one block (1,024 leaves at
   fanout 2), which one task reduces level by level; block digests are the next tier's nodes, so 10^10 rows take four tiers.
   A row's proof is its siblings below its block's digest, then those of its block, its block's block, its group.

Texts stay where they are read: what travels is ids and digests, some 150 bytes a row.

Defined results: null ids come first in their group, and ties go by leaf; equal rows get a leaf each; a null group is one of its own, ahead of all others;
null columns hash as '-', empty texts as '0:'; an empty table has no rows; further columns are ignored.
"""

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import Scratch, cut
from loamline.session import ship

FANOUT = 2
#: Leaves of a block are FANOUT to the power of so many digits, at most this many.
BLOCK = 1024
#: Different rows of a bucket beyond which it is divided by further digits.
HEAVY = 1 << 15
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: Sequence[Column]) -> Column:
    """SHA-256, in hexadecimal digits, of the values: '-' for null, else the number of UTF-8 bytes, ':' and the text."""
    one = lambda v: F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, values)).cast("binary"), 256)


def ranked(rows: DataFrame, digits: list[Column], order: list[Column], scratch: Scratch, heavy: int = HEAVY, more: Sequence[Column] = ()) -> DataFrame:
    """rows (grp, m, ...) with rank, of the first of its m copies in its group, and n, the group's copies in all.

    digits are nested, coarse to fine, and none is null; order ranks what agrees in all of them. Where more than heavy rows do, they are counted by more as well.
    """
    names = [f"d{k}" for k in range(len(digits))]
    rows = scratch.cut(rows.withColumns(dict(zip(names, digits, strict=True))))
    counts = scratch.cut(rows.groupBy("grp", *names).agg(F.sum("m").alias("n"), F.count("*").alias("rows")))
    if more and not (full := counts.filter(F.col("rows") > heavy).select("grp", *names, F.lit(True).alias("full"))).isEmpty():
        extra = [f"e{k}" for k in range(len(more))]
        rows = rows.join(full, ["grp", *names], "left").withColumns({e: F.coalesce(F.when(F.col("full"), x), F.lit(0)) for e, x in zip(extra, more, strict=True)}).drop("full")
        names += extra
        rows = scratch.cut(rows)
        counts = scratch.cut(rows.groupBy("grp", *names).agg(F.sum("m").alias("n")))
    # Up: sums by ever fewer digits. Down: a parent's first rank and a running sum over its children, at most 2^16 of them.
    levels = [counts.select("grp", *names, "n")]
    for k in range(len(names) - 1, -1, -1):
        levels.append(levels[-1].groupBy("grp", *names[:k]).agg(F.sum("n").alias("n")))
    first = levels[-1].select("grp", F.col("n").alias("total"), F.lit(0).cast("long").alias("first"))
    for k, level in enumerate(reversed(levels[:-1])):
        before = Window.partitionBy("grp", *names[:k]).orderBy(names[k]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.join(first, ["grp", *names[:k]])
        first = level.select("grp", *names[: k + 1], "total", (F.col("first") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("first"))
    within = Window.partitionBy("grp", *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(scratch.cut(first), ["grp", *names])
    return out.select(*(c for c in rows.columns if c not in names), (F.col("first") + F.coalesce(F.sum("m").over(within), F.lit(0))).alias("rank"), F.col("total").alias("n"))


def digest(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def subtree(nodes: list[str], whole: bool, fanout: int, digits: int) -> list[list[str]]:
    """The levels above and including nodes: digits of them, or as many as it takes until one node is left if the nodes are whole, all of a tree's."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= digits:
        below = levels[-1]
        levels.append([digest(below[k : k + fanout]) for k in range(0, len(below), fanout)])
    return levels


def siblings(levels: list[list[str]], at: int, fanout: int) -> list[tuple[list[str], list[str]]]:
    """For each level below the last: the nodes to the left and to the right of node at's ancestor in its run."""
    out = []
    for level in levels[:-1]:
        run = at - at % fanout
        out.append((level[run:at], level[at + 1 : run + fanout]))
        at //= fanout
    return out


def fold(node: str, steps: list[tuple[list[str], list[str]]]) -> str:
    for left, right in steps:
        node = digest([*left, node, *right])
    return node


_STEPS = "array<struct<left:array<string>,right:array<string>>>"


def _told(steps) -> list[dict]:
    return [{"left": a, "right": b} for a, b in steps]


def _steps(told) -> list[tuple[list[str], list[str]]]:
    return [(x["left"], x["right"]) for x in told or ()]


def _blocks(nodes: DataFrame, size: int, kept: Sequence[str]) -> DataFrame:
    """grp, block, n (nodes of the group) and nodes: the block's, at most size of them, in order."""
    return nodes.groupBy("grp", F.floor(F.col("rank") / size).cast("long").alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("rank", *kept))).alias("nodes"))


def _raised(blocks: DataFrame, fanout: int, digits: int) -> DataFrame:
    """grp, rank, n and leaf of the next tier's nodes, one for each block."""

    def run(batches):
        for batch in batches:
            found = []
            for n, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found.append(subtree([x["leaf"] for x in nodes], n <= fanout**digits, fanout, digits)[-1][0])
            above = pa.array([-(-n // fanout**digits) for n in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), above, pa.array(found, pa.string())], ["grp", "rank", "n", "leaf"])

    return blocks.select("grp", "block", "n", F.transform("nodes", lambda x: F.struct(x["leaf"].alias("leaf"))).alias("nodes")).mapInArrow(run, "grp string, rank long, n long, leaf string")


def _paths(blocks: DataFrame, fanout: int, digits: int) -> DataFrame:
    """grp, rank and steps (to its block's digest) of each node."""
    kind = pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))

    def run(batches):
        for batch in batches:
            for grp, n, nodes in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                levels = subtree([x["leaf"] for x in nodes], n <= fanout**digits, fanout, digits)
                steps = [_told(siblings(levels, k, fanout)) for k in range(len(nodes))]
                yield pa.RecordBatch.from_arrays([pa.array([grp] * len(nodes), pa.string()), pa.array([x["rank"] for x in nodes], pa.int64()), pa.array(steps, kind)], ["grp", "rank", "steps"])

    return blocks.mapInArrow(run, f"grp string, rank long, steps {_STEPS}")


def climbed(nodes: DataFrame, fanout: int, digits: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, paths, tops) of nodes (grp, rank, n, leaf and more): the lowest tier's blocks, grp, block and steps from a block's digest to the
    top of its group, and grp and top."""
    kept = [c for c in nodes.columns if c not in ("grp", "rank", "n")]
    size, most = fanout**digits, nodes.agg(F.max("n")).first()[0] or 0
    blocks = lowest = scratch.cut(_blocks(nodes, size, kept))
    tiers: list[DataFrame] = []
    raised = scratch.cut(_raised(blocks, fanout, digits))
    while most > size:
        most = -(-most // size)
        blocks = scratch.cut(_blocks(raised.filter("n > 1"), size, ["leaf"]))
        tiers.append(_paths(blocks, fanout, digits))
        again = _raised(blocks, fanout, digits)
        raised = scratch.cut(again.unionByName(raised.filter("n = 1")))
    tops = raised.select("grp", F.col("leaf").alias("top"))
    paths = None
    for tier in reversed(tiers):
        if paths is not None:
            tier = tier.withColumn("block", F.floor(F.col("rank") / size).cast("long")).join(paths, ["grp", "block"], "left")
            tier = tier.select("grp", "rank", F.concat("steps", F.coalesce("above", F.array().cast(_STEPS))).alias("steps"))
        paths = tier.select("grp", F.col("rank").alias("block"), F.col("steps").alias("above"))
    if paths is None:
        paths = lowest.select("grp", "block", F.array().cast(_STEPS).alias("above")).filter("false")
    return lowest, scratch.cut(paths), tops


def manifest(rows: DataFrame, fanout: int = FANOUT, block: int = BLOCK, heavy: int = HEAVY) -> DataFrame:
    """For rows (id long, grp string, leaf, probe: the leaf that is to be verified, null for the leaf itself): id, leaf, subroot, root, steps (the proof,
    from the leaf up: what lies left and right in its run), folded (the root that probe and proof give) and verified."""
    digits = 1
    while fanout ** (digits + 1) <= block:
        digits += 1
    spark = ship(rows.sparkSession)
    kind = pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))
    with Scratch(spark) as scratch:
        # '' for a null group: ahead of all others, which begin with '+'.
        named = rows.select(F.coalesce(F.concat(F.lit("+"), "grp"), F.lit("")).alias("grp"), F.col("id").cast("long").alias("id"), "leaf", "probe")
        copies = named.groupBy("grp", "id", "leaf", "probe").agg(F.count("*").alias("m"))
        b8 = F.coalesce(F.shiftright("id", 8), F.lit(-129 << 48))
        parts = [F.shiftright(b8, k) for k in (48, 32, 16, 0)]
        further = [F.coalesce(F.col("id").bitwiseAND(F.lit(255)), F.lit(-1)).cast("long"), F.conv(F.substring("leaf", 1, 4), 16, 10).cast("long")]
        order = [F.col("id").asc_nulls_first(), F.col("leaf"), F.col("probe")]
        one = ranked(copies, parts, order, scratch, heavy, further)
        # Copies: each at a rank of its own.
        one = one.select("grp", "n", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("m") - 1)).alias("rank"), "leaf", "id", "probe")
        leaves, paths, subroots = climbed(one, fanout, digits, scratch)

        hexed = F.rpad(F.hex(F.encode("name", "UTF-8")), 16, "0")
        groups = subroots.select(F.lit("").alias("grp"), F.lit(1).cast("long").alias("m"), F.col("grp").alias("name"), F.col("top").alias("leaf"))
        numbers = [F.conv(F.substring(hexed, 1 + 4 * k, 4), 16, 10).cast("long") for k in range(4)]
        groups = scratch.cut(ranked(groups, numbers, [F.col("name")], scratch).drop("m"))
        tops, above, root = climbed(groups, fanout, digits, scratch)
        named = _paths(tops, fanout, digits).withColumn("block", F.floor(F.col("rank") / fanout**digits).cast("long")).join(above, ["grp", "block"], "left")
        named = named.select("rank", F.concat("steps", F.coalesce("above", F.array().cast(_STEPS))).alias("outer"))
        groups = scratch.cut(groups.join(named, "rank").join(root.select("grp", F.col("top").alias("root")), "grp").select(F.col("name").alias("grp"), F.col("leaf").alias("subroot"), "outer", "root"))

        whole = leaves.join(paths, ["grp", "block"], "left").join(groups, "grp").select("n", "nodes", "above", "outer", "subroot", "root")

        def run(batches):
            names = ["id", "leaf", "subroot", "root", "steps", "folded"]
            for batch in batches:
                for n, nodes, inner, outer, subroot, root in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    levels = subtree([x["leaf"] for x in nodes], n <= fanout**digits, fanout, digits)
                    above, known = [*_steps(inner), *_steps(outer)], {}
                    steps, folded = [], []
                    for k, x in enumerate(nodes):
                        own = siblings(levels, k, fanout)
                        steps.append(_told([*own, *above]))
                        low = fold(x["leaf"] if x["probe"] is None else x["probe"], own)
                        if low not in known:
                            known[low] = fold(low, above)
                        folded.append(known[low])
                    m = len(nodes)
                    columns = [pa.array([x["id"] for x in nodes], pa.int64()), pa.array([x["leaf"] for x in nodes]), pa.array([subroot] * m), pa.array([root] * m), pa.array(steps, kind), pa.array(folded)]
                    yield pa.RecordBatch.from_arrays(columns, names)

        out = cut(whole.mapInArrow(run, f"id long, leaf string, subroot string, root string, steps {_STEPS}, folded string"))
    return out.withColumn("verified", F.col("folded") == F.col("root"))


def documents_manifest(documents: DataFrame, fanout: int = FANOUT, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", count_col: str = "n_chars", tampered: Column | None = None) -> DataFrame:
    """manifest() of documents; rows for which tampered holds are verified with one more in count_col than they have."""
    values = [F.col(c) for c in fields]
    changed = [F.col(c) + 1 if c == count_col else F.col(c) for c in fields]
    probe = F.when(tampered, leaf(changed)) if tampered is not None else F.lit(None).cast("string")
    return manifest(documents.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf(values).alias("leaf"), probe.alias("probe")), fanout)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns: the proof as the digest of its siblings, left to right, level by level."""
    beside = F.concat_ws("", F.flatten(F.transform("steps", lambda s: F.concat(s["left"], s["right"]))))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(beside.cast("binary"), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")
