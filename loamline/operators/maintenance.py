"""Keeping a store in step with its sources: what to do with each document, and doing it.

Rows are immutable files, so a change is a new snapshot: plans are joins, and applying one is an anti join and a union.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.operators import retrieval

KEYS = {"stores": ["store_id"], "sources": ["source_id"], "resources": ["store_id", "resource_id"], "blocks": ["store_id", "resource_id", "seq"], "chunks": ["store_id", "chunk_id"]}


def plan_changes(current: DataFrame, observed: DataFrame, gone: DataFrame | None, policy: str, prune: bool = False, complete: bool = True, feed: bool = False) -> DataFrame:
    """uri, action, old_id for each URI of one source.

    current: uri, resource_id, content_hash, policy_version. observed: uri, content_hash, status (ok, empty, unsupported, error,
    unchanged); gone: uri. Actions: skip, insert, replace, empty, unsupported, error, delete, prunable.
    A URI is deleted only if pruning is asked for and it is confirmed gone, or missing from a complete listing, not of a feed,
    that has found at least one of the source's URIs.
    """
    seen = observed.select("uri", F.col("content_hash").alias("hash"), F.col("status"))
    both = seen.join(current, "uri", "left")
    fresh = (F.col("hash") == F.col("content_hash")) & (F.col("policy_version") == policy)
    action = (
        F.when(F.col("status").isin("unsupported", "error", "empty"), F.col("status")).when(F.col("status") == "unchanged", "skip")
        .when(F.col("resource_id").isNull(), "insert").when(F.coalesce(fresh, F.lit(False)), "skip").otherwise("replace")
    )
    plan = both.select("uri", action.alias("action"), F.col("resource_id").alias("old_id"))
    what = "delete" if prune else "prunable"
    if gone is not None:
        lost = gone.select("uri").distinct().join(seen, "uri", "left_anti")
        plan = plan.unionByName(lost.join(current, "uri").select("uri", F.lit(what).alias("action"), F.col("resource_id").alias("old_id")))
        seen = seen.select("uri").unionByName(lost)
    if complete and not feed:
        owned = current.join(seen, "uri", "left_semi").limit(1).count()
        if owned:
            missing = current.join(seen, "uri", "left_anti")
            plan = plan.unionByName(missing.select("uri", F.lit(what).alias("action"), F.col("resource_id").alias("old_id")))
    return plan


def counters(plan: DataFrame) -> DataFrame:
    """One row: indexed, skipped, unsupported, errors, deleted, docs_prunable."""
    n = lambda *kinds: F.count_if(F.col("action").isin(*kinds))
    return plan.agg(n("insert", "replace").alias("indexed"), n("skip", "empty").alias("skipped"), n("unsupported").alias("unsupported"), n("error").alias("errors"), n("delete").alias("deleted"), n("prunable").alias("docs_prunable"))


#: Tables whose rows belong to a resource of a store.
OWNED = ("resources", "blocks", "chunks", "postings", "lengths")
SALT = 64
#: Characters of the chunks whose postings one task sorts, resources to take out that are broadcast at a time, and bytes of stored files that one task rewrites: what is sorted then fits a task's memory.
PIECE, GONE, SPLIT = 4_000_000, 200_000, "8m"
#: Parts of a store in each of its tables; a change rewrites the parts of its resources only.
BUCKETS = 16


def with_index(tables: dict[str, DataFrame], tasks: int | None = None, parts: int = BUCKETS) -> dict[str, DataFrame]:
    """The tables with the full-text index, postings and lengths, of their chunks. Chunks are dealt by part, over so many tasks (for so many parts) or as Spark sees fit; their postings, which are larger, stay where they are made."""
    chunks = tables["chunks"]
    kept = chunks.select("store_id", "resource_id", "chunk_id", "text")
    keys = (part_key(), F.pmod(F.xxhash64("chunk_id"), F.lit(-(-tasks // parts) if tasks else SALT)))
    dealt = kept.repartition(tasks, *keys) if tasks else kept.repartition(*keys)
    postings, _ = retrieval.build_postings(dealt, ("resource_id",))
    return {**tables, "postings": postings, "lengths": retrieval.build_postings(chunks, ("resource_id",))[1]}


def change_index(store: Snapshots, added: DataFrame | None = None, removed: DataFrame | None = None) -> set[str]:
    """Add chunks (store_id, resource_id, chunk_id, text) to a stored full-text index and take resources (store_id, resource_id) out of it, in one manifest; the parts written.

    Only parts that hold one of these resources are read and written, no text but that of added chunks is read, and the numbers that BM25 needs of all chunks follow by part.
    Stored postings are never shuffled: what leaves is broadcast, for GONE resources' parts at a time (a part with more of them alone is joined as Spark sees fit), and added chunks are dealt before their postings are made.
    """
    (number, now), key, names = store._current(), ["store_id", "resource_id"], ("postings", "lengths")
    entries, touched = {n: now["tables"][n] for n in names if n in now["tables"]}, set()
    part = part_key().alias("part")
    with store.scratch() as keep, _small_splits(store.spark):
        if removed is not None:
            gone = keep(removed.select(*(F.col(c).alias(f"gone_{c}") for c in key), part).distinct())
            # At most BUCKETS keys for each store, here and below.
            counts = sorted((r["part"], r["count"]) for r in gone.groupBy("part").count().collect())
            touched |= {p for p, _ in counts}
            for some, n in _groups(counts) if entries else ():
                own = gone.filter(F.col("part").isin(some)).drop("part")
                own = F.broadcast(own) if n <= GONE else own
                for name in names:
                    old = store.rows_of(entries[name], parts=set(some))
                    left = old.join(own, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"gone_{c}")) for c in key)), "left_anti")
                    entries[name] = store.staged(name, left, entries[name], set(some))
        if added is not None:
            sizes = added.groupBy(part).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 100).alias("n")).collect()
            come = {r["part"] for r in sizes}
            touched |= come
            if come:
                new = with_index({"chunks": added}, max(1, -(-sum(r["n"] for r in sizes) // PIECE)), len(come))
                for name in names:
                    rows = store.rows_of(entries[name], parts=come).unionByName(new[name]) if name in entries else new[name]
                    entries[name] = store.staged(name, rows, entries.get(name), come)
    if touched:
        store.commit(number, now, entries)
    return touched


def _groups(counts: list[tuple[str, int]]) -> Iterator[tuple[list[str], int]]:
    """Parts with their counts in groups of at most GONE, or of one part."""
    held, n = [], 0
    for part, k in counts:
        if held and n + k > GONE:
            yield held, n
            held, n = [], 0
        held, n = [*held, part], n + k
    if held:
        yield held, n


@contextmanager
def _small_splits(spark: SparkSession) -> Iterator[None]:
    """Files are read in tasks of SPLIT bytes meanwhile."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, SPLIT)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_order(name: str, frame: DataFrame) -> DataFrame:
    """The rows with __part, postings sorted by part, store and term within tasks and so within files: a query reads few row groups. Only lengths, a short row for each chunk, are shuffled, so that a part is few files."""
    frame = frame.withColumn("__part", part_key())
    if name == "lengths":
        return frame.hint("rebalance", F.col("__part"))
    return frame.sortWithinPartitions("__part", "store_id", "term", "chunk_id") if name == "postings" else frame


def upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """existing with the rows of new put in place of those with equal keys. Of new rows with one key, one stays."""
    last = new.dropDuplicates(key)
    return existing.join(last.select(*key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def upsert_resources(existing: DataFrame, new: DataFrame) -> DataFrame:
    """upsert() that keeps added_at of resources that were there, while modified_at follows the new row."""
    key = KEYS["resources"]
    kept = new.dropDuplicates(key).join(existing.select(*key, F.col("added_at").alias("__added")), key, "left")
    return upsert(existing, kept.withColumn("added_at", F.coalesce("__added", "added_at")).drop("__added"), key)


def replace_resources(existing: DataFrame, plan: DataFrame, new: DataFrame, store: str | None = None) -> DataFrame:
    """Rows of resources, chunks or blocks after a plan: those of replaced and deleted resources go, new ones come.

    Resource ids come from content, so several stores may hold the same one; a plan is of one store, and with that given only its rows go.
    """
    leaving = plan.filter(F.col("action").isin("replace", "delete")).select(F.col("old_id").alias("resource_id")).filter("resource_id is not null").distinct()
    key = ["resource_id"]
    if store is not None:
        leaving, key = leaving.withColumn("store_id", F.lit(store)), ["store_id", "resource_id"]
        new = of_store(new, store)
    return existing.join(leaving, key, "left_anti").select(*existing.columns).unionByName(new, allowMissingColumns=True)


def of_store(rows: DataFrame, store: str) -> DataFrame:
    """The rows; one of another store is an error when it is written."""
    other = F.raise_error(F.concat(F.lit("tenant mismatch: a row of store "), F.coalesce("store_id", F.lit("null")), F.lit(f" in a write to {store}"))).cast("string")
    return rows.withColumn("store_id", F.when(F.col("store_id") == store, F.col("store_id")).otherwise(other))


def part_key() -> Column:
    """The part of a table that a row belongs to: its store and one of BUCKETS by resource."""
    return F.concat_ws(".", "store_id", F.lpad(F.pmod(F.xxhash64("resource_id"), F.lit(BUCKETS)).cast("string"), 2, "0"))


def cascade(tables: dict[str, DataFrame], stores: DataFrame | None = None, sources: DataFrame | None = None, resources: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables without what belongs to the given stores (store_id), sources (source_id) and resources (store_id, resource_id)."""
    out = dict(tables)
    if stores is not None:
        out = {n: t.join(stores.select("store_id"), "store_id", "left_anti") for n, t in out.items()}
    if sources is not None:
        out["sources"] = out["sources"].join(sources.select("source_id"), "source_id", "left_anti")
        lost = out["resources"].join(sources.select("source_id"), "source_id", "left_semi").select("store_id", "resource_id")
        resources = lost if resources is None else resources.select("store_id", "resource_id").unionByName(lost)
    if resources is not None:
        gone = resources.select("store_id", "resource_id").distinct()
        for n in (n for n in OWNED if n in out):
            out[n] = out[n].join(gone, ["store_id", "resource_id"], "left_anti")
    return out


def stale_stores(resources: DataFrame, policy: str) -> DataFrame:
    """store_id, stale: whether any resource was indexed under another policy."""
    return resources.groupBy("store_id").agg(F.coalesce(F.bool_or(F.col("policy_version") != policy), F.lit(False)).alias("stale"))


class Snapshots:
    """Tables as immutable Parquet folders under one root, named by numbered manifests of which the highest is current.

    A table of resources' rows is held in parts, by store and bucket of resources, each a folder of its own; a write that says which parts it
    touches leaves the files of all others in place. Everything is written in full before a manifest names it, and a manifest before it gets its number, so a failed
    write leaves the former state. A number is given once: of two writers that start from one state the later fails. That rests on a rename that doesn't replace,
    as local folders and HDFS have it; object stores whose rename replaces need a committer of their own. The manifest has a schema version; a newer one is refused.
    """

    VERSION = 2

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.root}/manifests")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, number: int):
        return self._path(f"{self.root}/manifests/{number:012d}")

    def manifest(self) -> dict:
        """{version, tables: {name: {schema, parts: {key: folder}}}, meta}; empty for a fresh root. Version 1 has a path in place of parts."""
        return self._current()[1]

    def _current(self) -> tuple[int, dict]:
        numbers = self._numbers()
        if not numbers:
            return 0, {"version": self.VERSION, "tables": {}, "meta": {}}
        found = json.loads(self.spark.read.text(self._manifest(numbers[-1]).toString(), wholetext=True).first()[0])
        if found["version"] > self.VERSION:
            raise ValueError(f"the store has version {found['version']}; this code knows {self.VERSION}")
        return numbers[-1], found

    def meta(self) -> dict:
        return self.manifest().get("meta", {})

    def read(self, name: str, stores: list[str] | None = None, parts: set[str] | None = None) -> DataFrame:
        """The table, or only the parts of some stores, or some parts: other folders aren't listed."""
        return self.rows_of(self.manifest()["tables"][name], stores, parts)

    def rows_of(self, entry: dict, stores: list[str] | None = None, parts: set[str] | None = None) -> DataFrame:
        """read() of a manifest's entry."""
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        if "path" in entry:
            out = self.spark.read.schema(schema).parquet(entry["path"])
            out = out.filter(F.col("store_id").isin(stores)) if stores is not None and "store_id" in out.columns else out
            return out.filter(part_key().isin(sorted(parts))) if parts is not None and _parted(schema.names) else out
        wanted = {k: d for k, d in entry["parts"].items() if (stores is None or not k or k.rpartition(".")[0] in stores) and (parts is None or not k or k in parts)}
        return self.spark.read.schema(schema).parquet(*wanted.values()) if wanted else self.spark.createDataFrame([], schema)

    def number(self) -> int:
        """The current state's number, for write(since=...)."""
        return self._current()[0]

    def write(self, tables: dict[str, DataFrame], parts: set[str] | None = None, drop: tuple[str, ...] = (), meta: dict | None = None, since: int | None = None) -> dict:
        """Write the tables, then a manifest that names them; tables not given stay as they are, but for those to drop. With parts, the
        tables hold the new rows of these parts only, and all other parts stay. With since, a state that isn't the current one any more is an error."""
        number, now = self._current()
        if since is not None and since != number:
            raise OSError("another writer has changed the store; nothing was changed here")
        return self.commit(number, now, {n: self.staged(n, frame, now["tables"].get(n), parts) for n, frame in tables.items()}, drop, meta)

    def staged(self, name: str, frame: DataFrame, entry: dict | None = None, parts: set[str] | None = None) -> dict:
        """The manifest entry of rows that are written here and now."""
        path = f"{self.root}/{name}/{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        out = {"schema": frame.schema.json()}
        if not _parted(frame.columns):
            frame.write.parquet(path)
            return out | {"parts": {"": path}}
        in_order(name, frame).write.partitionBy("__part").parquet(path)
        found = {d.removeprefix("__part="): f"{path}/{d}" for d in (x.getPath().getName() for x in self._fs.listStatus(self._path(path))) if d.startswith("__part=")}
        # A hidden store name may hold characters that a folder's name can't.
        found = {_unescaped(k): d for k, d in found.items()}
        kept = {}
        if parts is not None and entry is not None:
            if "path" in entry:
                raise ValueError(f"table {name} has no parts yet; write it whole")
            kept = {k: d for k, d in entry["parts"].items() if k not in parts}
        if name == "lengths":
            # What BM25 needs of all chunks is kept by part, so that no query and no later change counts it again.
            told = self.spark.read.schema(frame.schema).parquet(*found.values()).groupBy(part_key().alias("part")).agg(F.count("*").alias("n"), F.sum("len").alias("words")).collect() if found else []
            out["stats"] = {k: x for k, x in (entry or {}).get("stats", {}).items() if k in kept} | {r["part"]: [r["n"], r["words"]] for r in told}
        return out | {"parts": kept | found}

    def lengths(self) -> tuple[int, float] | None:
        """Number and mean length of all chunks, as kept by the manifest; None if it has none."""
        stats = self.manifest()["tables"].get("lengths", {}).get("stats")
        total = sum(n for n, _ in stats.values()) if stats is not None else 0
        return (total, sum(w for _, w in stats.values()) / total) if total else None

    def forget(self, store: str, tables: dict[str, DataFrame] | None = None) -> None:
        """Drop a store's parts from all tables; no row of another store is read or written. tables are written along."""
        number, now = self._current()
        entries = {}
        for name, entry in now["tables"].items():
            if "parts" in entry and _parted(T.StructType.fromJson(json.loads(entry["schema"])).names):
                stay = lambda held: {k: v for k, v in held.items() if k.rpartition(".")[0] != store}
                entries[name] = entry | {"parts": stay(entry["parts"])} | ({"stats": stay(entry["stats"])} if "stats" in entry else {})
        self.commit(number, now, entries | {n: self.staged(n, t) for n, t in (tables or {}).items()})

    def commit(self, number: int, now: dict, entries: dict[str, dict], drop: tuple[str, ...] = (), meta: dict | None = None) -> dict:
        """The manifest after number, with entries in place of what now has; fails if another writer was first."""
        after = {"version": self.VERSION, "tables": {n: e for n, e in {**now["tables"], **entries}.items() if n not in drop}, "meta": {**now.get("meta", {}), **(meta or {})}}
        draft, target = self._path(f"{self.root}/manifests/draft-{uuid.uuid4().hex}"), self._manifest(number + 1)
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(after), "utf-8"))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise OSError("another writer has changed the store; nothing was changed here")
        return after

    def parted(self, names: tuple[str, ...]) -> bool:
        """Whether all of these tables that there are have parts."""
        have = self.manifest()["tables"]
        return all("parts" in have[n] for n in names if n in have)

    @contextmanager
    def scratch(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """A function that writes a frame below the root and reads it back, so that it is made once; its files go at the end."""
        folder = f"{self.root}/staging/{uuid.uuid4().hex}"
        made = []

        def keep(frame: DataFrame) -> DataFrame:
            made.append(f"{folder}/{len(made)}")
            frame.write.parquet(made[-1])
            return self.spark.read.schema(frame.schema).parquet(made[-1])

        try:
            yield keep
        finally:
            self._fs.delete(self._path(folder), True)

    def sizes(self) -> DataFrame:
        """table, bytes of the current snapshots."""
        size = lambda e: sum(self._fs.getContentSummary(self._path(d)).getLength() for d in _folders(e))
        return self.spark.createDataFrame([(n, size(e)) for n, e in self.manifest()["tables"].items()], "table string, bytes long")

    def vacuum(self, keep_seconds: float = 0) -> int:
        """Delete what the current manifest doesn't name, earlier manifests and drafts, if older than keep_seconds; the bytes freed. Without an age no writer and no reader of an older state may be at work."""
        before, numbers, freed = (time.time() - keep_seconds) * 1000, self._numbers(), 0
        keep = {_tail(d) for e in self.manifest()["tables"].values() for d in _folders(e)}
        whole = {k.rsplit("/__part=", 1)[0] for k in keep}

        def drop(path, recursive: bool) -> None:
            nonlocal freed
            if self._fs.getFileStatus(path).getModificationTime() <= before:
                freed += self._fs.getContentSummary(path).getLength()
                self._fs.delete(path, recursive)

        for x in self._fs.listStatus(self._path(f"{self.root}/manifests")):
            name = x.getPath().getName()
            if not name.isdigit() or int(name) != numbers[-1]:
                drop(x.getPath(), False)
        for table in self._fs.listStatus(self._path(self.root)):
            name = table.getPath().getName()
            for version in self._fs.listStatus(table.getPath()) if name != "manifests" and table.isDirectory() else ():
                path = version.getPath()
                tail = f"{name}/{path.getName()}"
                if tail not in whole:
                    drop(path, True)
                elif tail not in keep:
                    for part in self._fs.listStatus(path):
                        if part.isDirectory() and f"{tail}/{part.getPath().getName()}" not in keep:
                            drop(part.getPath(), True)
        return freed


def _parted(columns: list[str]) -> bool:
    return "store_id" in columns and "resource_id" in columns


def _folders(entry: dict) -> list[str]:
    return [entry["path"]] if "path" in entry else list(entry["parts"].values())


def _tail(folder: str) -> str:
    """A folder's place below the root: table, version and, if it is one, part."""
    steps = folder.split("/")
    return "/".join(steps[-3:] if steps[-1].startswith("__part=") else steps[-2:])


def _unescaped(name: str) -> str:
    """A partition's value as it was before Hive's escaping of a folder's name."""
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), name)
