"""The registry: stores and sources as small tables, statistics, jobs and their bookkeeping."""

from __future__ import annotations

import json
import os
import secrets
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.operators.maintenance import upsert
from loamline.operators.retrieval import RetrievalError

_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(now_ms: int | None = None) -> str:
    """26 characters that sort by time: 48 bits of milliseconds and 80 random ones."""
    value = (int(time.time() * 1000) if now_ms is None else now_ms) << 80 | int.from_bytes(os.urandom(10), "big")
    return "".join(_ALPHABET[value >> 5 * k & 31] for k in range(25, -1, -1))


def upsert_store(stores: DataFrame, store: DataFrame) -> DataFrame:
    """Stores (store_id, name, created_at, ...) with one put in; created_at stays. A name that another store has is an error."""
    clash = stores.join(store.select("name", F.col("store_id").alias("__id")), "name").filter(F.col("store_id") != F.col("__id"))
    if not clash.isEmpty():
        raise RetrievalError("invalid_request", "another store has this name")
    kept = store.join(stores.select("store_id", F.col("created_at").alias("__at")), "store_id", "left")
    return upsert(stores, kept.withColumn("created_at", F.coalesce("__at", "created_at")).drop("__at"), ["store_id"])


def upsert_source(sources: DataFrame, source: DataFrame) -> DataFrame:
    """Sources (source_id, store_id, root, url, ...) with one put in; a store has each root and each URL once."""
    other = source.select("store_id", F.col("root").alias("__root"), F.col("url").alias("__url"), F.col("source_id").alias("__id"))
    clash = sources.join(other, "store_id").filter((F.col("source_id") != F.col("__id")) & (F.coalesce(F.col("root") == F.col("__root"), F.lit(False)) | F.coalesce(F.col("url") == F.col("__url"), F.lit(False))))
    if not clash.isEmpty():
        raise RetrievalError("invalid_request", "the store has a source with this root or url")
    return upsert(sources, source, ["source_id"])


def find_source(sources: DataFrame, store_id: str, place: str) -> DataFrame:
    return sources.filter((F.col("store_id") == store_id) & ((F.col("root") == place) | (F.col("url") == place))).orderBy("created_at", "source_id").limit(1)


#: The keys that a resource's meta may have.
META_KEYS = [f"dc.{k}" for k in "title creator subject description publisher contributor date type format identifier source language relation coverage rights".split()] + [f"msg.{k}" for k in "thread_id channel participants sender timestamp".split()]


def unknown_meta_keys(meta):
    return F.array_sort(F.array_except(F.map_keys(meta), F.array(*map(F.lit, META_KEYS))))


@dataclass
class Job:
    id: str
    store_id: str
    state: str = "pending"
    error: str | None = None
    stats: dict = field(default_factory=dict)
    finished: float | None = None
    cancelled: threading.Event = field(default_factory=threading.Event)


class JobQueue:
    """Jobs on driver threads: one at a time for each store, at most CAPACITY waiting, the last KEPT finished ones remembered for GRACE seconds and longer.

    Each job's Spark jobs carry its id as a tag, so that cancelling reaches the executors.
    """

    CAPACITY, KEPT, GRACE = 64, 200, 60.0

    def __init__(self, spark, workers: int = 2):
        self.spark, self.pool, self.lock = spark, ThreadPoolExecutor(workers), threading.Lock()
        self.jobs: dict[str, Job] = {}
        self.busy: dict[str, threading.Lock] = {}

    def submit(self, store_id: str, work: Callable[[Job], dict]) -> Job:
        with self.lock:
            if sum(j.state == "pending" for j in self.jobs.values()) >= self.CAPACITY:
                raise RetrievalError("invalid_request", "the queue is full")
            if any(j.store_id == store_id and j.state in ("pending", "running") for j in self.jobs.values()):
                raise RetrievalError("invalid_request", "the store has a job already")
            job = Job(ulid(), store_id)
            self.jobs[job.id] = job
            self.busy.setdefault(store_id, threading.Lock())
        self.pool.submit(self._run, job, work)
        return job

    def _run(self, job: Job, work: Callable[[Job], dict]) -> None:
        with self.busy[job.store_id]:
            if job.cancelled.is_set():
                job.state = "cancelled"
            else:
                job.state = "running"
                self.spark.sparkContext.addJobTag(job.id)
                try:
                    job.stats = work(job) or {}
                    job.state = "cancelled" if job.cancelled.is_set() else "done"
                except Exception as e:
                    job.state, job.error = ("cancelled", None) if job.cancelled.is_set() else ("failed", str(e)[:500])
                finally:
                    self.spark.sparkContext.removeJobTag(job.id)
            job.finished = time.time()
        self._evict()

    def cancel(self, job_id: str) -> bool:
        job = self.jobs.get(job_id)
        if job is None or job.state not in ("pending", "running"):
            return False
        job.cancelled.set()
        self.spark.sparkContext.cancelJobsWithTag(job_id)
        return True

    def list(self) -> list[Job]:
        with self.lock:
            return sorted(self.jobs.values(), key=lambda j: j.id, reverse=True)

    def _evict(self) -> None:
        with self.lock:
            over = sorted((j for j in self.jobs.values() if j.finished), key=lambda j: j.finished)[: -self.KEPT or None]
            for j in over:
                if time.time() - j.finished > self.GRACE:
                    del self.jobs[j.id]


def due(sources: DataFrame, now: int) -> DataFrame:
    """Sources to refresh: with an interval (refresh, seconds), and never refreshed or at least an interval ago (refreshed_at, epoch seconds)."""
    return sources.filter(F.col("refresh").isNotNull() & (F.col("refreshed_at").isNull() | (F.lit(now) - F.col("refreshed_at") >= F.col("refresh"))))


def token() -> str:
    return secrets.token_hex(16)


def tolerant_json(text, schema: str):
    """A JSON column read by a schema; what doesn't parse is the all-null value."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def dump(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))
