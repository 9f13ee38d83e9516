"""Feed entries as a stream: a table of the newest version of each entry, whatever the order, repeats and batches in which versions come.

Versions of an entry are ranked totally: by published, else updated time, those without either last, then by ordinal, then by
a digest of the whole row. The newest of any set of versions is a maximum, so replays, late rows and retried batches change nothing.

State remembers the best version seen of each entry: a streaming aggregation that combines versions before they are shuffled. With `expiry`,
in a query that keeps running, a stateful processor lets only better versions through and forgets an entry after so many seconds without one.
The table decides again when it is merged, so what is forgotten costs a rewrite, never a wrong version. For the processor entries are dealt by a
salt of the version's digest too: an entry with very many versions is many keys, and a replayed version always meets its own.

Defined results: rows without feed or uri are dropped (they name no entry); null times and ordinals rank last; equal rows are one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loamline.operators import maintenance
from loamline.session import ship

ENTRY_KEY = ["store_id", "feed", "uri"]
RANKED = ("dated", "at", "back", "digest")
SALT = 32


def ranked(rows: DataFrame, store_id: str) -> DataFrame:
    """The entries (feed, uri, published, updated, ordinal, ...) with store_id, resource_id (a digest of feed and uri, for parts) and the columns of RANKED, greatest for the newest version."""
    names = [c for c in rows.columns if c not in ("store_id", "resource_id", *RANKED)]
    when = F.coalesce(F.col("published").cast("string"), F.col("updated").cast("string"))
    named = rows.select(*names).filter("feed IS NOT NULL AND uri IS NOT NULL")
    whole = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    return named.select(
        F.lit(store_id).alias("store_id"), F.sha2(F.concat_ws("|", "feed", "uri"), 256).alias("resource_id"), *names,
        when.isNotNull().alias("dated"), F.coalesce(when, F.lit("")).alias("at"), (-F.coalesce(F.col("ordinal").cast("long"), F.lit(2**62))).alias("back"), whole.alias("digest"),
    )


def newest(rows: DataFrame) -> DataFrame:
    """The best version of each entry of ranked rows; an aggregation that combines before it shuffles."""
    best = rows.groupBy(*ENTRY_KEY).agg(F.max_by(F.struct(*rows.columns), F.struct(*RANKED)).alias("best"))
    return best.select(*(F.col("best")[c].alias(c) for c in rows.columns))


class _Best(StatefulProcessor):
    """Lets a version through if it beats all that its key has seen."""

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "dated boolean, at string, back long, digest string", self.expiry_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.best.get() if self.best.exists() else None
        best, row = (bool(held[0]), *held[1:]) if held else None, None
        for batch in rows:
            for k, rank in enumerate(zip(batch["dated"], batch["at"], batch["back"], batch["digest"], strict=True)):
                rank = (bool(rank[0]), rank[1], int(rank[2]), rank[3])
                if best is None or rank > best:
                    best, row = rank, batch.iloc[k : k + 1]
        if row is not None:
            self.best.update(best)
            yield row

    def close(self) -> None:
        pass


def better(entries: DataFrame, expiry: int | None = None) -> DataFrame:
    """A stream of ranked entries without the versions that can't be the newest, as far as state remembers: for ever, or for expiry seconds. Needs the RocksDB state store.

    What is kept for ever is an aggregation: versions combine before they are shuffled, and an entry that a batch touches comes with its best version so far, which may be one that came before.
    """
    if not expiry:
        return newest(entries)
    dealt = entries.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALT)))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in dealt.schema])
    return dealt.groupBy(*ENTRY_KEY, "salt").transformWithStateInPandas(statefulProcessor=_Best(expiry * 1000), outputStructType=schema, outputMode="Update", timeMode="ProcessingTime").drop("salt")


def merge_entries(store: maintenance.Snapshots, changed: DataFrame, keep: Callable[[DataFrame], DataFrame], since: int | None = None) -> tuple[dict[str, DataFrame], set[str]]:
    """The new rows of the parts of `entries` that changed (ranked rows) touches, and these parts; nothing is written."""
    # At most maintenance.BUCKETS keys for each store.
    touched = {r["part"] for r in changed.select(maintenance.part_key().alias("part")).distinct().collect()}
    rows = changed
    if "entries" in store.manifest()["tables"]:
        rows = store.read("entries", parts=touched).unionByName(changed)
    return {"entries": keep(newest(rows))}, touched


def follow(entries: DataFrame, store: maintenance.Snapshots, store_id: str, checkpoint: str, expiry: int | None = None, then: Callable[[DataFrame], None] | None = None, trigger: dict | None = None):
    """Start the query that keeps store's table `entries` the newest versions of a stream of entries; then() gets each batch's entries that became newest.

    A batch that is tried again merges to the same table; then() is called before the table is written, so that it misses none, and may see one twice.
    """
    trigger = trigger or {"availableNow": True}
    if expiry and "processingTime" not in trigger:
        raise ValueError("state expires by the clock: with expiry a query has to keep running, by a processingTime trigger")
    spark = ship(entries.sparkSession)

    def step(batch: DataFrame, number: int) -> None:
        since = store.number()
        with store.scratch() as keep:
            changed = keep(batch)
            tables, touched = merge_entries(store, changed, keep)
            if not touched:
                return
            if then:
                fresh = tables["entries"]
                if "entries" in store.manifest()["tables"]:
                    old = store.read("entries", parts=touched).select(*(F.col(c).alias(f"old_{c}") for c in (*ENTRY_KEY, "digest")))
                    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"old_{c}") for c in (*ENTRY_KEY, "digest")))
                    fresh = fresh.join(old, same, "left_anti")
                then(keep(fresh))
                since = store.number()
            store.write(tables, parts=touched, since=since)

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return better(ranked(entries, store_id), expiry).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        spark.conf.set(provider, before) if before is not None else spark.conf.unset(provider)
