"""Adaptive time partitions against a plain version."""

import calendar
import datetime as D
import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from loamline.llm import queries, time_partitions
from loamline.session import ship

SF = "/root/testdata/sf0.001"
CUTOFF = D.datetime(2024, 3, 1)


def moment(ts, name):
    if ts is None or name is None:
        return ts
    k = zlib.crc32(str(name).encode()) % 128
    if k < 16:
        return ts - D.timedelta(days=(k + 6) ** 3)
    if k > 111:
        day = ts.date() - D.timedelta(days=ts.weekday())
        return D.datetime(day.year, day.month, day.day)
    return ts


def leaves(rows, limit):
    """{name: rows} of rows (moment, ...)."""
    out = {}
    if empty := [r for r in rows if r[0] is None]:
        out["null"] = empty
    rows = [r for r in rows if r[0] is not None]
    path = lambda t: (t.year, t.month, t.day, t.hour)

    def members(above):
        if len(above) == 0:
            years = [r[0].year for r in rows]
            return range(min(years), max(years) + 1) if years else []
        return [range(1, 13), range(1, calendar.monthrange(*above)[1] + 1) if len(above) == 2 else [], range(24)][len(above) - 1]

    def divide(above, own):
        run, held, before = [], [], False
        prefix = "".join(f"{x:0{4 if k == 0 else 2}d}/" for k, x in enumerate(above))
        width = 2 if above else 4

        def close():
            if held:
                out[f"{prefix}{run[0]:0{width}d}-{run[-1]:0{width}d}"] = list(held)

        for x in members(above):
            inside = [r for r in own if path(r[0])[len(above)] == x]
            if len(inside) > limit:
                close()
                run, held, before = [], [], False
                if len(above) == 3:
                    out[f"{prefix}{x:02d}-{x:02d}"] = inside
                else:
                    divide((*above, x), inside)
            elif before and len(held) + len(inside) <= limit:
                run.append(x)
                held += inside
            else:
                close()
                run, held, before = [x], inside, True
        close()

    divide((), rows)
    return out


def plain(clicks, limit):
    """Sorted (leaf, part, n_rows, n_new, ids_sha256, rewritten) for clicks (click_id, ts, arrived_at)."""
    none = D.datetime.min

    def files(rows):
        found = {}
        for name, own in leaves([(moment(ts, i), at, i) for i, ts, at in rows], limit).items():
            own.sort(key=lambda r: (r[0] or none, r[1] or none, -(1 << 70) if r[2] is None else r[2]))
            for k in range(0, len(own), limit):
                found[name, k // limit + 1] = own[k : k + limit]
        return found

    early = files([r for r in clicks if r[2] is not None and r[2] < CUTOFF])
    out = []
    for (name, part), own in files(clicks).items():
        ids = hashlib.sha256(",".join("" if r[2] is None else str(r[2]) for r in own).encode()).hexdigest()
        out.append((name, part, len(own), sum(r[1] is None or r[1] >= CUTOFF for r in own), ids, early.get((name, part)) != own))
    return sorted(out)


def told(found):
    return sorted((r["leaf"], r["part"], r["n_rows"], r["n_new"], r["ids_sha256"], r["rewritten"]) for r in found)


def rewritten(clicks, limit):
    early = F.col("arrived_at") < F.lit(CUTOFF.isoformat(" ")).cast("timestamp_ntz")
    return time_partitions.rewritten(clicks, time_partitions.moved(F.col("ts"), F.col("click_id")), early, limit, ["arrived_at", "click_id"], "click_id")


def data_files(paths):
    """All Parquet files of the folder that the paths lie in."""
    top = paths[0].removeprefix("file:").split("/written=")[0]
    return {os.path.join(d, n) for d, _, names in os.walk(top) for n in names if n.endswith(".parquet")}


@pytest.fixture(scope="module")
def clicks(spark):
    return ship(spark).read.parquet(f"{SF}/clicks.parquet").cache()


def test_query_against_plain_version(spark, clicks):
    found = queries.op12_time_partitions(spark, SF).collect()
    rows = [tuple(r) for r in clicks.select("click_id", "ts", "arrived_at").collect()]
    assert told(found) == plain(rows, 1 + len(rows) // 650)
    assert {r["columns"] for r in found} == {",".join(clicks.columns)} and any(not r["rewritten"] for r in found)
    assert data_files([r["path"] for r in found]) == {r["path"].removeprefix("file:").removeprefix("//") for r in found}
    again = spark.read.parquet(*(r["path"] for r in found)).select(*clicks.columns)
    assert again.exceptAll(clicks).count() == clicks.exceptAll(again).count() == 0


@pytest.mark.parametrize("limit", [1, 3, 10_000])
def test_hard_rows(spark, limit):
    """Nulls, one hour and one moment with many rows, repeated rows, leap days, and a far year."""
    t = D.datetime(2024, 2, 29, 13, 30)
    rows = [(k, t, t + D.timedelta(days=k), "a") for k in range(12)] + [(3, t, t, "a")] * 4 + [(100 + k, t + D.timedelta(hours=7 * k), t, None) for k in range(40)]
    rows += [(None, t, t, None), (50, None, t, None), (51, None, None, None), (52, t, None, "x"), (None, None, None, None), (53, D.datetime(1970, 1, 1), t, ""), (54, D.datetime(2024, 12, 31, 23, 59, 59), t, "z" * 9000)]
    clicks = ship(spark).createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string")
    assert told(rewritten(clicks.repartition(5), limit).collect()) == plain([r[:3] for r in rows], limit)


def test_nothing_and_names(spark, clicks):
    assert rewritten(clicks.filter("false"), 5).count() == 0
    assert told(rewritten(clicks.filter("click_id < 40 and arrived_at >= '2024-03-01'"), 5).collect()) == []
    with pytest.raises(ValueError, match="part"):
        rewritten(clicks.withColumn("part", F.lit(1)), 5)


def test_unchanged_rows_leave_every_file(spark, clicks):
    folder = time_partitions.kept_dir(spark, "test")
    parts = time_partitions.TimePartitions(folder, 50, ["arrived_at", "click_id"])
    parts.write(clicks, F.col("ts"))
    first = data_files([f"{folder}/written=1"])
    parts.write(clicks.repartition(3), F.col("ts"))
    assert data_files([f"{folder}/written=1"]) == first and parts.inventory(spark, "click_id", F.lit(False)).filter("rewritten").count() == 0
