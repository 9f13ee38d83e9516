"""Time partitions that adapt to the data: Parquet files of a bounded number of rows, by year, month, day or hour as the rows ask for.

The years from the first to the last moment are siblings; a node of over limit rows is divided into all its months, days or hours. In time order, each
sibling within the limit, an empty one too, joins the run of the one right before it if the run stays within the limit, else it starts a run. Leaves are the
runs with rows, single hours of over limit rows, and all rows without a moment. A leaf's rows in order fill parts of limit rows, one file each.

1. ROLLUP sums hourly counts by year, month, day and hour; joins of that table with itself keep the children of overfull nodes, calendar sequences add the empty
   ones, and aggregate() folds each node's sorted children (31 at most, or the years) into runs.
2. Rows meet their leaf by range, within the day: leaves are listed once for each of their days, which the calendar bounds, however many rows there are.
3. Rows are dealt and sorted by leaf, moment and order in ranges, so that a leaf of any size takes as many tasks as it needs; a row's place in its leaf is its
   place in its range, plus what earlier ranges hold of the leaf. No window and no task sees a whole leaf.
4. A file's rows are told by a digest that adds up in any order. A file whose leaf, part and rows recur stays when a layout is rewritten; the others are written, then old ones deleted.

Defined results: a null moment (leaf 'null') and null order columns come first; rows that agree in moment and order columns go by a hash of all columns; repeated rows
are rows of their own; an empty table has no files.
"""

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import cut, delete, kept_dir, small, unused
from loamline.session import ship

LEVELS = ("y", "m", "d", "h")
#: How parents and members of a leaf's name are padded.
WIDTHS = {"y": 4, "m": 2, "d": 2, "h": 2}
_ROW = (1 << 33) - 1


def _hour_number(y: Column, m: Column, d: Column, h: Column) -> Column:
    return F.unix_date(F.make_date(y, m, d)).cast("long") * 24 + h


def _runs(children: Column, limit: int) -> Column:
    """Runs (first, last, n, joins: whether they may grow) of sorted children (no, n)."""
    kind = "array<struct<first:int,last:int,n:bigint,joins:boolean>>"
    run = lambda first, last, n, joins: F.struct(first.alias("first"), last.alias("last"), n.alias("n"), joins.alias("joins"))

    def step(runs: Column, x: Column) -> Column:
        top = F.try_element_at(runs, F.lit(-1))
        grows = (F.size(runs) > 0) & top["joins"] & (x["n"] <= limit) & (top["n"] + x["n"] <= limit)
        grown = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(run(top["first"], x["no"], top["n"] + x["n"], F.lit(True))))
        return F.when(F.coalesce(grows, F.lit(False)), grown).otherwise(F.concat(runs, F.array(run(x["no"], x["no"], x["n"], x["n"] <= limit)))).cast(kind)

    return F.aggregate(children, F.array().cast(kind), step)


def layout(moments: DataFrame, limit: int) -> DataFrame:
    """leaf (its name), lo and hi (hours since 1970, hi exclusive) of the leaves of moments (moment, a timestamp without a zone)."""
    day = F.to_date("moment")
    hours = moments.filter("moment is not null").groupBy(F.year(day).alias("y"), F.month(day).alias("m"), F.day(day).alias("d"), F.hour("moment").alias("h")).agg(F.count("*").alias("n"))
    nodes = cut(hours.rollup(*LEVELS).agg(F.sum("n").alias("n"), F.grouping_id().alias("level")))
    # grouping_id() has a bit for each column that was summed up: 7 is a year, 3 a month, 1 a day, 0 an hour.
    counted = {level: nodes.filter(F.col("level") == (8 >> k) - 1).select(*LEVELS[: k + 1], "n") for k, level in enumerate(LEVELS)}
    members = {
        "y": lambda: nodes.filter("level = 7").agg(F.min("y").alias("a"), F.max("y").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("y")),
        "m": lambda: F.sequence(F.lit(1), F.lit(12)),
        "d": lambda: F.sequence(F.lit(1), F.day(F.last_day(F.make_date("y", "m", F.lit(1))))),
        "h": lambda: F.sequence(F.lit(0), F.lit(23)),
    }
    found = []
    for k, level in enumerate(LEVELS):
        above = list(LEVELS[:k])
        siblings = counted[above[-1]].filter(F.col("n") > limit).select(*above, F.explode(members[level]()).alias(level)) if above else members["y"]()
        siblings = siblings.join(counted[level], [*above, level], "left").select(*above, F.struct(F.col(level).alias("no"), F.coalesce("n", F.lit(0)).alias("n")).alias("x"))
        runs = siblings.groupBy(*above).agg(F.sort_array(F.collect_list("x")).alias("children")).select(*above, F.explode(_runs(F.col("children"), limit)).alias("run"))
        # What is overfull is divided one level below, but for hours.
        runs = runs.filter((F.col("run.n") > 0) & (F.col("run.joins") | F.lit(level == "h")))
        padded = lambda c, name: F.lpad(c.cast("string"), WIDTHS[name], "0")
        name = F.concat_ws("/", *(padded(F.col(a), a) for a in above), F.concat_ws("-", padded(F.col("run.first"), level), padded(F.col("run.last"), level)))
        first, last = F.col("run.first"), F.col("run.last")
        one = F.lit(1)
        if level == "y":
            lo, hi = _hour_number(first, one, one, F.lit(0)), _hour_number(last + 1, one, one, F.lit(0))
        elif level == "m":
            lo, hi = _hour_number(F.col("y"), first, one, F.lit(0)), F.unix_date(F.date_add(F.last_day(F.make_date("y", last, one)), 1)).cast("long") * 24
        elif level == "d":
            lo, hi = _hour_number(F.col("y"), F.col("m"), first, F.lit(0)), _hour_number(F.col("y"), F.col("m"), last, F.lit(24))
        else:
            lo, hi = _hour_number(F.col("y"), F.col("m"), F.col("d"), first), _hour_number(F.col("y"), F.col("m"), F.col("d"), last + 1)
        found.append(runs.select(name.alias("leaf"), lo.alias("lo"), hi.alias("hi")))
    return cut(found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]))


def placed(rows: DataFrame, leaves: DataFrame, limit: int, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """rows (columns and moment) with lo, hi (0 and 0 without a moment), part (from 1) and seq, which ascends in a part."""
    days = small(leaves.select(F.explode(F.sequence(F.floor(F.col("lo") / 24).cast("long"), F.floor((F.col("hi") - 1) / 24).cast("long"))).alias("day"), "lo", "hi"))
    day = F.unix_date(F.to_date("moment")).cast("long")
    named = rows.withColumns({"at_day": day, "at_hour": day * 24 + F.hour("moment")})
    met = named.join(days, (F.col("at_day") == F.col("day")) & (F.col("at_hour") >= F.col("lo")) & (F.col("at_hour") < F.col("hi")), "left")
    met = met.select(*columns, "moment", F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("hi", F.lit(0)).alias("hi"), F.xxhash64(*columns).alias("tie"), F.monotonically_increasing_id().alias("copy"))
    keys = ["lo", "hi", "moment", *order, "tie", "copy"]
    dealt = cut(met.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie", "copy").withColumn("seq", F.monotonically_increasing_id()))
    pieces = dealt.groupBy("lo", "hi", F.shiftright("seq", 33).alias("piece")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = Window.partitionBy("lo", "hi").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = small(pieces.select("lo", "hi", "piece", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    out = dealt.withColumn("piece", F.shiftright("seq", 33)).join(pieces, ["lo", "hi", "piece"])
    return out.withColumn("part", (F.floor((F.col("before") + F.col("seq") - F.col("first")) / limit) + 1).cast("int")).withColumn("place", F.col("before") + F.col("seq") - F.col("first")).drop("piece", "before", "first")


def _told(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """lo, hi, part and what tells a file's rows: their number and two sums of hashes of place and values."""
    hashed = [F.bit_xor(F.xxhash64(F.lit(seed), "place", *columns)).alias(f"sum{seed}") for seed in (1, 2)]
    return cut(rows.groupBy("lo", "hi", "part").agg(F.count("*").alias("n"), *hashed))


class TimePartitions:
    """A folder of files by adaptive time partitions."""

    def __init__(self, folder: str, limit: int, order: Sequence[str]):
        self.folder, self.limit, self.order, self.files, self.round = folder, limit, list(order), None, 0

    def write(self, rows: DataFrame, moment: Column) -> "TimePartitions":
        """Make the folder hold the rows, and nothing else: files that recur stay. kept tells those."""
        columns = rows.columns
        hidden = {c: unused(c, rows) for c in ("lo", "hi", "part", "moment", "seq", "place", "written")}
        if hidden != {c: c for c in hidden}:
            raise ValueError(f"columns may not be named {sorted(c for c in hidden if hidden[c] != c)}")
        spark = ship(rows.sparkSession)
        timed = rows.withColumn("moment", moment)
        self.leaves = layout(timed.select("moment"), self.limit)
        arranged = placed(timed, self.leaves, self.limit, self.order, columns)
        told = _told(arranged, columns)
        stale, self.kept, keys = None, None, ["lo", "hi", "part"]
        self.round += 1
        if self.files is not None:
            self.kept = cut(self.files.join(told, told.columns, "left_semi").select(*keys, "written"))
            stale = self.files.join(self.kept, keys, "left_anti").select(*keys, "written")
            arranged = arranged.join(small(self.kept.select(*keys)), keys, "left_anti")
        # All of a part's rows are in one task, sorted, so they become one file. Keys are numbers, so the writer needs no sort of its own.
        out = arranged.repartition(*keys).sortWithinPartitions(*keys, "seq").select(*columns, *keys)
        out.write.partitionBy(*keys).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{self.folder}/written={self.round}")
        if stale is not None:
            for x in stale.toLocalIterator():
                delete(spark, f"{self.folder}/written={x['written']}/lo={x['lo']}/hi={x['hi']}/part={x['part']}")
        told = told.withColumn("written", F.lit(self.round))
        self.files = told if self.kept is None else cut(told.join(self.kept.withColumnRenamed("written", "before"), keys, "left").withColumn("written", F.coalesce("before", "written")).drop("before"))
        self.schema, self.columns = rows.schema, columns
        return self

    def read(self, spark) -> DataFrame:
        """The files' rows with written (the round that wrote the file), lo, hi and part."""
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        return spark.read.schema(f"{kinds}, written int, lo long, hi long, part int").parquet(self.folder)

    def inventory(self, spark, id_col: str, fresh: Column) -> DataFrame:
        """For each file, as read from it: leaf, part, columns, n_rows, n_new (rows for which fresh holds), ids_sha256 (of id_col in file order, null as an empty text), path and rewritten."""
        if self.files.isEmpty():
            empty = self.leaves.filter("false")
            return empty.select("leaf", F.lit(1).cast("long").alias("part"), F.lit("").alias("columns"), F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_new"), F.lit("").alias("ids_sha256"), F.lit("").alias("path"), F.lit(True).alias("rewritten"))
        found = self.read(spark).select("lo", "hi", F.col("part").cast("long").alias("part"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), F.col(id_col).cast("string").alias("id"), F.coalesce(fresh, F.lit(False)).alias("fresh"))
        found = found.repartition("path").sortWithinPartitions("path", "at")

        def run(batches):
            now, told, hashed = None, [], None

            def ended() -> None:
                if now is not None:
                    told.append((*now, n, new, hashed.hexdigest()))

            n = new = 0
            for batch in batches:
                for key, id_, fresh in zip(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True), batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                    if key != now:
                        ended()
                        now, n, new, hashed = key, 0, 0, hashlib.sha256()
                    hashed.update((("," if n else "") + (id_ or "")).encode())
                    n, new = n + 1, new + fresh
            ended()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            names = ["lo", "hi", "part", "path", "n_rows", "n_new", "ids_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in told], kind) for k, kind in enumerate(kinds)], names)

        files = found.mapInArrow(run, "lo long, hi long, part long, path string, n_rows long, n_new long, ids_sha256 string")
        files = files.join(self.leaves, ["lo", "hi"], "left")
        kept = self.kept.withColumn("stayed", F.lit(True)) if self.kept is not None else self.leaves.select("lo", "hi", F.lit(1).alias("part"), F.lit(0).alias("written"), F.lit(True).alias("stayed")).filter("false")
        files = files.join(kept.drop("written").withColumn("part", F.col("part").cast("long")), ["lo", "hi", "part"], "left")
        return files.select(F.coalesce("leaf", F.lit("null")).alias("leaf"), "part", F.lit(",".join(self.columns)).alias("columns"), "n_rows", "n_new", "ids_sha256", "path", F.col("stayed").isNull().alias("rewritten"))


def moved(ts: Column, name: Column) -> Column:
    """The contract's moment: ts moved back some years or floored to Monday for some of the names."""
    k = F.crc32(name.cast("string")) % 128
    ts = ts.cast("timestamp_ntz")
    back = ts - F.make_dt_interval((k + 6) * (k + 6) * (k + 6))
    monday = F.date_sub(F.to_date(ts), F.weekday(F.to_date(ts))).cast("timestamp_ntz")
    return F.when(k < 16, back).when(k > 111, monday).otherwise(ts)


def rewritten(rows: DataFrame, moment: Column, earlier: Column, limit: int, order: Sequence[str], id_col: str) -> DataFrame:
    """inventory() of a new folder to which the rows for which earlier holds were written, and then all."""
    spark = ship(rows.sparkSession)
    parts = TimePartitions(kept_dir(spark, "time-partitions"), limit, order)
    parts.write(rows.filter(earlier), moment).write(rows, moment)
    return parts.inventory(spark, id_col, ~F.coalesce(earlier, F.lit(False)))
