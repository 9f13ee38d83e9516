"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its components.

A row's set holds the 64-bit hashes of its distinct word n-grams. Sets in an order by rarity have this property:
if two sets are similar enough, then for every l their prefixes of size - ceil(t * size) + l share at least l
n-grams. Each set chooses its own l: a longer prefix costs longer candidate lists, while the number of candidates
is at most (sum of its list lengths) / l; the l with the least estimated cost is taken.

Equal sets become one class first, so groups of copies of any size cost one row each. Candidates are then verified in two ways.
In pivot rounds each list of a prefix n-gram elects one member, and each member is verified against the one pivot with which it shares most lists; links merge
components, and lists within one component are left out. That is linear in a list's length. What lists of several components
remain are joined with themselves across components only, with the multi-match count as the filter before
verification, so no link between different texts is lost. Verification intersects whole sets exactly.

Rarity is a fixed-width count sketch over all rows, then the n-gram's length: any total order is correct, and the sketch's size
doesn't grow with the data.

Defined results: null and empty texts have empty sets, which link with nothing; a text with fewer words than an
n-gram is one n-gram; repeated rows and ids are kept, each with its component.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm import arrays
from loamline.llm.common import Scratch, bloom, cut, row_key, small, unused
from loamline.llm.components import connected
from loamline.session import ship

#: Defaults of the operator; the registered query uses its contract's values.
WORDS, PERCENT = 5, 80
#: Counters of the rarity sketch.
SKETCH = 1 << 20
SKETCH_PARTS = 64
#: Longest prefix extension that is considered, and the cost of verifying one candidate in list entries for each n-gram.
MAX_MATCH = 4
VERIFY_COST = 0.05
#: Pivot rounds before lists are joined with themselves.
PIVOT_ROUNDS = 2

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int, hasher: arrays.Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashes and lengths (bytes in words) of the distinct n-grams of each row, in order of the first two."""
    data = _LOWER[data]
    start, end, row = arrays.word_bounds(~_BLANK[data], ends)
    hashes = hasher.ranges(hasher.prefix(data), start, end)
    count = np.bincount(row, minlength=len(ends) - 1)
    first = np.zeros(len(ends), np.int64)
    np.cumsum(count, out=first[1:])
    at = np.flatnonzero(row[: max(0, len(row) - words + 1)] == row[words - 1 :]) if len(row) >= words else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < words))
    low, high = np.concatenate([at, first[short]]), np.concatenate([at + words, first[short + 1]])
    grams, owner = hasher.runs(hashes, low, high), np.concatenate([row[at], short])
    size = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=size[1:])
    order = np.lexsort((grams, owner))
    grams, owner, size = grams[order], owner[order], (size[high] - size[low])[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], grams[fresh], size[fresh]


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> arrays.U64(44)).astype(np.int64)


def rarity_sketch(texts: DataFrame, words: int, seed: int) -> np.ndarray:
    """SKETCH counters of n-grams over all rows: each task counts for itself, parts of the counters are summed, and a fixed number of bytes returns."""

    def count(batches):
        hasher, total = arrays.Hasher(seed), np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, _, data, ends in arrays.chunks(batch.column(0)):
                total += np.bincount(_bucket(shingle_sets(data, ends, words, hasher)[1]), minlength=SKETCH)
        parts = [x.astype("<i8").tobytes() for x in np.split(total, SKETCH_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH // SKETCH_PARTS, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_py(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 2**31 - 1).astype("<i4").tobytes()], pa.binary())], ["part", "counts"])

    parts = texts.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(merge, "part int, counts binary").collect()
    return np.concatenate([np.frombuffer(x["counts"], "<i4") for x in sorted(parts, key=lambda x: x["part"])]) if parts else np.zeros(SKETCH, np.int32)


def _prefix_sizes(size: np.ndarray, percent: int) -> np.ndarray:
    return size - -(-size * percent // 100) + 1


def signatures(texts: DataFrame, words: int, percent: int, seed: int, sketch: np.ndarray) -> DataFrame:
    """doc_id, rid (16 bytes that name the set; null if empty), n, need (its l) and prefix for each row."""
    context = texts.sparkSession.sparkContext
    shared = context.broadcast(sketch)
    quiet = float(np.median(sketch))
    quiet += 4 * quiet**0.5

    def sign(batches):
        hasher = arrays.Hasher(seed)
        for batch in batches:
            for low, high, data, ends in arrays.chunks(batch.column(1)):
                rows = high - low
                owner, grams, size = shingle_sets(data, ends, words, hasher)
                first, n, sums = _named(owner, grams, rows)
                # Rarest first: by what the sketch shows above its noise, then the longest, as long words seldom meet by chance.
                seen = np.maximum(shared.value[_bucket(grams)] - quiet, 0.0)
                order = np.lexsort((grams, -size, seen, owner))
                ranked, others = grams[order], seen[order]
                load = np.zeros(len(grams) + 1)
                np.cumsum(others, out=load[1:])
                need, best = np.ones(rows, np.int64), np.full(rows, np.inf)
                for k in range(1, MAX_MATCH + 1):
                    length = np.minimum(n, _prefix_sizes(n, percent) + k - 1)
                    lists = load[first[:-1] + length] - load[first[:-1]]
                    cost = lists + lists / k * n * VERIFY_COST
                    need[cost < best] = k
                    best = np.minimum(best, cost)
                length = np.minimum(n, _prefix_sizes(n, percent) + need - 1) * (n > 0)
                inside = np.arange(len(grams)) - first[owner] < length[owner]
                rid = arrays.pair_bytes(*sums)
                rid = pa.compute.if_else(pa.array(n > 0), rid, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, rows), rid, pa.array(n, pa.int64()), pa.array(need, pa.int32()), arrays.long_lists(ranked[inside], length)],
                    ["doc_id", "rid", "n", "need", "prefix"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, rid binary, n long, need int, prefix array<bigint>")


def whole_sets(texts: DataFrame, words: int, seed: int, wanted: DataFrame) -> DataFrame:
    """rid, grams and wanted's further columns for each rid of wanted (rid, low). Bloom filters of ids and of rids spare most other rows work and shuffle; the join decides."""
    named = bloom(wanted.select(F.conv(F.hex(F.substring("rid", 1, 8)), 16, -10).cast("long").alias("x")))
    ids = bloom(wanted.select(F.coalesce(F.xxhash64("low"), F.lit(0)).alias("x")))

    def emit(batches):
        hasher, given = arrays.Hasher(seed), set()
        for batch in batches:
            some = arrays.in_bloom(ids.value, batch.column(1).to_numpy().view(arrays.U64))
            if not some.any():
                continue
            for low, high, data, ends in arrays.chunks(batch.column(0).filter(pa.array(some))):
                owner, grams, _ = shingle_sets(data, ends, words, hasher)
                first, n, (a, b) = _named(owner, grams, high - low)
                rids = arrays.pair_bytes(a, b)
                rows = np.flatnonzero((n > 0) & arrays.in_bloom(named.value, a))
                rows = [k for k in rows.tolist() if (x := rids[k].as_py()) not in given and not given.add(x)]
                if rows:
                    inside = np.concatenate([np.arange(first[k], first[k + 1]) for k in rows])
                    yield pa.RecordBatch.from_arrays([rids.take(pa.array(rows)), arrays.long_lists(grams[inside], n[rows])], ["rid", "grams"])

    found = texts.select("text", F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("id")).mapInArrow(emit, "rid binary, grams array<bigint>")
    return found.groupBy("rid").agg(F.first("grams").alias("grams")).join(wanted.drop("low"), "rid")


def _named(owner: np.ndarray, grams: np.ndarray, rows: int):
    """Where each row's n-grams begin, how many it has, and the two 64-bit sums that name its set."""
    n = np.bincount(owner, minlength=rows)
    first = np.zeros(rows + 1, np.int64)
    np.cumsum(n, out=first[1:])
    sums = []
    for salt in (0x632BE59BD9B4E019, 0xC6A4A7935BD1E995):
        total = np.zeros(len(grams) + 1, arrays.U64)
        np.cumsum(arrays.mix(grams ^ arrays.U64(salt)), out=total[1:])
        sums.append(arrays.mix(total[first[1:]] - total[first[:-1]] + n.astype(arrays.U64)))
    return first, n, sums


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int, seed: int, scratch: Scratch) -> DataFrame:
    """The pairs (rid, other, ...) whose whole sets are similar enough. The side with hot members joins while rows are narrow."""
    side = lambda r, low, a: pairs.select(F.col(r).alias("rid"), F.col(low).alias("low"), F.lit(a).alias("one"), F.lit(not a).alias("two"))
    both = side("rid", "low", True).unionByName(side("other", "low2", False)).groupBy("rid").agg(F.min("low").alias("low"), F.max("one").alias("one"), F.max("two").alias("two"))
    both = scratch.cut(both)
    sets = scratch.cut(whole_sets(texts, words, seed, both))
    scratch.drop()
    one = pairs.join(sets.filter("two").select(F.col("rid").alias("other"), F.struct("grams").alias("b")), "other")
    two = one.join(sets.filter("one").select("rid", F.struct("grams").alias("a")), "rid")
    shared = F.size(F.array_intersect("a.grams", "b.grams"))
    out = scratch.cut(two.filter(100 * shared >= percent * (F.size("a.grams") + F.size("b.grams") - shared)).drop("a", "b"))
    scratch.drop(sets, both)
    return out


def _postings(firsts: DataFrame, wanted: DataFrame) -> DataFrame:
    """rid, low, n, need, rest, token, own and all of the prefix n-grams that may be among wanted (token), by a Bloom filter: own of them come from here on, all in all."""
    shared = bloom(wanted.select(F.col("token").alias("x")))
    names = ["rid", "low", "n", "need"]

    def run(batches):
        for batch in batches:
            lists = batch.column(4)
            ends = lists.offsets.to_numpy().astype(np.int64)
            tokens = lists.values.to_numpy()[ends[0] : ends[-1]]
            ends = ends - ends[0]
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            keep = np.flatnonzero(arrays.in_bloom(shared.value, tokens.view(arrays.U64)))
            row_kept = row[keep]
            count = np.bincount(row_kept, minlength=batch.num_rows)
            own = np.cumsum(count)[row_kept] - np.arange(len(keep))
            rest = batch.column(2).to_numpy() - np.diff(ends)
            at = pa.array(row_kept)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in range(4)), pa.array(rest[row_kept]), pa.array(tokens[keep]), pa.array(own.astype(np.int32)), pa.array(count[row_kept].astype(np.int32))],
                [*names, "rest", "token", "own", "all"],
            )

    kind = firsts.schema["low"].dataType.simpleString()
    return firsts.select(*names, "prefix").mapInArrow(run, f"rid binary, low {kind}, n long, need int, rest long, token long, own int, all int")


def _matched(pairs: DataFrame, firsts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs whose prefixes share as many n-grams as similar sets of their sizes have to: the multi-match filter, counted on whole prefixes."""
    both = pairs.select("rid").unionByName(pairs.select(F.col("other").alias("rid"))).distinct()
    shared = bloom(both.select(F.conv(F.hex(F.substring("rid", 1, 8)), 16, -10).cast("long").alias("x")))

    def pick(batches):
        for batch in batches:
            heads = np.array([int.from_bytes(x[:8], "big") for x in batch.column(0).to_pylist()], arrays.U64)
            yield batch.filter(pa.array(arrays.in_bloom(shared.value, heads)))

    some = scratch.cut(firsts.select("rid", "n", "need", "prefix").mapInArrow(pick, "rid binary, n long, need int, prefix array<bigint>"))
    one = pairs.join(some.select(F.col("rid").alias("other"), F.struct("n", "need", "prefix").alias("b")), "other")
    two = one.join(some.select("rid", F.struct("n", "need", "prefix").alias("a")), "rid")
    rest = lambda x: F.col(f"{x}.n") - F.size(f"{x}.prefix")
    overlap = F.ceil(percent * (F.col("a.n") + F.col("b.n")) / (100 + percent) - 1e-9)
    least = F.greatest(F.least("a.need", "b.need"), overlap - F.greatest(rest("a"), rest("b")))
    return two.filter(F.size(F.array_intersect("a.prefix", "b.prefix")) >= least).drop("a", "b")


def _least_shared(percent: int):
    """The fewest prefix n-grams that a set of size n shares with any partner of a size from least to most.

    For smaller partners the bound rises with their size, for larger ones it falls, so the ends of the range tell; one is taken off for rounding.
    """
    low = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100 - 1e-9))
    high = F.least(F.col("most"), F.floor(F.col("n") * 100 / percent + 1e-9))
    shared = lambda m: F.ceil(percent * (F.col("n") + m) / (100 + percent) - 1e-9) - F.greatest(F.col("rest"), F.ceil(m * percent / 100 - 1e-9) - 1)
    return F.when(low > high, F.lit(1 << 40)).otherwise(F.greatest(F.lit(1), F.least(shared(low), shared(high)) - 1))


def classes(texts: DataFrame, words: int = WORDS, percent: int = PERCENT, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows has doc_id, rid, n; groups has rid, n, component (smallest doc_id) and verified_links (pairs with other classes that were verified and hold; they span the component, link_counts() has all links)."""
    texts = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    with Scratch(ship(texts.sparkSession)) as scratch:
        signed = scratch.cut(signatures(texts, words, percent, seed, rarity_sketch(texts, words, seed)))
        rows = cut(signed.select("doc_id", "rid", "n"))
        return rows, cut(_groups(signed, texts, words, percent, seed, scratch))


def _lists(signed: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(firsts, live): a row for each class, and its prefix n-grams that may meet those of another class. Drops signed."""
    cut = scratch.cut
    some = signed.filter("rid is not null")
    firsts = cut(some.groupBy("rid").agg(F.min("doc_id").alias("low"), F.first(F.struct("n", "need", "prefix")).alias("set")).select("rid", "low", "set.*"))
    scratch.drop(signed)

    # What other classes' sizes a list holds bounds how many n-grams a partner from it has to share.
    sizes = firsts.select(F.explode("prefix").alias("token"), F.col("n").cast("int").alias("n")).groupBy("token").agg(F.count("*").alias("members"), F.min("n").alias("least"), F.max("n").alias("most"))
    sizes = cut(sizes.filter((F.col("members") > 1) & ((F.col("members") > 2) | (100 * F.col("least") >= percent * F.col("most")))).select("token", "least", "most"))
    live = cut(_postings(firsts, sizes).join(sizes, "token").filter(F.col("own") >= _least_shared(percent)).drop("least", "most"))
    scratch.drop(sizes)
    return firsts, live


def _pairing(percent: int):
    """Whether sizes fit, whether enough n-grams are to come, and the columns of a partner."""
    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    # An overlap large enough leaves at least this many n-grams outside the rests beyond both prefixes.
    overlap = F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent) - 1e-9)
    enough = F.greatest(F.least("need", "need2"), overlap - F.greatest("rest", "rest2"))
    # A pair that shares enough n-grams has the first of them where both still have enough to come.
    ahead = F.least("own", "own2") >= enough
    partner = [F.col("rid").alias("other"), *(F.col(a).alias(b) for a, b in (("n", "m"), ("need", "need2"), ("rest", "rest2"), ("root", "far"), ("low", "low2"), ("own", "own2"), ("all", "all2")))]
    return fits, ahead, partner


def _groups(signed: DataFrame, texts: DataFrame, words: int, percent: int, seed: int, scratch: Scratch) -> DataFrame:
    """rid, n, component and verified_links of classes()."""
    cut = scratch.cut
    firsts, live = _lists(signed, percent, scratch)
    fits, ahead, partner = _pairing(percent)

    roots, tried, links = live.select("rid", F.col("rid").alias("root")).distinct(), None, None
    for k in range(PIVOT_ROUNDS):
        roots = cut(roots)
        lists = live.join(roots, "rid")
        # First the member that has most in common with others, then any.
        one = F.struct((F.lit(0) if k else -F.col("all")).alias("o"), F.xxhash64("rid", F.lit(k)).alias("p"), *partner)
        mixed = lists.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min(one).alias("pivot")).filter("x <> y").select("token", "pivot.*")
        # Written first, so that the join deals both sides anew and Spark can split a very long list.
        mixed = cut(mixed)
        met = lists.join(mixed, "token").filter((F.col("root") != F.col("far")) & fits & ahead)
        met = met.groupBy("rid", "root", "low", "other", "far", "low2").agg(F.count("*").alias("shared"))
        if tried is not None:
            met = met.join(tried, ["rid", "other"], "left_anti")
        pairs = cut(met.groupBy("rid", "root", "low").agg(F.max_by(F.struct("other", "far", "low2"), F.struct("shared", "other")).alias("best")).select("rid", "root", "low", "best.*"))
        linked = verified(pairs, texts, words, percent, seed, scratch)
        seen = pairs.select("rid", "other")
        seen = seen.unionByName(seen.select(F.col("rid").alias("other"), F.col("other").alias("rid")))
        tried = seen if tried is None else tried.unionByName(seen)
        links = linked if links is None else links.unionByName(linked)
        if linked.isEmpty():
            break
        roots = _merged(roots, linked, scratch)

    roots = cut(roots)
    lists = live.join(roots, "rid")
    mixed = lists.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("token")
    lists = cut(lists.join(cut(mixed), "token", "left_semi"))
    pairs = lists.join(lists.select("token", *partner), "token").filter((F.col("root") < F.col("far")) & fits & ahead).select("rid", "root", "low", "other", "far", "low2").distinct()
    pairs = cut(pairs.join(tried, ["rid", "other"], "left_anti").select("rid", "root", "low", "other", "far", "low2"))
    pairs = cut(_matched(pairs, firsts, percent, scratch))
    linked = verified(pairs, texts, words, percent, seed, scratch)
    links = links.unionByName(linked.select(links.columns))
    roots = _merged(roots, linked, scratch)

    named = firsts.select("rid", "n", "low").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    # Written first, so that the join deals both sides anew and Spark can split a very large component.
    low = cut(named.groupBy("root").agg(F.min("low").alias("component")))
    ends = links.select("rid").unionByName(links.select(F.col("other").alias("rid"))).groupBy("rid").agg(F.count("*").alias("verified_links"))
    groups = named.join(low, "root").join(ends, "rid", "left").select("rid", "n", "component", F.coalesce("verified_links", F.lit(0)).alias("verified_links"))
    return groups


def _merged(roots: DataFrame, linked: DataFrame, scratch: Scratch) -> DataFrame:
    moved = connected(linked.select(F.col("root").alias("a"), F.col("far").alias("b")), scratch)
    return roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("rid", F.coalesce("above", "root").alias("root"))


def near_duplicates(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    rows, groups = classes(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words, percent)
    out = rows.join(groups.select("rid", "component"), "rid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def link_counts(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", seed: int = 20) -> DataFrame:
    """doc_id and links for each row: how many other rows are similar enough, each pair verified, so a group of n different near copies costs n² verifications."""
    texts = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    with Scratch(ship(texts.sparkSession)) as scratch:
        signed = scratch.cut(signatures(texts, words, percent, seed, rarity_sketch(texts, words, seed)))
        rows = cut(signed.select("doc_id", "rid"))
        members = scratch.cut(signed.filter("rid is not null").groupBy("rid").agg(F.count("*").alias("members")))
        firsts, live = _lists(signed, percent, scratch)
        fits, ahead, partner = _pairing(percent)
        lists = scratch.cut(live.withColumn("root", F.col("rid")))
        pairs = lists.join(lists.select("token", *partner), "token").filter((F.col("rid") < F.col("other")) & fits & ahead).select("rid", "root", "low", "other", "far", "low2").distinct()
        pairs = scratch.cut(_matched(scratch.cut(pairs), firsts, percent, scratch))
        linked = verified(pairs, texts, words, percent, seed, scratch).select("rid", "other")
        ends = linked.unionByName(linked.select(F.col("other").alias("rid"), F.col("rid").alias("other")))
        near = ends.join(members.select(F.col("rid").alias("other"), "members"), "other").groupBy("rid").agg(F.sum("members").alias("near"))
        counts = cut(members.join(near, "rid", "left").select("rid", (F.col("members") - 1 + F.coalesce("near", F.lit(0))).alias("links")))
    return rows.join(counts, "rid", "left").select("doc_id", F.coalesce("links", F.lit(0)).alias("links"))


def keep_one(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows without near duplicates: of each component one row stays, that with the smallest id, then the smallest digest of id and text; null ids come last.

    Rows are told apart by id and text: rows that share an id but not a text are judged each for itself, and rows that
    share both count once. Empty and null texts are like nothing and stay.
    """
    hidden = unused("__row", documents)
    keyed = documents.withColumn(hidden, row_key(F.col(id_col), F.col(text_col)))
    name = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col(hidden).alias("row"))
    found = near_duplicates(keyed.select(name.alias("doc_id"), F.col(text_col).alias("text")), words, percent)
    others = small(found.filter(F.col("doc_id.row") != F.col("component_id.row")).select(F.col("doc_id.row").alias(hidden)).distinct())
    again = small(found.groupBy(F.col("doc_id.row").alias(hidden)).count().filter("count > 1").select(hidden))
    kept = keyed.join(others, hidden, "left_anti")
    if not again.isEmpty():
        repeated = kept.join(again, hidden, "left_semi").dropDuplicates([hidden])
        kept = kept.join(again, hidden, "left_anti").unionByName(repeated)
    return kept.drop(hidden)
