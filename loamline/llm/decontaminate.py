"""Benchmark decontamination as a prefix-filtered set join.

Native: Catalyst expressions only. An item is cut into windows of WINDOW words. Matching a window means
containing all of its words, so of its words in order of rarity a prefix of one, the rarest, is necessary.
Rarity is counted over all documents for the words of the benchmark. Document words then meet windows on
that rarest word; positional and length bounds place the window inside the document, and comparing
the words in place verifies it. Hits are intervals, whose union is measured per row.

Documents are scanned, never shuffled: the item side is broadcast in blocks of at most BLOCK_WINDOWS windows,
so its size has a bound however large the benchmark is. Only matches are shuffled.

Defined results: a null or empty text has no words and no hits; an item without words matches nothing; repeated
rows each get their own result; null ids are kept. A window that several items hold counts for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import LOWER, UPPER, cut, let, row_key, small, unused

WINDOW = 10
#: Most windows that one broadcast holds; further ones go into further broadcasts.
BLOCK_WINDOWS = 100_000
#: Between words: control characters, punctuation and symbols below U+0080 (A-Z stays, as it is lower-cased later).
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
EDGE = "".join(map(chr, (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def cased_words(text: Column) -> Column:
    """The words before lower-casing; an empty array for null."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(EDGE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP, -1)))


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """phrase, words, size, items: each distinct window with the items that hold it."""
    words = F.transform(cased_words(F.col(text_col)), ascii_lower)
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words.alias("words")).filter(F.size("words") > 0)
    at = F.posexplode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))).alias("k", "start")
    cuts = items.select("item_id", "words", at).select("item_id", F.slice("words", F.col("start") + 1, F.lit(window)).alias("words"))
    return cuts.groupBy(F.array_join("words", " ").alias("phrase")).agg(F.first("words").alias("words"), F.collect_set("item_id").alias("items")).withColumn("size", F.size("words"))


def _exploded(documents: DataFrame, keep: list[str]) -> DataFrame:
    # lower() of a word is the same wherever its ASCII-lower-cased forms are, so it serves as the join key.
    return documents.select(*keep, F.posexplode("words").alias("at", "raw")).withColumn("word", F.lower("raw"))


def find_windows(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """row, start, size, phrase, items for each occurrence of an item window in a document row."""
    windows = cut(item_windows(benchmark, item_id, item_text, window).withColumn("id", F.monotonically_increasing_id()))
    rows = documents.select(row_key(F.col(id_col), F.col(text_col)).alias("row"), cased_words(F.col(text_col)).alias("words"))
    blocks = max(1, -(-windows.count() // block_windows))
    windows = windows.withColumn("block", (F.pmod(F.xxhash64("phrase"), F.lit(blocks))).cast("int"))

    found = None
    for block in range(blocks):
        some = windows.filter(F.col("block") == block)
        vocabulary = some.select(F.explode("words").alias("w")).select(F.lower("w").alias("word")).distinct()
        counts = _exploded(rows, []).join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
        counts = cut(counts)  # at most a row per benchmark word
        # Words absent from the documents leave their windows without a partner.
        ranked = some.select("id", "size", F.posexplode("words").alias("offset", "w")).withColumn("word", F.lower("w")).join(F.broadcast(counts), "word", "left")
        rarest = ranked.groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "word")).alias("least"))
        probes = some.join(rarest, "id").filter("least.n > 0").select("id", "phrase", "items", "size", F.col("least.offset").alias("offset"), F.col("least.word").alias("probe"))
        start = F.col("at") - F.col("offset")
        fits = (start >= 0) & (start + F.col("size") <= F.size("words"))
        same = ascii_lower(F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("size")), " ")) == F.col("phrase")
        tokens = _exploded(rows, ["row", "words"])
        part = tokens.join(F.broadcast(probes), (F.col("word") == F.col("probe")) & fits & same).select("row", start.alias("start"), "size", "phrase", "items")
        found = part if found is None else found.unionByName(part)
    return found


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted array), contaminated for each input row."""
    found = find_windows(documents, benchmark, window, block_windows, id_col, text_col, item_id, item_text)
    # One shuffle: a row's matches are at most its words times the benchmark's distinct window lengths.
    hits = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def cover(acc, s):
        end = s["start"] + s["size"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(s["start"], acc["end"]))).alias("n"))

    hits = hits.select("row", F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), cover, lambda acc: acc["n"]).alias("n_hit"), "items")
    base = documents.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row"), F.size(cased_words(F.col(text_col))).cast("long").alias("n_words"))
    out = base.join(hits, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def keep_clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that hold no window of an item; rows are told apart by id and text, so a null id or a shared one is no obstacle. Null and empty texts stay."""
    found = find_windows(documents, benchmark, window, id_col=id_col, text_col=text_col)
    hidden = unused("__row", documents)
    keyed = documents.withColumn(hidden, row_key(F.col(id_col), F.col(text_col)))
    return keyed.join(small(found.select(F.col("row").alias(hidden)).distinct()), hidden, "left_anti").drop(hidden)
