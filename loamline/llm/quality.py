"""Quality rules as a short-circuit cascade.

Native: Catalyst expressions only, one narrow pass. The base figures are computed for every row.
The further rules are ordered by rejections per second, both estimated on a bounded sample, and
evaluated as one CASE, which stops at the first rule that rejects. The order changes the cost, never the verdict,
since a row is kept only if no rule rejects it.

Defined results: a null or empty text has no words and fails the base rules. Repeated rows stay repeated.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import blank_words, cut, let

WINDOW = 8
#: Rows of the sample on which the rules' cost and selectivity are estimated.
SAMPLE_ROWS = 300
SAMPLE_CHARS = 100_000
#: Rows drawn for each one wanted, as a draw's size varies.
SPARE = 1.2
SAMPLE_SEED = 17

# Limits of the rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """rejects: a condition over text, words and the base figures; true for rows to drop."""

    name: str
    rejects: Column | None


def default_rules() -> list[Rule]:
    """Limits well outside what running prose shows, so that clean documents stay."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    return [
        Rule("symbols", F.col("n_symbols") * 100 > n * 20),
        Rule("duplicate_lines", F.col("n_dup_lines") * 100 > F.size(F.split("text", "\n", -1)) * 50),
        Rule("word_length", (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 20)),
        Rule("shouting", F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) * 100 > F.greatest(letters, F.lit(1)) * 60),
        Rule("letters", letters * 100 < F.length("text") * 40),
        Rule("few_distinct", F.size(F.array_distinct("words")) * 100 < F.least(n, F.lit(2000)) * 5),
        Rule("stutter", let(F.col("words"), lambda w: F.size(F.filter(F.transform(w, lambda x, i: x == F.get(w, i + 1)), lambda same: same))) * 100 > n * 30),
        Rule("exclamations", F.regexp_count("text", F.lit("!!")) * 100 > n * 30),
    ]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of eight words that occur at least twice in the array.

    Windows are hashed by doubling (1, 2, 4, 8 words), so each word costs a constant number of array reads.
    Sorting the hashes of a document brings equal windows together; without equal ones nothing is sorted.
    """
    assert window == 8

    def hashed(h1):
        pair = lambda h, d: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + d)))
        return let(pair(h1, 1), lambda h2: let(pair(h2, 2), lambda h4: F.slice(pair(h4, 4), F.lit(1), F.size(h1) - (window - 1))))

    def covered(h):
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]))
        starts = let(order, lambda s: F.array_sort(F.filter(twice(s), lambda i: i.isNotNull())))
        gains = let(starts, lambda p: F.transform(p, lambda v, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - v, F.lit(window)))))
        return F.aggregate(gains, F.lit(0).cast("long"), lambda a, g: a + g.cast("long"))

    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(
        let(
            let(F.transform(words, lambda w: F.xxhash64(w)), hashed),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
        )
    )


def figures(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, words and the base figures of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    return with_figures(rows)


def with_figures(rows: DataFrame) -> DataFrame:
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("words", blank_words(F.col("text")))
    return (
        rows.withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("words")))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    )


def sample_texts(documents: DataFrame, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The figures of at most rows texts, drawn evenly over the whole table by one scan; longer ones than SAMPLE_CHARS and nulls are left out."""
    texts = documents.select(F.col(text_col).alias("text"))
    share = min(1.0, SPARE * rows / max(1, texts.count()))
    some = texts.sample(share, seed=SAMPLE_SEED).filter(F.length("text") <= SAMPLE_CHARS).limit(rows)
    return with_figures(cut(some).coalesce(1))


def order_rules(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by rejections per second, the best first. One job gives every rule's selectivity, one job each its cost."""
    rates = sample.agg(F.count("*").alias("n"), *(F.sum(r.rejects.cast("int")).alias(f"r{k}") for k, r in enumerate(rules))).first()
    if not rates["n"]:
        return rules

    def seconds(condition: Column) -> float:
        began = time.perf_counter()
        sample.agg(F.sum(condition.cast("int"))).collect()
        return time.perf_counter() - began

    floor = seconds(F.col("base_failed"))
    costs = [max(seconds(r.rejects) - floor, 1e-3) for r in rules]
    rank = sorted(range(len(rules)), key=lambda k: (-(rates[f"r{k}"] or 0) / costs[k], k))
    return [rules[k] for k in rank]


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base figures, base_failed and kept for each row."""
    rows = figures(documents, id_col, text_col)
    return rows.withColumn("kept", _kept(sample_texts(documents, text_col, sample_rows), rules)).drop("text", "words")


def _kept(sample: DataFrame, rules: list[Rule] | None) -> Column:
    rules = order_rules(sample, default_rules() if rules is None else rules)
    verdict = F.when(F.col("base_failed"), False)
    for rule in rules:
        verdict = verdict.when(F.coalesce(rule.rejects, F.lit(False)), False)
    return verdict.otherwise(True)


def keep_good(documents: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of the input that no rule rejects, with the input's columns."""
    carried = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    rows = with_figures(carried.select("row", F.coalesce(F.col("row").getField(text_col), F.lit("")).alias("text")))
    # explode() drops the nulls and, unlike a filter, is not pushed below the figures and so evaluated twice.
    kept = rows.select(F.explode(F.when(_kept(sample_texts(documents, text_col, sample_rows), rules), F.array("row"))).alias("row"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in documents.columns))
