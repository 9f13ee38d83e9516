"""URL filters: host rules first, then naive Bayes over segmented host and path words.

Host and path are cut out natively. A rule (host, path) fits its host and every subdomain of it, if the path starts
with the rule's; the longest fitting rule decides. Other URLs are judged by their words: host labels and path
parts are split at non-letters, and each piece is segmented by a unigram Viterbi search, so that
concatenated names come apart. The unigram model is counted over the titles of all pages, with the seed words added.

Naive Bayes learns classes that more than the URL decides: pages with a block seed among the segmented words of their URL or the words of
their title are examples of one class, all others of the other. A URL without any seed is so judged by what its words
have in common with those of such pages. Both word statistics are tables of all words. Their MODEL_WORDS most frequent words
are broadcast, which bounds the driver's part; rarer ones reach the URLs that need them by joins, and count alike.

Defined results: a null URL, or one without ://, has an empty host and path, fits no rule and is judged by the prior alone. Repeated rows stay repeated.
"""

import re
from collections import ChainMap
from functools import lru_cache
from hashlib import blake2b
from math import inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm import arrays
from loamline.llm.common import LOWER, UPPER, bloom, cut
from loamline.session import shipped

#: The rules as (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words that make a URL an example of a blocked one, and other words that names are often made of.
BLOCK_SEEDS = "adult porn xxx sex nude escort casino poker bet betting gambling slots jackpot spam viagra pills pharma warez crack torrent phishing malware clickbait".split()
COMMON_SEEDS = "win farm shop store news blog online free best cheap top live video game games play club site web world home health sport sports travel food music book books tech media mail forum wiki photo cam dating loan credit crypto deal deals city life www".split()
#: Occurrences that a seed counts for in the unigram model.
SEED_COUNT = 1000
MODEL_WORDS = 50_000
#: Letters of a word that is broadcast; longer ones are among those that are joined.
HELD_LETTERS = 64
_EXTRA, _RARE = "array<struct<word:string,n:bigint>>", "array<struct<word:string,bad:bigint,good:bigint>>"


def host_of(url):
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """rule and its verdict added to rows with host and path; both null where no rule fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("ruled", verdict)


class Segmenter:
    """Splits a run of letters into the words of greatest product of probabilities."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = total or sum(counts.values()) or 1
        self.total, self.cost = total, {w: -log(n / total) for w, n in counts.items()}
        self.lengths = {*map(len, counts)}
        # An unknown word costs more the longer it is, and always more than the rarest known one; two in a row cost more than one.
        self.unknown, self.letter = log(total), 2.5
        self.split = lru_cache(maxsize=100_000)(self._split)

    def _split(self, name: str, rare: dict[str, float] | None = None) -> tuple[str, ...]:
        cost = ChainMap(self.cost, rare) if rare else self.cost
        lengths = sorted({*self.lengths, *map(len, rare)} if rare else self.lengths)
        best, loose = [(0.0, 0)], (inf, 0)  # loose: the best that ends within an unknown word, and where that word begins
        for end in range(1, len(name) + 1):
            loose = min((loose[0] + self.letter, loose[1]), (best[end - 1][0] + self.unknown + self.letter, end - 1))
            ways = [loose]
            for n in lengths:
                if n > end:
                    break
                price = cost.get(name[end - n : end])
                if price is not None:
                    ways.append((best[end - n][0] + price, end - n))
            best.append(min(ways))
        words, end = [], len(name)
        while end:
            start = best[end][1]
            words.append(name[start:end])
            end = start
        return tuple(reversed(words))

    def words(self, host: str, path: str, extra: list[dict] | None = None) -> list[str]:
        """Segmented words; those of the host are told apart from those of the path. extra adds words to the model for this URL. Long runs of letters are segmented whole too, but not remembered."""
        rare = {x["word"]: -log(x["n"] / self.total) for x in extra or ()}
        split = (lambda piece: self._split(piece, rare)) if rare else lambda piece: (self.split if len(piece) <= 200 else self._split)(piece)
        return [kind + w for kind, text in (("h:", host), ("p:", path)) for piece in pieces(text) for w in split(piece)]


def pieces(text: str) -> list[str]:
    return re.findall("[a-z]+", text.lower())


def _hashes(words: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(w.encode(), digest_size=8).digest() for w in words), np.uint64)


def _split_off(table: DataFrame, weight: Column, words: int) -> tuple[list, DataFrame | None]:
    """The rows of so many words of greatest weight, none of them very long, and the table of all others, or None."""
    brief = F.length("word") <= HELD_LETTERS
    rows = table.filter(brief).orderBy(weight.desc(), "word").limit(words + 1).collect()
    rest = ~brief
    if len(rows) > words:
        least = table.filter(F.col("word") == rows[words - 1]["word"]).select(weight).first()[0]
        rest = rest | (weight < least) | ((weight == least) & (F.col("word") > rows[words - 1]["word"]))
    others = table.filter(rest)
    return rows[:words], None if others.isEmpty() else others


def title_of(html: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title", 1))


def unigrams(pages: DataFrame, html_col: str = "html", words: int = MODEL_WORDS) -> tuple[dict[str, int], int, DataFrame | None]:
    """The most frequent words of all titles, with the seeds; the sum of all counts; word and n of all further words, or None."""
    counts = cut(pages.select(F.explode(F.regexp_extract_all(title_of(F.col(html_col)), F.lit("([a-z]{2,})"), F.lit(1))).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    seeds = (*BLOCK_SEEDS, *COMMON_SEEDS)
    seed = F.col("word").isin(*{*seeds})
    rows, rest = _split_off(counts.filter(~seed), F.col("n"), words)
    top = {r["word"]: r["n"] for r in (*rows, *counts.filter(seed).collect())}
    total = counts.agg(F.sum("n")).first()[0] or 0
    for w in seeds:
        top[w] = top.get(w, 0) + SEED_COUNT
    return top, total + SEED_COUNT * len(seeds), rest


def with_extra(located: DataFrame, top: dict[str, int], rest: DataFrame | None) -> DataFrame:
    """extra added: the words of rest that are part of a row's host or path, with their counts."""
    if rest is None:
        return located.withColumn("extra", F.lit(None).cast(_EXTRA))

    def name(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(batch.column(0).to_pylist()).view(np.int64))], ["x"])

    # Letters that are no word stay where they are, but for a few by chance.
    some = bloom(rest.select("word").mapInArrow(name, "x long"))
    lengths = sorted(r[0] for r in rest.select(F.length("word")).distinct().collect())
    model = located.sparkSession.sparkContext.broadcast({*top})

    def run(batches):
        known, spots = model.value, some.value

        def parts(piece):
            own = [*({piece[a : a + n] for n in lengths for a in range(len(piece) - n + 1)} - known)]
            return [own[k] for k in np.flatnonzero(arrays.in_bloom(spots, _hashes(own)))]

        held = lru_cache(maxsize=10_000)(parts)
        for batch in batches:
            keys = [(h, p, w) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in {w for x in {*pieces(h), *pieces(p)} for w in (held if len(x) <= 200 else parts)(x)}]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()) for k in (zip(*keys, strict=True) if keys else ((), (), ()))], ["host", "path", "word"])

    parts = located.select("host", "path").distinct().mapInArrow(run, "host string, path string, word string")
    found = parts.join(rest, "word").groupBy("host", "path").agg(F.collect_list(F.struct("word", "n")).alias("extra"))
    return cut(located.join(cut(found), ["host", "path"], "left"))


def fit(located: DataFrame, counts: dict[str, int], total: int, words: int = MODEL_WORDS) -> tuple[dict[str, float], float, tuple[int, int], DataFrame | None]:
    """Log odds for blocking of the most frequent words, and of the classes, from all rows with host, path, extra and title; what odds_of() needs; word, bad and good of all further words, or None."""
    model, seeds = located.sparkSession.sparkContext.broadcast((counts, total)), {*BLOCK_SEEDS}

    def run(batches):
        segmenter = Segmenter(*model.value)
        for batch in batches:
            found: dict[tuple[str, bool], int] = {}
            for host, path, extra, title in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = segmenter.words(host, path, extra)
                bad = any(w[2:] in seeds for w in own) or not seeds.isdisjoint(pieces(title))
                for w in ("", *own):
                    found[w, bad] = found.get((w, bad), 0) + 1
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array(list(found.values()), pa.int64())], ["word", "bad", "n"])

    totals = cut(located.select("host", "path", "extra", "title").mapInArrow(run, "word string, bad boolean, n long").groupBy("word").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("good")))
    documents = next(((r["bad"], r["good"]) for r in totals.filter("word = ''").collect()), (0, 0))
    kinds, times = totals.filter("word <> ''"), F.col("bad") + F.col("good")
    bad, good, size = kinds.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)), F.count("*") + 1).first()
    rows, rest = _split_off(kinds, times, words)
    sums = (bad + size, good + size)
    return {r["word"]: odds_of(r["bad"], r["good"], sums) for r in rows}, log((documents[0] + 1) / (documents[1] + 1)), sums, rest


def odds_of(bad: int, good: int, sums: tuple[int, int]) -> float:
    return log((bad + 1) / sums[0]) - log((good + 1) / sums[1])


def with_rare(located: DataFrame, model, top: dict[str, float], rest: DataFrame | None) -> DataFrame:
    """rare added: the class counts of a row's segmented words that are in rest."""
    if rest is None:
        return located.withColumn("rare", F.lit(None).cast(_RARE))
    held = located.sparkSession.sparkContext.broadcast({*top})

    def run(batches):
        segmenter, known = Segmenter(*model.value), held.value
        for batch in batches:
            keys = [(h, p, w) for h, p, extra in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for w in {*segmenter.words(h, p, extra)} - known]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()) for k in (zip(*keys, strict=True) if keys else ((), (), ()))], ["host", "path", "word"])

    own = located.select("host", "path", "extra").dropDuplicates(["host", "path"]).mapInArrow(run, "host string, path string, word string")
    found = own.join(rest, "word").groupBy("host", "path").agg(F.collect_list(F.struct("word", "bad", "good")).alias("rare"))
    return located.join(cut(found), ["host", "path"], "left")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", words: int = MODEL_WORDS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the log odds for blocking) of each row, whatever number of words is broadcast."""
    located = shipped(pages).select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), title_of(F.col(html_col)).alias("title"))
    counts, total, rest = unigrams(pages, html_col, words)
    located = with_extra(located, counts, rest)
    odds, prior, sums, rest = fit(located, counts, total, words)
    context = pages.sparkSession.sparkContext
    model, bayes = context.broadcast((counts, total)), context.broadcast(odds)
    ruled = apply_rules(with_rare(located, model, odds, rest), rules)

    def run(batches):
        segmenter, weight = Segmenter(*model.value), bayes.value
        for batch in batches:
            score = []
            for h, p, extra, rare in zip(*(batch.column(k).to_pylist() for k in (1, 2, 5, 6)), strict=True):
                more = {x["word"]: odds_of(x["bad"], x["good"], sums) for x in rare or ()}
                # Every word of a URL is counted in fit(), so it is in one of the two.
                score.append(prior + sum(weight[w] if w in weight else more[w] for w in segmenter.words(h, p, extra)))
            verdict = [r or ("block" if s > 0 else "allow") for r, s in zip(batch.column(4).to_pylist(), score, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(verdict, pa.string()), pa.array(score, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    kind = located.schema["page_id"].dataType.simpleString()
    return ruled.select("page_id", "host", "path", "rule", "ruled", "extra", "rare").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
