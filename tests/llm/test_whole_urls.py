"""URL words that a prefix or a bounded model would leave out."""

import re
from collections import Counter
from itertools import product
from math import log

import pytest

from loamline.llm import url_filter


def test_long_pieces_are_segmented_whole():
    model = url_filter.Segmenter({"casino": 50, "poker": 50, "news": 50})
    assert model.words("", "/" + "news" * 60 + "casinopoker") == ["p:news"] * 60 + ["p:casino", "p:poker"]


def test_verdict_follows_words_after_200_letters(spark):
    urls = ["http://a.example.net/" + "news" * 60 + "casinopoker", "http://a.example.net/news"]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).collect()} == {0: "block", 1: "allow"}


def plain(urls, titles):
    """Scores by all words, without Spark."""
    counts = Counter(w for t in titles for w in re.findall("[a-z]{2,}", t))
    for w in (*url_filter.BLOCK_SEEDS, *url_filter.COMMON_SEEDS):
        counts[w] += url_filter.SEED_COUNT
    model = url_filter.Segmenter(dict(counts))
    words = [model.words(*re.fullmatch("http://([^/]*)(.*)", u).groups()) for u in urls]
    bad = [any(w[2:] in url_filter.BLOCK_SEEDS for w in own) or any(w in url_filter.BLOCK_SEEDS for w in re.findall("[a-z]+", t)) for own, t in zip(words, titles, strict=True)]
    of = {k: Counter(w for own, b in zip(words, bad, strict=True) if b == k for w in own) for k in (True, False)}
    size = len({*of[True], *of[False]}) + 1
    sums = {k: of[k].total() + size for k in of}
    prior = log((sum(bad) + 1) / (len(bad) - sum(bad) + 1))
    return [prior + sum(log((of[True][w] + 1) / sums[True]) - log((of[False][w] + 1) / sums[False]) for w in own) for own in words]


@pytest.mark.parametrize("words", [1, 7, 50_000])
def test_rare_words_count_beyond_the_broadcast_ones(spark, words):
    names = ["amber", "birch", "cobalt", "dahlia", "ember", "fjord", "garnet", "hazel"]
    urls = [f"http://{a}{b}.example.net/{b}{'casino' if i < 2 else 'news'}{'/' + a + b * (i == 5)}" for i, a in enumerate(names) for b in names]
    titles = [f"{w} {names[k % 3]}" for k, w in enumerate(names * 8)]
    pages = spark.createDataFrame([(k, u, f"<title>{t}</title>") for k, (u, t) in enumerate(zip(urls, titles, strict=True))], "page_id long, url string, html string")
    want = plain(urls, titles)
    got = {r["page_id"]: r["score"] for r in url_filter.judge(pages.union(pages.filter("false")).repartition(3), words=words).collect()}
    assert len(got) == len(urls) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_number_of_broadcast_words_changes_no_row(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(500)
    pages = pages.unionByName(pages.limit(20))
    rows = [sorted(map(repr, url_filter.judge(pages, words=n).collect())) for n in (5, 50_000)]
    assert rows[0] == rows[1] and len(rows[0]) == pages.count()


def test_segmentation_is_the_cheapest_of_all():
    """Every way of cutting short names, costed by itself."""
    counts = {"a": 3, "ab": 50, "abc": 20, "bca": 9, "c": 1, "cab": 30, "abcabcab": 2}
    total = sum(counts.values())
    cost = lambda w: -log(counts[w] / total) if w in counts else log(total) + 2.5 * len(w)
    model = url_filter.Segmenter(counts)
    for letters in product("abcx", repeat=7):
        name = "".join(letters)
        ways = []
        for cuts in product((False, True), repeat=len(name) - 1):
            at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(name)]
            ways.append(sum(cost(name[a:b]) for a, b in zip(at, at[1:])))
        own = model._split(name)
        assert "".join(own) == name and abs(sum(map(cost, own)) - min(ways)) < 1e-9


def test_long_known_words(spark):
    """Words beyond any fixed length are known, broadcast or joined, and a long unknown stretch is one word."""
    long, longer = "x" * 30, "yz" * 50
    model = url_filter.Segmenter({long: 5, "casino": 5})
    assert model.words(long + "casino", "/" + "q" * 90) == ["h:" + long, "h:casino", "p:" + "q" * 90]
    urls = [f"http://a.example.net/{w}casino" for w in (long, longer)] + [f"http://b.example.net/{longer}news"] * 3
    pages = spark.createDataFrame([(k, u, f"<title>{long} {longer}</title>") for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r["score"] for r in url_filter.judge(pages).collect()}
    want = plain(urls, [f"{long} {longer}"] * 5)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got) and got[0] > 0 and got[1] > got[2]


def test_titles_are_evidence(spark):
    """A URL without a seed is judged by pages whose titles hold one."""
    rows = [(k, f"http://glimmer{k}.example.net/velvet", "<title>casino jackpot</title>") for k in range(20)] + [(20 + k, f"http://meadow{k}.example.net/garden", "<title>flowers</title>") for k in range(20)]
    rows += [(100, "http://new.example.net/velvet", "<title>velvet</title>"), (101, "http://new.example.net/garden", "<title>garden</title>")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[100] == "block" and got[101] == "allow"


def test_verdicts_of_the_small_table(spark):
    """All pages against the plain version: segmentation, counts, odds and rules."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.collect()
    title = lambda h: (re.findall(r"(?is)<title[^>]*>(.*?)</title", h or "") or [""])[0].lower()
    urls = ["http://" + re.sub(r"[?#].*", "", r["url"].split("://", 1)[1], flags=re.S) for r in rows]
    urls = [re.sub(r"^http://([^/]*)", lambda m: "http://" + m.group(1).lower(), u) for u in urls]
    want = plain(urls, [title(r["html"]) for r in rows])
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    for r, score in zip(rows, want, strict=True):
        assert abs(got[r["page_id"]]["score"] - score) < 1e-9
        if got[r["page_id"]]["rule"] is None:
            assert got[r["page_id"]]["verdict"] == ("block" if score > 0 else "allow")
