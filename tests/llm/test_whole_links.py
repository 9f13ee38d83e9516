"""All links of near duplicates, not only those that span a component."""

import random

import brute
from loamline.llm import ngram_join
from loamline.session import ship


def counted(rows, words, percent):
    sets = [brute.shingles(t, words) for _, t in rows]
    near = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    return sorted((d, sum(bool(near(a, b)) for b in range(len(rows)) if b != a)) for a, (d, _) in enumerate(rows))


def test_every_link_of_a_group_is_counted(spark):
    base = [f"w{j}" for j in range(120)]
    copies = [(k, " ".join([*base[: 10 * k], f"x{k}", *base[10 * k + 1 :]])) for k in range(12)]
    chain = [(100 + k, " ".join(f"c{j}" for j in range(k, k + 60))) for k in range(0, 20, 2)]
    rows = [*copies, *chain, (50, copies[3][1]), (51, copies[3][1]), (52, ""), (53, None), (54, "alone here")]
    random.Random(3).shuffle(rows)
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.link_counts(docs, 4, 85).collect()))
    assert got == counted(rows, 4, 85) and dict(got)[0] == 13


def test_links_on_tables(spark):
    docs = ship(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, ngram_join.link_counts(docs, 4, 85).collect())) == counted(rows, 4, 85)
