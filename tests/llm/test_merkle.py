"""The Merkle manifest against a plain version."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from loamline.llm import merkle, queries
from loamline.session import ship

SF = "/root/testdata/sf0.001"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
    return levels


def plain(rows, fanout=2):
    """Rows (doc_id, source, lang, n_chars, text); the contract's columns."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    for members in groups.values():
        members.sort(key=lambda x: x[:3])
    trees = {k: tree([x[2] for x in v], fanout) for k, v in groups.items()}
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    top = tree([trees[k][-1][0] for k in order], fanout) if order else []
    out = []
    for k, members in groups.items():
        for i, (_, _, own, row) in enumerate(members):
            beside, node = [], own
            if row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                node = leaf((*row[:3], row[3] + 1, row[4]))
            for levels, at in ((trees[k], i), (top, order.index(k))):
                for level in levels[:-1]:
                    run = at - at % fanout
                    left, right = level[run:at], level[at + 1 : run + fanout]
                    beside += left + right
                    node = sha([*left, node, *right])
                    at //= fanout
            out.append((row[0], own, trees[k][-1][0], top[-1][0], sha(beside), node, node == top[-1][0]))
    return sorted(map(repr, out))


def got(documents, **options):
    found = merkle.digests(merkle.documents_manifest(documents, tampered=F.crc32(F.col("doc_id").cast("string")) % 7 == 0, **options))
    return sorted(repr(tuple(r)) for r in found.collect())


def rows(documents):
    return [tuple(r) for r in documents.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in every column, negative and far ids, one id with many texts, repeated rows, and names that the operator uses inside."""
    made = [(k * k - 300, "s", ("en", "de", None, "", "é")[k % 5], k, f"text {k}") for k in range(60)]
    made += [(7, "s", "en", 3, f"other {k}") for k in range(40)] + [(7, "s", "en", 3, "same")] * 9 + [(None, None, None, None, None)] * 3 + [(None, "s", "en", None, "")]
    made += [(2**62, "s", "en", 1, "x" * 20_000), (-(2**62), "s", "de", 1, ""), (0, "", "zz", 0, "\u65e5\u672c")]
    out = ship(spark).createDataFrame(made, "doc_id long, source string, lang string, n_chars long, text string")
    return out.withColumns({c: F.lit("clash") for c in ("grp", "rank", "n", "id", "leaf", "probe", "m", "d0", "block", "nodes", "full")}).repartition(4).cache()


def test_contract_on_hard_rows(hard):
    assert got(hard) == plain(rows(hard))


def test_further_digits_and_tiers(hard, monkeypatch):
    """Buckets of over 5 rows are divided, and blocks of 4 leaves make several tiers."""
    found = merkle.documents_manifest
    monkeypatch.setattr(merkle, "manifest", lambda r, fanout, f=merkle.manifest: f(r, fanout, 4, 5))
    assert sorted(repr(tuple(r)) for r in merkle.digests(found(hard, tampered=F.crc32(F.col("doc_id").cast("string")) % 7 == 0)).collect()) == plain(rows(hard))


def test_wider_runs(hard):
    assert got(hard, fanout=3) == plain(rows(hard), 3)


def test_empty_and_single_tables(hard):
    assert got(hard.filter("false")) == []
    one = hard.filter("doc_id = 0 and lang = 'zz'")
    assert got(one) == plain(rows(one)) and len(got(one)) == 1


def test_query_against_plain_version(spark):
    documents = ship(spark).read.parquet(f"{SF}/documents.parquet")
    assert sorted(repr(tuple(r)) for r in queries.op13_merkle_manifest(spark, SF).collect()) == plain(rows(documents))


def test_tampering_shows(spark):
    found = queries.op13_merkle_manifest(spark, SF)
    wrong = found.filter(~F.col("verified"))
    assert wrong.count() == found.filter(F.crc32(F.col("doc_id").cast("string")) % 7 == 0).count() > 0
