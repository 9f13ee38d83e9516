"""Unequal texts stay unequal: Thue-Morse words, which every polynomial hash modulo 2^64 takes for equal from 1,024 letters on."""

import numpy as np
import pytest

from loamline.llm import arrays, line_dedup, ngram_join, suffix_dedup
from loamline.session import ship

SIZES = [512, 1024, 2048]


def morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def frame(spark, texts):
    return ship(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("seed", [1, 20, 51, 71])
def test_ranges_and_runs_differ(seed):
    hasher = arrays.Hasher(seed)
    for n in [*SIZES, 1 << 15]:
        a, b = (np.frombuffer(morse(n, x).encode(), np.uint8) for x in ("ab", "ba"))
        whole = [hasher.ranges(hasher.prefix(x), np.array([0]), np.array([n]))[0] for x in (a, b, a)]
        assert whole[0] == whole[2] != whole[1]
        words = [hasher.runs(x.astype(arrays.U64), np.array([0]), np.array([n]))[0] for x in (a, b, a)]
        assert words[0] == words[2] != words[1]


def test_modular_arithmetic():
    prime, rng = int(arrays.PRIME), np.random.Generator(np.random.PCG64(3))
    a, b = (np.concatenate([rng.integers(0, prime, 500), [0, 1, prime - 1, prime - 1]]).astype(arrays.U64) for _ in range(2))
    assert arrays.product(a, b).tolist() == [int(x) * int(y) % prime for x, y in zip(a, b, strict=True)]
    total, want = 0, [0]
    for x in a.tolist():
        total = (total + x) % prime
        want.append(total)
    assert arrays.running(a).tolist() == want
    powers = arrays.Powers(12345)
    up, down = powers.upto(300)
    assert up.tolist() == [pow(powers.base, k, prime) for k in range(300)] and set(arrays.product(up, down).tolist()) == {1}


def test_a_range_has_its_hash_wherever_it_lies(monkeypatch):
    data, hasher = np.frombuffer(b"some text here and some text there", np.uint8), arrays.Hasher(7)
    for _ in range(2):
        p = hasher.prefix(data)
        x, y = hasher.ranges(p, np.array([0, 19]), np.array([9, 28]))
        assert x == y
        monkeypatch.setattr(arrays, "BLOCK", 5)
        assert hasher.prefix(data).tolist() == p.tolist()


def test_ngram_join(spark):
    docs = frame(spark, [morse(n, x) for n in SIZES for x in ("ab", "ba")])
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()} == {k: k for k in range(2 * len(SIZES))}
    assert ngram_join.keep_one(docs).count() == 2 * len(SIZES)


def test_line_dedup(spark):
    words = " ".join(f"w{k}" for k in range(12))
    got = line_dedup.digest(line_dedup.remove_lines(frame(spark, [f"{words} {morse(n, x)}" for n in SIZES for x in ("ab", "ba")])))
    assert {r["n_removed"] for r in got.collect()} == {0}


@pytest.mark.parametrize("anchor", [64, 1024])
def test_suffix_dedup(spark, anchor):
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(frame(spark, [morse(1024, "ab"), morse(1024, "ba"), morse(1024, "ab")]), 1024, anchor))
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {0: 1024, 1: 0, 2: 1024}


def test_anchors_are_compared(spark):
    """Even where all anchors have one hash, only equal bytes are removed."""
    group = [b"x" * 40 + bytes([65 + k]) * 20 + b"y" * 40 for k in range(2)]
    kinds = ship(spark).createDataFrame([(1, k, 1, 0, 40, bytearray(g)) for k, g in enumerate(group)], "fp long, cx long, times long, low int, high int, segment binary")
    assert suffix_dedup._compared(kinds, 60, 20).count() == 0
