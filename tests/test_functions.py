"""Scalar rules, by hand-computed cases."""

from datetime import datetime, timezone

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamline.functions import ids, text, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given_text", "cap", "want"),
    [
        ("This is sentence one. This is sentence two.", 25, ("This is sentence one.", True)),
        ("hello world again", 11, ("hello world", True)),
        ("see example.com/path for details", 10, ("see", True)),
        ("a" * 1000, 50, ("a" * 50, True)),
        ("short", 10, ("short", False)),
        ("", 10, ("", False)),
        ("para one here\n\npara two goes on", 20, ("para one here", True)),
        ("He said \"stop.\" Then he left the room", 18, ("He said \"stop.\"", True)),
    ],
)
def test_snippet(given_text, cap, want):
    assert text.truncate_snippet(given_text, cap) == want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200), st.integers(1, 60))
def test_snippet_is_a_bounded_prefix(value, cap):
    prefix, cut = text.truncate_snippet(value, cap)
    assert value.startswith(prefix) and len(prefix) <= max(cap + cap // 5, 1)
    assert cut == (len(value) > cap) and (prefix or not value)


def test_text_columns(spark):
    lit = F.lit
    assert value(spark, text.fold(lit("ÀÉñßØ"))) == "aenßø"
    assert value(spark, text.tokens(lit("Don't über-stop 3x"))) == ["don", "t", "uber", "stop", "3x"]
    assert value(spark, text.tokens(lit(None).cast("string"))) == []
    assert value(spark, text.collapse_blanks(lit(" a \n b\tc "), 3)) == "a b…"
    assert value(spark, text.display_uri(lit("https://e.example/a%20b%0Ac+d%E2%80%AE"))) == "https://e.example/a b�c+d�"
    assert value(spark, text.display_uri(lit("https://e.example/%ZZ"))) == "https://e.example/%ZZ"
    assert value(spark, text.last_segment(lit("https://e.example/a/b.md?x=1"))) == "b.md"
    assert [value(spark, text.extension(lit(x))) for x in ("a/b.tar.gz", ".bashrc", "x", "a.b/c")] == ["gz", None, None, None]
    assert [value(spark, text.duration_seconds(lit(x))) for x in ("24h", "30m", "3600s", "7", "0", "-1", "x", "99999999999999999d")] == [86400, 1800, 3600, 7, None, None, None, None]
    assert [value(spark, text.human_size(lit(x))) for x in (10, 2048, 5 * 1024**3)] == ["10 B", "2.0 KB", "5.0 GB"]
    # Ties of the first decimal: 81.25, 81.75 and 131.25 KB.
    assert [value(spark, text.human_size(lit(x))) for x in (83200, 83712, 134400, 1024**5 * 2)] == ["81.2 KB", "81.8 KB", "131.2 KB", "2048.0 TB"]
    assert [value(spark, text.pdf_date(lit(x))) for x in ("D:2024", "D:202403", "D:20240317", "20240317120102Z", "D:20241399", "none")] == ["2024", "2024-03", "2024-03-17", "2024-03-17T12:01:02", "2024", None]
    assert value(spark, text.rfc3339(lit(0))) == "1970-01-01T00:00:00Z"
    assert value(spark, text.prose_like(lit("The quick brown fox jumps over the lazy dog, and then it rests."))) is True
    assert value(spark, text.prose_like(lit("too short"))) is False


def test_retry_after():
    now = datetime(2026, 1, 1, tzinfo=timezone.utc)
    assert text.retry_after("30", now) == 30 and text.retry_after("9999", now) == 120
    assert text.retry_after("Thu, 01 Jan 2026 00:00:50 GMT", now) == 50
    assert text.retry_after("Wed, 31 Dec 2025 00:00:00 GMT", now) == 0 and text.retry_after("soon", now) is None


def test_code_like():
    assert all(map(text.code_like, ["$ ls -la", "import os", "key: value", "a/b/c", "10.0.0.1", "0x1F", "  x\n  y\nz"]))
    assert not text.code_like("Prose with *stars*, _lines_, a #tag, R&D, 5$ and ~ten^ `ticks` in it") and text.code_like("f(x); g[y]; {z}")
    assert not text.code_like("A plain sentence that says nothing at all") and not text.code_like("")


def test_vectors(spark):
    arr = lambda *xs: F.array(*(F.lit(float(x)) for x in xs))
    assert value(spark, vectors.cosine_score(arr(1, 0), arr(1, 0))) == 1.0
    assert value(spark, vectors.cosine_score(arr(1, 0), arr(0, 1))) == 0.5
    assert value(spark, vectors.cosine_score(arr(1, 0), arr(-1, 0))) == 0.0
    assert value(spark, F.hex(vectors.bits(arr(*[1, -1] * 4)))) == "AA"
    assert value(spark, F.hex(vectors.bits(arr(*[0] * 8)))) == "FF"
    assert value(spark, F.hex(vectors.bits(arr(1, -1, 1, -1, 1)))) == "A8"
    assert value(spark, vectors.hamming_score(arr(1, 1), arr(1, -1))) == 0.5
    assert value(spark, vectors.quantise(arr(0, 100, -100))) == [0, 127, -127]
    assert vectors.plan_windows([10, 10, 10], 1, 21) == [(0, 2), (2, 3)] and vectors.plan_windows([50], 1, 20) == [(0, 1)] and vectors.plan_windows([]) == []
    assert vectors.mean_pool(np.array([[1.0, 2], [3, 4]]), [(0, 2), (1, 1)]).tolist() == [[2, 3], [0, 0]]
    assert abs(sum(x * x for x in vectors.embed("hello")) - 1) < 1e-5 and vectors.embed("a") != vectors.embed("b")


def test_embedder_equals_its_byte_by_byte_rule():
    def plain(text, dim=8):
        lanes = [(d * 0x9E3779B97F4A7C15 + 1) % 2**64 for d in range(dim)]
        for b in text.encode():
            lanes = [(x * 31 + b) % 2**64 for x in lanes]
        values = [(((x ^ x >> 31) * 0xD1B54A32D192ED03 % 2**64) >> 40) / 2**24 - 0.5 for x in lanes]
        norm = sum(v * v for v in values) ** 0.5
        return [v / norm for v in values]

    for text in ("", "a", "h\u00e9llo", "x" * 4095, "y\u00fc" * 2048, "z" * 4097, "ab c" * 5000):
        assert np.allclose(vectors.embed(text, 8), plain(text), atol=1e-6), len(text)


def test_policy_version_ignores_key_order_not_parser_order():
    a = ids.policy_version("x", {"b": 1, "a": 2}, "m", "p", ["html", "md"])
    assert a == ids.policy_version("x", {"a": 2, "b": 1}, "m", "p", ["html", "md"]) and a != ids.policy_version("x", {"a": 2, "b": 1}, "m", "p", ["md", "html"])
