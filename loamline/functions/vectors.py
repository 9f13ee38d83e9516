"""Vector functions: similarity, one-bit and int8 forms, pooling, and the deterministic offline embedder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def cosine_score(a: Column, b: Column) -> Column:
    """1 - d / 2 for the distance d = 1 - cosine."""
    return 1.0 - (1.0 - cosine(a, b)) / 2.0


def bits(vector: Column) -> Column:
    """The signs of a vector, 1 for x >= 0, as bytes with the first element in the highest bit; a last partial byte is padded with zeros."""
    signs = F.transform(vector, lambda x: F.when(x >= 0, "1").otherwise("0"))
    padded = F.concat(F.array_join(signs, ""), F.repeat(F.lit("0"), F.pmod(-F.size(vector), F.lit(8))))
    octets = F.transform(F.sequence(F.lit(0), F.greatest(F.length(padded) / 8 - 1, F.lit(0)).cast("int")), lambda k: F.lpad(F.conv(F.substring(padded, k * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    return F.unhex(F.array_join(octets, ""))


def hamming(a: Column, b: Column) -> Column:
    """Differing signs of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x >= 0) != (y >= 0)).cast("int")), F.lit(0), lambda acc, x: acc + x)


def hamming_score(a: Column, b: Column) -> Column:
    return 1.0 - hamming(a, b) / F.size(a).cast("double")


def quantise(vector: Column) -> Column:
    """round(tanh(x) * 127), within -128 and 127, halves away from zero."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.round(F.tanh(x.cast("double")) * 127).cast("int"))))


def mean_pool(rows: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The mean of each span of token rows; zeros for an empty span."""
    out = np.zeros((len(spans), rows.shape[1]))
    for k, (a, b) in enumerate(spans):
        if b > a:
            np.divide(np.add.reduce(rows[a:b], axis=0), b - a, out=out[k])
    return out


def next_window(used: int, size: int, separator: int = 1, budget: int = 4096) -> tuple[bool, int]:
    """Whether a chunk of so many tokens begins another window after one with used tokens, and the tokens of the window that it is in."""
    return (True, size) if used + separator + size > budget else (False, used + separator + size)


def plan_windows(sizes: list[int], separator: int = 1, budget: int = 4096) -> list[tuple[int, int]]:
    """Greedy ranges of chunks whose tokens, with a separator between chunks, fit the budget; an oversized chunk stands alone."""
    starts, used = [0], sizes[0] if sizes else 0
    for k in range(1, len(sizes)):
        new, used = next_window(used, sizes[k], separator, budget)
        starts += [k] if new else []
    return list(zip(starts, [*starts[1:], len(sizes)], strict=True)) if sizes else []


_POWERS = np.cumprod(np.full(4096, 31, np.uint64))


def embed(text: str, dim: int = 64) -> list[float]:
    """A deterministic unit vector of a text: for each dimension a rolling hash over the UTF-8 bytes, seeded with the dimension.

    All dimensions share the polynomial of the bytes; a seed counts times the power of their number.
    """
    lanes = np.arange(dim, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    octets = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
    for at in range(0, len(octets), len(_POWERS)):
        part = octets[at : at + len(_POWERS)]
        lanes = lanes * _POWERS[len(part) - 1] + (part[:-1] * _POWERS[: len(part) - 1][::-1]).sum(dtype=np.uint64) + part[-1]
    lanes = (lanes ^ (lanes >> np.uint64(31))) * np.uint64(0xD1B54A32D192ED03)
    values = (lanes >> np.uint64(40)).astype(np.float64) / float(1 << 24) - 0.5
    norm = np.linalg.norm(values)
    return (values / norm if norm else values).astype(np.float32).tolist()


class TokenStates:
    """token_states() in memory that is used again: what a call returns holds until the next call."""

    def __init__(self, dim: int = 64):
        self.lanes = np.arange(dim, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        self.wide, self.narrow = np.empty((2, 0, dim), np.uint64), np.empty((2, 0, dim), np.int8)

    def __call__(self, token_ids: list[int]) -> np.ndarray:
        n = len(token_ids)
        if self.wide.shape[1] < n:
            self.wide, self.narrow = np.empty((2, n, len(self.lanes)), np.uint64), np.empty((2, n, len(self.lanes)), np.int8)
        (mixed, other), (own, twice) = self.wide[:, :n], self.narrow[:, :n]
        np.add(np.array(token_ids, np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15), self.lanes, out=mixed)
        np.right_shift(mixed, np.uint64(29), out=other)
        np.bitwise_xor(mixed, other, out=mixed)
        np.multiply(mixed, np.uint64(0xBF58476D1CE4E5B9), out=mixed)
        np.less(mixed.view(np.int64), 0, out=own.view(np.bool_))
        np.add(own, own, out=own)
        np.subtract(own, np.int8(1), out=own)
        np.add(own, own, out=twice)
        twice[1:] += own[:-1]
        twice[:-1] += own[1:]
        out = np.multiply(twice, 0.5, out=other.view(np.float64))
        return np.add(out, own.sum(axis=0, dtype=np.int32) / n / 4 if n else 0.0, out=out)


def token_states(token_ids: list[int], dim: int = 64) -> np.ndarray:
    """A deterministic stand-in for a contextual model: a row of signs for each token, to which those beside it add a half and the mean of all a quarter."""
    return TokenStates(dim)(token_ids)


def quantised(rows: np.ndarray) -> np.ndarray:
    """quantise() for rows of an array."""
    scaled = np.tanh(rows) * 127
    return np.clip(np.copysign(np.floor(np.abs(scaled) + 0.5), scaled) + 0.0, -128, 127)
