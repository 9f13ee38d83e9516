"""Vectorised work on the byte buffers of Arrow string columns.

A prefix sum of (byte + 1) * B^i modulo the prime 2^61 - 1 gives the hash of any byte range in constant time:
(H[end] - H[start]) * B^-start. Word hashes and word-range hashes are made the same way, one level up.
(Modulo 2^64 there are strings, such as Thue-Morse words of 1,024 letters, that meet for every odd base.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at once, few enough for a core's cache; a longer document is worked on alone.
CHUNK_BYTES = 1 << 17
#: The modulus of hashes; masks of 31 and 30 bits; numbers that are worked on at once.
PRIME = U64((1 << 61) - 1)
_HALF, _THIRTY = U64((1 << 31) - 1), U64((1 << 30) - 1)
BLOCK = 1 << 13


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (shift, multiply) that spreads every input bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD1B54A32D192ED03)
    return x ^ (x >> U64(32))


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime 2^61 - 1."""
    x = (x & PRIME) + (x >> U64(61))
    x -= (x >= PRIME) * PRIME
    return x


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for values below it: products of 31-bit halves, as 2^61 is 1. b may be one number."""
    if len(a) > BLOCK:
        return np.concatenate([product(a[k : k + BLOCK], b[k : k + BLOCK] if b.ndim else b) for k in range(0, len(a), BLOCK)])
    a1, a0, b1, b0 = a >> U64(31), a & _HALF, b >> U64(31), b & _HALF
    middle = a1 * b0
    middle += a0 * b1
    a1 *= b1
    a1 <<= U64(1)
    a1 += middle >> U64(30)
    middle &= _THIRTY
    middle <<= U64(31)
    a1 += middle
    a0 *= b0
    a1 += a0
    return reduced(a1)


def running(values: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """0 and the running sums of values, or of (value + 1) * times for bytes, modulo the prime; a block at a time, which stays in the cache."""
    out, last = np.zeros(len(values) + 1, U64), U64(0)
    for k in range(0, len(values), BLOCK):
        x = values[k : k + BLOCK]
        if times is None:
            high, low = np.cumsum(x >> U64(31)), np.cumsum(x & _HALF)
        else:
            x, y = x.astype(U64) + U64(1), times[k : k + BLOCK]
            high, low = np.cumsum(x * (y >> U64(31))), np.cumsum(x * (y & _HALF))
        high = reduced(high)
        low = reduced(low)
        low += high >> U64(30)
        high &= _THIRTY
        high <<= U64(31)
        low += high
        low += last
        out[k + 1 : k + 1 + len(x)] = reduced(low)
        last = out[k + len(x)]
    return out


class Powers:
    """Powers of a number and of its inverse modulo the prime, grown on demand by doubling."""

    def __init__(self, base: int):
        prime = int(PRIME)
        self.base = base % (prime - 2) + 2
        self.inverse = pow(self.base, -1, prime)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            step = [U64(pow(x, size, int(PRIME))) for x in (self.base, self.inverse)]
            self.up = np.concatenate([self.up, product(self.up, step[0])])
            self.down = np.concatenate([self.down, product(self.down, step[1])])
        return self.up[:n], self.down[:n]


class Hasher:
    """Hashes of byte ranges and of sequences of hashes; equal seeds give equal hashes in every process.

    Two different strings of n bytes meet for at most n of the 2^61 bases, whatever they hold.
    """

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bytes, self.words = (Powers(int(x)) for x in rng.integers(1 << 60, 1 << 61, 2))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        up, _ = self.bytes.upto(len(data) + 1)
        return running(data, up[: len(data)])

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self.bytes.upto(len(prefix))
        return mix(product(reduced(prefix[end] + (PRIME - prefix[start])), down[start]) + (end - start).astype(U64) * U64(0xA24BAED4963EE407))

    def runs(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ranges of a sequence of hashes."""
        up, down = self.words.upto(len(hashes) + 1)
        total = running(product(reduced(hashes), up[: len(hashes)]))
        return mix(product(reduced(total[end] + (PRIME - total[start])), down[start]) + (end - start).astype(U64) * U64(0x9FB21C651E98DF25))


class _Quick:
    """Powers of an odd number and of its inverse modulo 2^64, grown on demand, and a table of bytes."""

    up = down = np.ones(1, U64)
    table = mix(np.arange(1, 257, dtype=U64))

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            made = []
            for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)):
                steps = np.full(max(n, 1 << 18), U64(x))
                steps[0] = U64(1)
                made.append(np.multiply.accumulate(steps))
            cls.up, cls.down = made
        return cls.up[:n], cls.down[:n]


def quick_grams(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each width bytes, modulo 2^64: good for choosing places, as equal bytes have equal hashes, but different ones may meet."""
    up, down = _Quick.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_Quick.table[data] * up[:-1], out=total[1:])
    return mix((total[width:] - total[: len(data) - width + 1]) * down[: len(data) - width + 1])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and len + 1 offsets into them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, row after the last, bytes, offsets) of runs of rows with up to limit bytes, or of one longer row."""
    data, ends = buffers(column)
    low, rows = 0, len(ends) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + limit, side="right")) - 1)
        yield low, high, data[ends[low] : ends[high]], ends[low : high + 1] - ends[low]
        low = high


def word_bounds(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of true values; a run never crosses from one row into the next."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(ends, start, side="right") - 1


def long_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """list<int64> with so many values for each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int64, copy=False), pa.int64()))


def pair_bytes(high: np.ndarray, low: np.ndarray) -> pa.Array:
    """16-byte values from two columns of 64 bits."""
    raw = np.empty((len(high), 2), ">u8")
    raw[:, 0], raw[:, 1] = high, low
    offsets = np.arange(len(high) + 1, dtype=np.int32) * 16
    return pa.BinaryArray.from_buffers(pa.binary(), len(high), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def in_bloom(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) may be among those of common.bloom()."""
    found, bits = np.ones(len(hashes), bool), len(words) * 64
    for spot in ((hashes >> U64(65 - bits.bit_length())).astype(np.int64), ((hashes >> U64(12)) & U64(bits - 1)).astype(np.int64)):
        found &= (words[spot >> 6] >> (spot & 63)) & 1 == 1
    return found
