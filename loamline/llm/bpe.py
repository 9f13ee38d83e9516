"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word (a match of the split pattern) starts as one part for each byte. Its ids and the ranks of adjacent pairs are held in two flat
arrays: the least rank is scanned for, its boundary deleted, and the two neighbouring ranks refreshed, until no pair has a rank.
Scanning beats any queue for short words. A word of over LONG_WORD bytes takes a heap of pairs over a
linked list instead, which gives the same merges in n log n steps. Each worker keeps the ids of the words it has met in a cache of bounded size.

Defined results: a null text is an empty one and has no ids. Special tokens in a text become their ids, as added tokens of the file say.
Decoding joins the bytes of the tokens and reads them as UTF-8, with U+FFFD for what isn't.
"""

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.session import shipped

#: The default vocabulary; its path is a parameter everywhere.
VOCABULARY = "byte_bpe_50k.json"
LONG_WORD = 200
CACHE_WORDS = 200_000
#: Rows of a result batch.
ROWS = 256
#: Fixed value: the pattern that splits texts before merging. White space is Unicode's White_Space.
SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# Code points that became letters or numbers in Unicode 17; the vocabulary's library, at Unicode 16, doesn't know them.
LATER = """
    558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
    10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8
    16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
    1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
    1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""


def pattern(later: bool) -> str:
    """The split pattern; later: for texts that may hold code points of LATER."""
    out = "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in LATER.split()) if later else ""
    letter, number = (rf"[\p{{{x}}}--[{out}]]" if later else rf"\p{{{x}}}" for x in "LN")
    other = rf"[^{SPACE}\p{{L}}\p{{N}}]" if not later else rf"(?:[^{SPACE}\p{{L}}\p{{N}}]|[{out}])"
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Codec(dict):
    """Encodes and decodes with one vocabulary; as a dict it maps words to their ids as packed little-endian 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        marks = byte_characters()
        raw = {c: b for b, c in enumerate(marks)}
        self.first = [vocabulary[c] for c in marks]
        self.shift = max(vocabulary.values()).bit_length()
        # A pair of ids packed into one integer -> (rank, merged id).
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocabulary[a] << self.shift | vocabulary[b]] = rank, vocabulary[a + b]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: bytes(raw[c] for c in t) for t, i in vocabulary.items()} | {i: t.encode() for t, i in self.special.items()}
        self.plain, self.full = regex.compile(pattern(False)), regex.compile(pattern(True), regex.V1)
        self.high = regex.compile(r"[\u0530-\U0010FFFF]")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        raw = word.encode()
        ids = self.merge([self.first[b] for b in raw]) if len(raw) <= LONG_WORD else self.merge_long([self.first[b] for b in raw])
        packed = np.array(ids, "<u4").tobytes()
        if len(raw) <= LONG_WORD:
            self[word] = packed
        return packed

    def merge(self, ids: list[int]) -> list[int]:
        """Contiguous rank array: ranks[k] belongs to the boundary between parts k and k + 1."""
        pairs, shift, none = self.pairs, self.shift, (1 << 60, 0)
        ranks = [pairs.get(a << shift | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least is none or least[0] == none[0]:
                break
            k = ranks.index(least)
            ids[k] = least[1]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = pairs.get(ids[k - 1] << shift | ids[k], none)
            if k < len(ranks):
                ranks[k] = pairs.get(ids[k] << shift | ids[k + 1], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges, least rank first and leftmost among equals, by a heap over a linked list of parts."""
        pairs, shift, n = self.pairs, self.shift, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(found[0], k, key, found[1]) for k in range(n - 1) if (found := pairs.get(key := ids[k] << shift | ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            _, k, key, new = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j < 0 or ids[k] << shift | ids[j] != key:
                continue  # a part has changed since
            ids[k], ids[j], after[k] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a in (before[k], k):
                if a >= 0 and (b := after[a]) >= 0 and (found := pairs.get(key := ids[a] << shift | ids[b])):
                    heapq.heappush(heap, (found[0], a, key, found[1]))
        return [x for x in ids if x >= 0]

    def words(self, text: str) -> list[str]:
        return (self.full if self.high.search(text) else self.plain).findall(text)

    def encode_ordinary(self, text: str) -> bytes:
        """Like encode(), but special tokens in the text are ordinary text."""
        return b"".join(map(self.__getitem__, self.words(text)))

    def encode(self, text: str) -> bytes:
        """The ids as packed little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(t in text for t in self.special):
            return b"".join(map(self.__getitem__, self.words(text)))
        pieces = self.cut.split(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if k % 2 else b"".join(map(self.__getitem__, self.words(x))) for k, x in enumerate(pieces))

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each row. The vocabulary's path must be readable on every executor."""
    path = path or default_path()
    rows = shipped(documents).select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches):
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                packed = [own.encode(x) for x in part.column(1).to_pylist()]
                ends = np.zeros(len(packed) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in packed], out=ends[1:])
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of encode()'s result."""
    path = path or default_path()

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = shipped(encoded).select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digest(documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, encoded and decoded in one pass so that ids don't leave the worker."""
    path = path or default_path()
    rows = shipped(documents).select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches):
        own = codec(path)
        for batch in batches:
            n, ids, texts = [], [], []
            for value in batch.column(1):
                packed = own.encode(value.as_py())
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts.append(hashlib.sha256(own.decode(packed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
