"""Content-derived identifiers: SHA-256 in lower-case hex, with parts joined by unambiguous separators."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "|"


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, *(p.cast("string") for p in parts)), 256)


def resource_id(uri: Column, content_hash: Column) -> Column:
    return _digest(uri, content_hash)


def chunk_id(resource: Column, block_seq: Column, text: Column, seq_in_block: Column) -> Column:
    """The span is no part of it, so moving text inside a block keeps the id."""
    return _digest(resource, block_seq, text, seq_in_block)


def block_piece(kind: Column, text: Column, page: Column | None = None) -> Column:
    piece = F.concat_ws(":", kind, text)
    return piece if page is None else F.concat(piece, F.coalesce(F.concat(F.lit("\x01p"), page.cast("string")), F.lit("")))


def content_hash(blocks: Column) -> Column:
    """Of an array of structs kind, text, page: kind and text of each, and its page if it has one, joined by U+0000."""
    return F.sha2(F.array_join(F.transform(blocks, lambda b: block_piece(b["kind"], b["text"], b["page"])), "\0"), 256)


def policy_version(algorithm: str, preset_overrides: dict, model: str, provider: str, parsers: list[str]) -> str:
    """The hash of what makes indexed content stale; keys are sorted, the order of parsers counts, chunk sizes don't."""
    policy = {"chunking": {"algorithm": algorithm, "preset_overrides": preset_overrides}, "embedding": {"model": model, "provider": provider}, "parsers": parsers}
    return hashlib.sha256(json.dumps(policy, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
