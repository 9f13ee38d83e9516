"""Chunking: which chunker takes a block, the chunkers, and the stamping of ids.

Greedy packing is a scan of one document, so a document's chunks come from one pass over its rows in Python; all that can
be an expression (routing, windows of turns, the structureless probe) is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions import ids
from loamline.functions.text import extension
from loamline.operators.blocks import is_separator_row

# Extensions that route to presets, and lock files by name.
CODE_EXTENSIONS = "rs py js mjs ts tsx json yaml yml toml lock c h cpp hpp go java rb php sh css scss sql csv xml ini cfg xlsx xls".split()
LOCKFILES = ["Cargo.lock", "package-lock.json", "yarn.lock", "poetry.lock", "Gemfile.lock"]


@dataclass(frozen=True)
class Preset:
    target: int
    overlap: int = 0
    window: int = 6
    stride: int = 3


#: Tokens for prose and messages, characters for code. Without a tokenizer a token counts as four characters.
PRESETS = {"prose": Preset(256), "code": Preset(3000), "messages": Preset(512)}
CHARS_PER_TOKEN = 4
PASSTHROUGH = ("reference", "attachment", "frontmatter", "image")


def preset_for(name: Column, mime: Column) -> Column:
    """code or prose: by MIME type, then lock file name, then extension; prose if nothing tells."""
    base = F.element_at(F.split(name, "/"), -1)
    by_mime = F.when((mime == "application/json") | mime.startswith("text/x-"), "code").when(mime == "text/plain", "prose")
    by_name = F.when(base.isin(LOCKFILES) | F.lower(extension(name)).isin(CODE_EXTENSIONS), "code")
    return F.coalesce(by_mime, by_name, F.lit("prose"))


def structureless(text: Column, target: int = PRESETS["prose"].target) -> Column:
    """Whether prose splitting would get nowhere: a run without spaces over 8 targets long, or a line over 64."""
    longest = lambda parts: F.array_max(F.transform(parts, lambda x: F.length(x)))
    return (longest(F.split(text, r"\s+", -1)) > 8 * target) | (longest(F.split(text, "\n", -1)) > 64 * target)


# --- splitters: (start, end) in characters of the block's text ------------------------------------------------------


def split_long(text: str, start: int, end: int, target: int) -> list[tuple[int, int]]:
    """Pieces of up to target characters; a piece ends after its last blank if it stays longer than half of it in bytes."""
    out = []
    while start < end:
        stop = min(end, start + target)
        piece = text[start:stop]
        blank = max((m.end() for m in re.finditer(r"\s", piece)), default=0)
        if blank and len(piece[:blank].encode()) * 2 > len(piece.encode()):
            stop = start + blank
        out.append((start, stop))
        start = stop
    return out


def split_code(text: str, target: int) -> list[tuple[int, int]]:
    """Lines packed greedily. A line counts as too long by characters, packing counts bytes."""
    out: list[tuple[int, int]] = []
    held = None
    at = 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        end = at + len(line)
        if len(line) > target:
            if held:
                out.append(held)
            held = None
            out += split_long(text, at, end, target)
        elif held and len(text[held[0] : end].encode()) > target:
            out.append(held)
            held = (at, end)
        else:
            held = (held[0] if held else at, end)
        at = end
    return out + [held] if held else out


_UNITS = (r"\n[ \t]*\n\s*", r"(?<=[.!?])[\"')\]]*\s+", r"\s+")


def split_prose(text: str, target: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Our own rule: paragraphs, else sentences, else words, else characters, packed greedily up to target characters; pieces
    are trimmed and their spans exact. With an overlap of less than three quarters of the target, a piece begins with the last whole words before it."""

    def units(start: int, end: int, level: int) -> list[tuple[int, int]]:
        if end - start <= target or level == len(_UNITS):
            return [(start, end)] if end - start <= target else [(a, min(a + target, end)) for a in range(start, end, target)]
        parts, at = [], start
        for m in re.finditer(_UNITS[level], text[start:end]):
            parts.append((at, start + m.start()))
            at = start + m.end()
        parts.append((at, end))
        return [u for a, b in parts if b > a for u in units(a, b, level + 1)]

    out: list[tuple[int, int]] = []
    for a, b in units(0, len(text), 0):
        if out and b - out[-1][0] <= target:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    if 0 < overlap < target * 3 / 4:
        back = lambda a, low: next((a - overlap + m.end() for m in [re.search(r"\s+", text[max(low, a - overlap) : a])] if m and a - overlap >= low), a)
        out = [(back(a, out[k - 1][0]) if k else a, b) for k, (a, b) in enumerate(out)]
    trim = lambda a, b: (a + len(text[a:b]) - len(text[a:b].lstrip()), b - (len(text[a:b]) - len(text[a:b].rstrip())))
    return [x for x in (trim(a, b) for a, b in out) if x[1] > x[0]]


def split_table(text: str, target: int) -> list[tuple[str, int, int]]:
    """(text, start, end): rows packed greedily below a repeated header and separator. A row that alone is too long, and
    a table without a separator, are split like code; a table of a header alone is one chunk."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((line, at, at + len(line)))
        at += len(line) + 1
    head = next((k for k, x in enumerate(lines) if x[0].strip()), None)
    if head is None:
        return []
    if "|" not in lines[head][0] or head + 1 >= len(lines) or not is_separator_row(lines[head + 1][0]):
        return [(text[a:b], a, b) for a, b in split_code(text, target)]
    top = lines[head][0] + "\n" + lines[head + 1][0]
    rows = [x for x in lines[head + 2 :] if x[0].strip()]
    if not rows:
        return [(text, 0, len(text))]
    out: list[tuple[str, int, int]] = []
    held: list[tuple[str, int, int]] = []

    def flush() -> None:
        if held:
            out.append((top + "\n" + "\n".join(x[0] for x in held), held[0][1], held[-1][2]))
            held.clear()

    for row in rows:
        if len(top) + 1 + len(row[0]) > target:
            flush()
            out += [(text[a:b], a, b) for a, b in split_long(text, row[1], row[2], target)]
            continue
        if held and len(top) + sum(1 + len(x[0]) for x in (*held, row)) > target:
            flush()
        held.append(row)
    flush()
    return out


def message_prefix(sender: str, timestamp: str | None) -> str:
    return f"[{sender}] ({timestamp}): " if timestamp is not None else f"[{sender}]: "


def segment_prefix(speaker: str | None, start_ms: int, end_ms: int) -> str:
    return (f"[{speaker}] " if speaker is not None else "") + f"({start_ms}-{end_ms}): "


def window_turns(texts: list[str], window: int, stride: int, budget: int) -> list[tuple[int, int]]:
    """Ranges of turns: windows that shrink from their end until they fit. A shrunk one is followed by the turn after it,
    a whole one by the turn a stride on; so each turn is in one at least. A single turn may exceed the budget."""
    out, start = [], 0
    while start < len(texts):
        whole = end = min(start + window, len(texts))
        while end > start + 1 and len("\n\n".join(texts[start:end])) > budget:
            end -= 1
        out.append((start, end))
        start = end if end < whole else start + max(1, stride)
    return out


CHUNKS = "resource_id string, block_seq int, seq_in_block int, kind string, text string, start int, end int, window_block_seqs array<int>"


def chunk_document(resource: str, blocks: list[dict], preset: str = "prose") -> list[dict]:
    """The chunks of one document's blocks (seq, kind, text and, for turns, sender, timestamp, speaker, start_ms, end_ms): windows of turns first, then the other blocks in order."""
    budget = PRESETS[preset].target * (CHARS_PER_TOKEN if preset == "prose" else 1)
    out: list[dict] = []

    def push(seq: int, k: int, kind: str, text: str, start: int, end: int, window: list[int]) -> None:
        out.append({"resource_id": resource, "block_seq": seq, "seq_in_block": k, "kind": kind, "text": text, "start": start, "end": end, "window_block_seqs": window})

    turns = [b for b in blocks if b["kind"] in ("message", "segment") and b["text"]]
    prefix = [message_prefix(b["sender"], b.get("timestamp")) if b["kind"] == "message" else segment_prefix(b.get("speaker"), b["start_ms"], b["end_ms"]) for b in turns]
    texts = [p + b["text"] for p, b in zip(prefix, turns, strict=True)]
    most = PRESETS["messages"].target * CHARS_PER_TOKEN
    for a, b in window_turns(texts, PRESETS["messages"].window, PRESETS["messages"].stride, most):
        first = turns[a]
        if b == a + 1 and len(texts[a]) > most:
            for s, e in split_prose(first["text"], max(1, most - len(prefix[a]))):
                push(first["seq"], len(out), first["kind"], prefix[a] + first["text"][s:e], s, e, [first["seq"]])
        else:
            push(first["seq"], len(out), first["kind"], "\n\n".join(texts[a:b]), 0, 0, [t["seq"] for t in turns[a:b]])
    for block in blocks:
        text, kind, seq = block["text"], block["kind"], block["seq"]
        if kind in ("message", "segment") or not text:
            continue
        if kind in PASSTHROUGH:
            pieces = [(text, 0, len(text))]
        elif kind == "table":
            pieces = split_table(text, budget)
        else:
            runs = max(map(len, text.split()), default=0) > 8 * budget or max(map(len, text.split("\n"))) > 64 * budget
            spans = split_code(text, budget) if kind == "code" or preset == "code" or runs else split_prose(text, budget, PRESETS[preset].overlap)
            pieces = [(text[a:b], a, b) for a, b in spans]
        for k, (piece, a, b) in enumerate(pieces):
            push(seq, k, kind, piece, a, b, [])
    return out


def chunk_blocks(blocks: DataFrame, key: str = "uri") -> DataFrame:
    """Chunks with ids of blocks (key, seq, kind, text; optionally preset, sender, timestamp, speaker, start_ms, end_ms). A document's blocks are gathered as one row."""
    optional = {"preset": "string", "sender": "string", "timestamp": "string", "speaker": "string", "start_ms": "bigint", "end_ms": "bigint"}
    have = [F.col(c) if c in blocks.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()]
    rows = blocks.select(F.col(key).cast("string").alias("resource_id"), "seq", "kind", "text", *have)
    whole = rows.groupBy("resource_id").agg(F.max("preset").alias("preset"), F.array_sort(F.collect_list(F.struct("seq", "kind", "text", *list(optional)[1:]))).alias("blocks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in CHUNKS.split(", ")]
        for batch in batches:
            found = [c for r, p, b in zip(batch["resource_id"], batch["preset"], batch["blocks"], strict=True) for c in chunk_document(r, [dict(x) if not isinstance(x, dict) else x for x in b], p or "prose")]
            yield pd.DataFrame(found, columns=columns)

    return stamp(whole.mapInPandas(run, CHUNKS))


def stamp(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", ids.chunk_id(F.col("resource_id"), F.col("block_seq"), F.col("text"), F.col("seq_in_block")))


def message_windows(turns: DataFrame, window: int = 6, stride: int = 3) -> DataFrame:
    """resource_id, block_seq, window_block_seqs, text for turns (resource_id, seq, sender, text) where every window fits: expressions only."""
    told = F.concat(F.lit("["), F.col("sender"), F.lit("]: "), F.col("text"))
    rows = turns.filter(F.coalesce(F.length("text"), F.lit(0)) > 0).groupBy("resource_id").agg(F.array_sort(F.collect_list(F.struct("seq", told.alias("t")))).alias("turns"))
    starts = F.explode(F.sequence(F.lit(1), F.size("turns"), F.lit(stride))).alias("start")
    own = rows.select("resource_id", "turns", starts).select("resource_id", F.slice("turns", F.col("start"), F.lit(window)).alias("own"))
    return own.select("resource_id", F.get("own", F.lit(0))["seq"].alias("block_seq"), F.transform("own", lambda x: x["seq"]).alias("window_block_seqs"), F.array_join(F.transform("own", lambda x: x["t"]), "\n\n").alias("text"))
