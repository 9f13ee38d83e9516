"""Blocks: Markdown into typed blocks, heading paths, and documents put together again."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators.extract import pipe_table

BLOCKS = "uri string, seq int, kind string, level int, text string, page int"


def split_front_matter(text: str) -> tuple[str | None, str]:
    """The front matter between lines of --- at the very start, with LF or CRLF, and the rest; null if there is none."""
    m = re.match(r"---\r?\n(.*?)(?:\r?\n)?^---[ \t]*(?:\r?\n|\Z)", text, re.S | re.M)
    return (m[1].rstrip("\r\n"), text[m.end() :]) if m else (None, text)


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"^\s*\|?|\|?\s*$", "", line))]


def is_separator_row(line: str) -> bool:
    """Whether every cell of a table line holds a hyphen, and only hyphens, colons and blanks."""
    cells = [c.strip() for c in line.strip().strip("|").split("|")]
    return bool(cells) and all("-" in c and re.fullmatch("[-: ]+", c) for c in cells)


def separator_row(line: Column) -> Column:
    return line.rlike(r"^\s*\|?(?:[-: ]*-[-: ]*\|)*[-: ]*-[-: ]*\|?\s*$")


def page_of(offset: int, page_starts: list[tuple[int, int]]) -> int | None:
    """The page of the last start at or before a byte offset; offsets before every start are on the first page."""
    if not page_starts:
        return None
    at = bisect_right([s for s, _ in page_starts], offset) - 1
    return page_starts[max(0, at)][1]


def to_blocks(markdown: str, page_starts: list[tuple[int, int]] | None = None) -> list[dict]:
    """seq, kind, level, text, page of each block: front matter, headings, code, tables and images one by one; what lies
    between them joined, by blank lines, into runs of text. Thematic breaks go. An image in a paragraph comes before the paragraph."""
    front, body = split_front_matter(markdown)
    out: list[dict] = []
    run: list[str] = []
    run_at = 0
    base = len(markdown.encode()) - len(body.encode())

    def push(kind: str, text: str, at: int, level: int | None = None) -> None:
        out.append({"seq": len(out), "kind": kind, "level": level, "text": text, "page": page_of(at, page_starts or [])})

    def flush() -> None:
        nonlocal run
        if run:
            push("text", "\n\n".join(run), run_at)
        run = []

    if front is not None and front.strip():
        push("frontmatter", front, 0)
    lines = body.split("\n")
    starts, at = [], base
    for line in lines:
        starts.append(at)
        at += len(line.encode()) + 1
    k = 0
    while k < len(lines):
        line, here = lines[k].rstrip("\r"), starts[k]
        fence = re.match(r" {0,3}(`{3,}|~{3,})\s*([^`]*)$", line)
        head = re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line)
        if not line.strip():
            k += 1
        elif fence:
            flush()
            end = next((j for j in range(k + 1, len(lines)) if re.match(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$", lines[j])), len(lines))
            push("code", "\n".join(x.rstrip("\r") for x in lines[k + 1 : end]), here)
            k = end + 1
        elif head:
            flush()
            push("heading", (head[2] or "").strip(), here, len(head[1]))
            k += 1
        elif re.fullmatch(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})", line):
            k += 1
        elif "|" in line and k + 1 < len(lines) and is_separator_row(lines[k + 1]):
            flush()
            end = k + 2
            while end < len(lines) and "|" in lines[end]:
                end += 1
            push("table", pipe_table([_cells(line), *(_cells(x) for x in lines[k + 2 : end])]), here)
            k = end
        else:
            end = k
            while end < len(lines) and lines[end].strip() and not re.match(r" {0,3}(?:`{3,}|~{3,}|#{1,6}[ \t])", lines[end]):
                end += 1
            end = max(end, k + 1)
            piece = "\n".join(x.rstrip("\r") for x in lines[k:end])
            images = re.findall(r"!\[([^\]]*)\]\([^)]*\)", piece)
            if images:
                flush()
                for alt in images:
                    push("image", alt, here)
                piece = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", piece)
            piece = re.sub(r"<[^>\n]+>", "", piece).strip()
            if piece:
                run_at = run_at if run else here
                run.append(piece)
            k = end
    flush()
    return out


def blocks_of(parsed: DataFrame) -> DataFrame:
    """Blocks of parsed documents (uri, markdown); nulls have none."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"uri": u, **b} for u, m in zip(batch["uri"], batch["markdown"], strict=True) for b in to_blocks(m or "")]
            frame = pd.DataFrame(rows, columns=["uri", "seq", "kind", "level", "text", "page"])
            yield frame.astype({"level": "Int32", "page": "Int32"})

    return parsed.select("uri", "markdown").mapInPandas(go, BLOCKS)


def heading_paths(blocks: DataFrame, key: str = "uri") -> DataFrame:
    """Blocks with heading_path: the latest heading of each level before the block, without those that a higher one has closed.

    A skipped level is an empty string. By running windows: a level's heading is open if no heading of a higher rank came later.
    """
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda levels: F.max(F.when((F.col("kind") == "heading") & F.col("level").isin(levels), F.col("seq"))).over(before)
    text = lambda n: F.max_by(F.when((F.col("kind") == "heading") & (F.col("level") == n), F.col("text")), F.when((F.col("kind") == "heading") & (F.col("level") == n), F.col("seq"))).over(before)
    rows = blocks
    for n in range(1, 7):
        closed = F.coalesce(at(list(range(1, n))), F.lit(-1)) if n > 1 else F.lit(-1)
        rows = rows.withColumn(f"__h{n}", F.when(F.coalesce(at([n]), F.lit(-1)) > closed, text(n)))
    path = F.array(*(F.coalesce(f"__h{n}", F.lit("")) for n in range(1, 7)))
    depth = F.greatest(*(F.when(F.col(f"__h{n}").isNotNull(), n).otherwise(0) for n in range(1, 7)))
    return rows.withColumn("heading_path", F.slice(path, F.lit(1), depth)).drop(*(f"__h{n}" for n in range(1, 7)))


class HeadingIndex:
    """Heading paths by character offset in Markdown text; skipped levels leave no gap."""

    def __init__(self, text: str):
        self.at, self.paths, stack = [], [], []
        for m in re.finditer(r"(?m)^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$", text):
            level = len(m[1])
            stack = [(n, t) for n, t in stack if n < level] + [(level, m[2].strip())]
            self.at.append(m.start())
            self.paths.append([t for _, t in stack])

    def path(self, offset: int) -> list[str]:
        k = bisect_right(self.at, offset) - 1
        return self.paths[k] if k >= 0 else []
