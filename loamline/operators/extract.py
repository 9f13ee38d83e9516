"""Extraction: bytes to Markdown and metadata by an ordered chain of parsers, and the clean-up of extracted Markdown."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions.columns import let
from loamline.functions.text import code_like

MARKDOWN_EXTENSIONS = {"md", "markdown", "mdown", "mkd", "mkdn"}
HTML_EXTENSIONS = {"html", "htm", "xhtml"}
#: What the plain-text parser takes, with lock files by name.
PLAIN_EXTENSIONS = set("txt text rs py js mjs ts tsx json yaml yml toml lock c h cpp hpp go java rb php sh css scss sql xml ini cfg log".split())
LOCK_NAMES = {"Cargo.lock", "package-lock.json", "yarn.lock", "poetry.lock", "Gemfile.lock"}


class Declined(Exception):
    """This parser doesn't take the document; the next one may."""


class Unsupported(Exception):
    """No parser may take the document."""


# --- native forms, for tables of pages and texts -------------------------------------------------------------------


def html_title(html: Column) -> Column:
    """The title element's text, else the first h1's; null without either."""
    inner = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1), "<[^>]*>", ""), r"\s+", " ")), F.lit(""))
    return F.coalesce(inner("title"), inner("h1"))


def inner_markup(html: Column, tag: str) -> Column:
    """What lies inside each element of a kind, in order: nested ones count inside the outer one and for themselves; one that isn't closed ends with the page.

    Tags cut the page into pieces, a running depth over the tags tells each opening one's end, and the pieces and tags between are joined again.
    """
    pattern = rf"(?i)</?{tag}(?:[\s/][^>]*)?>"
    # How deep the page is after each tag; a closing tag without an opening one changes nothing.
    depth = lambda tags: F.aggregate(tags, F.array().cast("array<int>"), lambda seen, t: F.concat(seen, F.array(F.greatest(F.lit(0), F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(0)) + F.when(t.startswith("</"), -1).otherwise(1)))))

    def inside(x: Column, k: Column) -> Column:
        rest = F.slice(x["after"], k + 2, F.size(x["tags"]))
        end = F.array_position(rest, F.get(x["after"], k) - 1)
        n = F.when(end == 0, F.size(x["tags"]) - k - 1).otherwise(end - 1).cast("int")
        between = F.zip_with(F.slice(x["tags"], k + 2, n), F.slice(x["pieces"], k + 3, n), lambda t, p: F.concat(t, p))
        return F.concat(F.get(x["pieces"], k + 1), F.array_join(between, ""))

    def every(x: Column) -> Column:
        opens = F.filter(F.transform(x["tags"], lambda t, k: F.when(~t.startswith("</"), k)), lambda k: k.isNotNull())
        return F.transform(opens, lambda k: inside(x, k))

    cut = let(F.struct(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)).alias("tags"), F.split(html, pattern, -1).alias("pieces")), lambda x: F.struct(x["tags"].alias("tags"), x["pieces"].alias("pieces"), depth(x["tags"]).alias("after")))
    return let(cut, every)


def html_main(html: Column) -> Column:
    """The main content's markup: every article, after the first header unless that is blank, else main, else role=main, else body, else everything."""
    header = F.coalesce(F.get(inner_markup(html, "header"), 0), F.lit(""))
    joined = lambda found: F.when(F.size(found) > 0, F.concat(F.when(F.trim(F.regexp_replace(header, r"\s+", " ")) == "", "").otherwise(header), F.array_join(found, "")))
    some = [r"(?is)<[a-z]+\s[^>]*role=[\"']?main[\"']?[^>]*>(.*)", r"(?is)<body(?:\s[^>]*)?>(.*)</body\s*>"]
    main = F.nullif(F.get(inner_markup(html, "main"), 0), F.lit(""))
    return F.coalesce(let(inner_markup(html, "article"), joined), main, *(F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in some), html)


def html_text(html: Column) -> Column:
    """The main content's text: scripts, styles and tags dropped, white space collapsed."""
    bare = F.regexp_replace(html_main(html), r"(?is)<(script|style|nav|footer)(?:\s[^>]*)?>.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " "))


def markdown_title(text: Column) -> Column:
    """The first level-one heading of Markdown with any line ends."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.nullif(F.trim(F.regexp_extract(unix, r"(?m)^ {0,3}#[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$", 1)), F.lit(""))


def page_ranges(rows: DataFrame, key: str, page: str) -> DataFrame:
    """key, ranges: pages as compact ranges, 3-5, 9, by gaps and islands."""
    from pyspark.sql import Window

    own = rows.select(key, page).distinct()
    islands = own.withColumn("island", F.col(page) - F.row_number().over(Window.partitionBy(key).orderBy(page)))
    spans = islands.groupBy(key, "island").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    told = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    return spans.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", told.alias("t")))), lambda x: x["t"]), ", ").alias("ranges"))


# --- HTML ---------------------------------------------------------------------------------------------------------

_DROPPED = {"script", "style", "nav", "footer", "noscript", "template", "svg"}
_BLOCK = {"p", "div", "section", "article", "main", "header", "body", "ul", "ol", "table", "blockquote", "figure", "dl", "dd", "dt", "form", "aside"}


class _Markdown(HTMLParser):
    """Our own rules: headings, paragraphs, lists, quotes, code, tables, links, images and emphasis; anything else is its text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.lists: list[list] = []
        self.pre = False
        self.links: list[str] = []
        self.rows: list[list[str]] | None = None
        self.cell: int | None = None

    def handle_starttag(self, tag: str, attrs) -> None:
        have = dict(attrs)
        if tag in _DROPPED:
            self.skip += 1
        elif self.skip:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a":
            self.links.append(have.get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{have.get('alt') or ''}]({have.get('src') or ''})")
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            self.cell = len(self.out)
        elif tag in _BLOCK:
            self.out.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in _DROPPED:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag == "pre":
            self.pre = False
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("td", "th") and self.cell is not None:
            text = re.sub(r"\s+", " ", "".join(self.out[self.cell :])).strip()
            del self.out[self.cell :]
            self.cell = None
            if self.rows:
                self.rows[-1].append(text)
        elif tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if r], None
            self.out.append("\n\n" + pipe_table(rows) + "\n\n" if rows else "")
        elif tag in _BLOCK or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def pipe_table(rows: list[list[str]]) -> str:
    """Rows, the first being the header, as a pipe table padded to the widest row, with | escaped."""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(x.replace("|", "\\|") for x in r + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


class _Outline(HTMLParser):
    """Where elements begin and end in the source, by tag and attributes."""

    VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.starts = [0]
        for line in source.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.open: list[tuple[str, dict, int]] = []
        self.found: list[tuple[str, dict, int, int]] = []
        self.feed(source)
        self.close()
        for tag, have, start in self.open:
            self.found.append((tag, have, start, len(source)))

    def _here(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag not in self.VOID:
            self.open.append((tag, dict(attrs), self._here() + len(self.get_starttag_text() or "")))

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if at is not None:
            here = self._here()
            self.found += [(t, h, s, here) for t, h, s in self.open[at:]]
            del self.open[at:]


def html_to_markdown(source: str) -> tuple[str, str | None]:
    """Markdown of the main content, and the title.

    All outermost articles, after the first header that isn't empty, else main, else role=main, else body, else everything.
    """
    found = sorted(_Outline(source).found, key=lambda x: x[2])
    pick = lambda test: [x for x in found if test(x)]
    articles: list[tuple] = []
    for x in pick(lambda x: x[0] == "article"):
        if not articles or x[2] >= articles[-1][3]:
            articles.append(x)
    headers = pick(lambda x: x[0] == "header" and not any(a[2] <= x[2] < a[3] for a in articles) and re.sub("<[^>]*>|\\s", "", source[x[2] : x[3]]))
    one = lambda rows: [(x[2], x[3]) for x in rows[:1]]
    spans = (one(headers) + [(x[2], x[3]) for x in articles] if articles else []) or one(pick(lambda x: x[0] == "main")) or one(pick(lambda x: x[1].get("role") == "main")) or one(pick(lambda x: x[0] == "body")) or [(0, len(source))]
    pieces = []
    for a, b in spans:
        parser = _Markdown()
        parser.feed(source[a:b])
        parser.close()
        pieces.append(tidy("".join(parser.out)))
    markdown = "\n\n".join(p for p in pieces if p)
    titles = [re.sub(r"\s+", " ", re.sub("<[^>]*>", "", source[x[2] : x[3]])).strip() for x in found if x[0] == "title"]
    first = re.search(r"(?m)^# (.+)$", markdown)
    return markdown, next((t for t in titles if t), first[1].strip() if first else None)


def tidy(markdown: str) -> str:
    """No blanks at line ends, at most one empty line in a row outside fences."""
    lines = [re.sub(r"[ \t]+$", "", x) for x in markdown.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


# --- Markdown of extracted pages ----------------------------------------------------------------------------------


# What a heading doesn't end with, as marks and as words in lower case.
HEADING_MARKS = ",;-—("
HEADING_TAILS = ("and", "the", "of", "to", "with", "an", "from", "by", "as", "than", "into", "onto", "upon")


def spurious_heading(content: str) -> bool:
    """Whether a heading's text can't be one: too long, several sentences, a dangling tail, a lower-case start or a shell's mark.

    A colon at the end is a heading's. A lower-case start is, too, if its first word goes on with a capital, or the next word begins with one.
    """
    text = content.strip()
    words = text.split()
    if not words:
        return False
    initial = lambda x: next((c for c in x if c.isalpha()), "")
    # A full stop after a single letter closes an initial, not a sentence.
    sentences = sum(m[1].isupper() for m in re.finditer(r"(?<!\b[^\W\d_])[.!?]\s+(\S)", text))
    tail = text[-1] in HEADING_MARKS or re.sub(r"[\W_]", "", words[-1]) in HEADING_TAILS
    titled = any(c.isupper() for c in words[0][1:]) or initial("".join(words[1:2])).isupper()
    shell = re.match(r"[$>] |#!|C:\\|\[(?:[^\w\s]|_)\] ", text)
    return len(text) > 200 or "\n" in text or sentences >= 2 or tail or initial(text).islower() and not titled or bool(shell)


def demote_headings(markdown: str) -> str:
    """Spurious headings outside fences become paragraphs."""
    out, fence = [], None
    for line in markdown.split("\n"):
        mark = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", line)
        if fence:
            fence = None if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip() else fence
        elif mark:
            fence = mark[1]
        else:
            head = re.match(r"( {0,3})#{1,6}[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$", line)
            line = head[1] + head[2] if head and spurious_heading(head[2]) else line
        out.append(line)
    return "\n".join(out)


def prose_like_text(content: str) -> bool:
    """functions.text.prose_like for one Python string."""
    text, words = content.strip(), content.split()
    if len(words) < 8:
        return False
    letters = sum(c.isalpha() for c in text)
    plain = sum(bool(re.fullmatch(r"[^\W\d_]+", re.sub(r"^[\W_]+|[\W_]+$", "", w))) for w in words)
    marks = sum(c in ".,?!" for c in text)
    return letters / max(1, sum(not c.isspace() for c in text)) > 0.85 and plain / len(words) > 0.7 and 3 <= letters / len(words) <= 8 and marks / len(text) > 0.005


def demote_fences(markdown: str) -> str:
    """Bare fences around prose, and not around anything like code, go; their content stays."""

    def open_up(m: re.Match) -> str:
        return m[2].rstrip("\n") if prose_like_text(m[2]) and not code_like(m[2]) else m[0]

    return re.sub(r"(?ms)^(`{3,})[ \t]*\n(.*?)^\1[ \t]*$", open_up, markdown)


def pdf_string(raw: bytes) -> str:
    """A PDF text string: UTF-16BE or UTF-8 after a byte order mark, else single bytes."""
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw[3:].decode("utf-8", "replace") if raw[:3] == b"\xef\xbb\xbf" else raw.decode("latin-1")


# --- parsers ------------------------------------------------------------------------------------------------------


def _extension(name: str) -> str:
    base = name.rpartition("/")[2]
    return base.rpartition(".")[2].lower() if "." in base[1:] else ""


def _utf8(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Declined from e


def parse_markdown(name: str, content: bytes) -> tuple[str, str | None, dict]:
    if _extension(name) not in MARKDOWN_EXTENSIONS:
        raise Declined
    text = _utf8(content).replace("\r\n", "\n")
    title = re.search(r"(?m)^ {0,3}#[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$", text)
    return text, title[1].strip() or None if title else None, {}


def parse_html(name: str, content: bytes) -> tuple[str, str | None, dict]:
    if _extension(name) not in HTML_EXTENSIONS and content.lstrip()[:1] != b"<":
        raise Declined
    markdown, title = html_to_markdown(_utf8(content))
    return markdown, title, {}


def parse_plain(name: str, content: bytes) -> tuple[str, str | None, dict]:
    if _extension(name) not in PLAIN_EXTENSIONS and name.rpartition("/")[2] not in LOCK_NAMES:
        raise Declined
    return _utf8(content), None, {}


def parse_csv(name: str, content: bytes) -> tuple[str, str | None, dict]:
    if _extension(name) != "csv":
        raise Declined
    rows = [r for r in csv.reader(io.StringIO(_utf8(content))) if r]
    return pipe_table(rows) if rows else "", None, {}


def parse_office(name: str, content: bytes) -> tuple[str, str | None, dict]:
    """docx paragraphs (with heading styles) and tables, pptx slides."""
    kind = _extension(name)
    if kind not in ("docx", "pptx"):
        raise Declined
    archive = zipfile.ZipFile(io.BytesIO(content))
    tag = lambda n: n.tag.rpartition("}")[2]
    inner = lambda n: "".join(t.text or "" for t in n.iter() if tag(t) == "t")
    if kind == "pptx":
        slides = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        parts = [[inner(p).strip() for p in ET.fromstring(archive.read(n)).iter() if tag(p) == "p"] for n in slides]
        return "\n\n".join(f"## Slide {k}\n\n" + "\n\n".join(x for x in p if x) for k, p in enumerate(parts, 1)), None, {}
    body = next(n for n in ET.fromstring(archive.read("word/document.xml")) if tag(n) == "body")
    out, title = [], None
    for node in body:
        if tag(node) == "tbl":
            rows = [[inner(c).strip() for c in r if tag(c) == "tc"] for r in node if tag(r) == "tr"]
            out.append(pipe_table(rows) if rows else "")
        elif tag(node) == "p" and inner(node).strip():
            style = next((v for s in node.iter() if tag(s) == "pStyle" for v in s.attrib.values()), "")
            level = re.fullmatch(r"(?i)heading\s*([1-6])", style) or (re.fullmatch("(?i)title", style) and re.match("()", ""))
            depth = int(level[1] or 1) if level else 0
            title = title or (inner(node).strip() if depth == 1 else None)
            out.append(("#" * depth + " " if depth else "") + inner(node).strip())
    return "\n\n".join(x for x in out if x), title, {}


def parse_epub(name: str, content: bytes) -> tuple[str, str | None, dict]:
    """Chapters in spine order and the package's Dublin Core; a book without text is an error."""
    if _extension(name) != "epub":
        raise Declined
    archive = zipfile.ZipFile(io.BytesIO(content))
    tag = lambda n: n.tag.rpartition("}")[2]
    package = next(n.attrib["full-path"] for n in ET.fromstring(archive.read("META-INF/container.xml")).iter() if tag(n) == "rootfile")
    opf = ET.fromstring(archive.read(package))
    items = {n.attrib["id"]: n.attrib["href"] for n in opf.iter() if tag(n) == "item"}
    spine = [items[n.attrib["idref"]] for n in opf.iter() if tag(n) == "itemref" and n.attrib["idref"] in items]
    chapters = [html_to_markdown(archive.read(posixpath.normpath(posixpath.join(posixpath.dirname(package), h))).decode("utf-8", "replace"))[0] for h in spine]
    markdown = "\n\n".join(c for c in chapters if c)
    if not markdown:
        raise ValueError("the book has no text")
    meta = {f"dc.{tag(n)}": n.text.strip() for n in opf.iter() if n.tag.startswith("{http://purl.org/dc/elements/1.1/}") and n.text and n.text.strip()}
    return markdown, meta.get("dc.title"), meta


def parse_pdf(name: str, content: bytes) -> tuple[str, str | None, dict]:
    if content[:4] != b"%PDF" and _extension(name) != "pdf":
        raise Declined
    raise Unsupported("no PDF reader is installed")


#: Asked in this order; the first that doesn't decline decides, and a failure ends the chain.
PARSERS: list[tuple[str, Callable[[str, bytes], tuple[str, str | None, dict]]]] = [
    ("pdf", parse_pdf), ("epub", parse_epub), ("office", parse_office), ("csv", parse_csv), ("html", parse_html), ("markdown", parse_markdown), ("plaintext", parse_plain),
]
PARSED = "uri string, status string, reason string, parser string, markdown string, title string, meta map<string,string>"


def parse_documents(raw: DataFrame, parsers=None) -> DataFrame:
    """uri, status (ok, unsupported, empty or error), reason, parser, markdown, title, meta of raw (uri, content).

    Whatever a document does to a parser, only its own row says so.
    """
    chain = PARSERS if parsers is None else parsers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse_one(u, c, chain) for u, c in zip(batch["uri"], batch["content"], strict=True)], columns=["uri", "status", "reason", "parser", "markdown", "title", "meta"])

    return raw.select("uri", "content").mapInPandas(run, PARSED)


def parse_one(uri: str, content: bytes | None, chain=None) -> tuple:
    for name, parser in PARSERS if chain is None else chain:
        try:
            markdown, title, meta = parser(uri, bytes(content or b""))
        except Declined:
            continue
        except Unsupported as e:
            return uri, "unsupported", str(e), name, None, None, {}
        except Exception as e:  # one document must not stop the others
            return uri, "error", f"{type(e).__name__}: {e}"[:300], name, None, None, {}
        return uri, "ok" if markdown.strip() else "empty", None, name, markdown, title, meta
    return uri, "unsupported", "no parser takes it", None, None, None, {}
