"""Scalar functions on text, dates and URIs. Column functions are Catalyst expressions; plain functions work on one Python value."""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of Latin-1 and Latin Extended-A/B that are an ASCII letter with marks, and that letter.
_MARKED = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
_MARKED = [(a, b) for a, b in _MARKED if a != b and b.isascii()]


def fold(text: Column) -> Column:
    """Lower case without diacritics; letters that don't decompose, like U+00DF, stay."""
    return F.translate(F.lower(text), "".join(a.lower() for a, _ in _MARKED if len(a.lower()) == 1), "".join(b.lower() for a, b in _MARKED if len(a.lower()) == 1))


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text, in order."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def collapse_blanks(text: Column, limit: int | None = None) -> Column:
    """White space runs become one space; beyond limit characters the text ends in an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return flat if limit is None else F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def display_uri(uri: Column) -> Column:
    """Percent escapes decoded where they are valid UTF-8; control and bidirectional characters shown as U+FFFD."""
    kept = F.replace(uri, F.lit("+"), F.lit("%2B"))
    decoded = F.coalesce(F.try_url_decode(kept), uri)
    return F.regexp_replace(decoded, r"[\p{Cc}\u061C\u200E\u200F\u202A-\u202E\u2066-\u2069]", "\uFFFD")


def last_segment(uri: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(uri, r"[?#].*$", ""), r"/+$", ""), "/"), -1)


def extension(name: Column) -> Column:
    """After the last dot of the last component, unless the dot comes first; null without one."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"^.+\.([^.]*)$", 1), F.lit(""))


def valid_store_name(name: Column) -> Column:
    """Not empty, not . or .., and without slashes."""
    return F.coalesce((name != "") & ~name.isin(".", "..") & ~name.rlike(r"[/\\\\]"), F.lit(False))


def reference_kind(value: Column) -> Column:
    """How a value that names a source is read: url, id (26 capitals and digits, or 36 hex digits and hyphens) or path."""
    return F.when(value.rlike("^https?://"), "url").when(value.rlike("^[0-9A-Z]{26}$") | value.rlike("^[0-9A-Fa-f-]{36}$"), "id").otherwise("path")


def rfc3339(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def duration_seconds(value: Column) -> Column:
    """24h, 30m, 3600s, 2d or plain seconds; null for anything else, zero and overflow."""
    number = F.regexp_extract(value, r"^([0-9]{1,18})([smhd]?)$", 1)
    unit = F.regexp_extract(value, r"^([0-9]{1,18})([smhd]?)$", 2)
    scale = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)
    seconds = F.try_multiply(F.nullif(number, F.lit("")).cast("long"), scale.cast("long"))
    return F.when(seconds > 0, seconds)


def retry_after(value: str, now: datetime, cap: int = 120) -> int | None:
    """Seconds to wait by a Retry-After header, which holds seconds or an HTTP date; at most cap."""
    value = value.strip()
    if value.isdigit():
        return min(int(value), cap)
    try:
        when = parsedate_to_datetime(value)
    except (TypeError, ValueError):
        return None
    when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    return max(0, min(int((when - now).total_seconds()), cap))


def human_size(size: Column) -> Column:
    """Bytes in the largest unit of 1024 that leaves at least 1."""
    out = F.format_string("%d B", size.cast("long"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        # A tie of the first decimal goes to the even digit.
        out = F.when(size >= 1024**k, F.format_string(f"%.1f {unit}", F.bround(size / float(1024**k), 1))).otherwise(out)
    return out


def keywords(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def strip_soft_hyphens(text: Column) -> Column:
    return F.replace(text, F.lit("\u00ad"), F.lit(""))


def pdf_date(value: Column) -> Column:
    """D:YYYY[MM[DD[HHmmSS]]] as an ISO date of the same precision; null if it isn't one."""
    part = lambda k: F.regexp_extract(value, r"^(?:D:)?([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?", k)
    month, day = F.coalesce(F.try_to_number(F.nullif(part(2), F.lit("")), F.lit("99")), F.lit(0)), F.coalesce(F.try_to_number(F.nullif(part(3), F.lit("")), F.lit("99")), F.lit(0))
    has_month, has_day = month.between(1, 12), day.between(1, 31)
    dated = F.when(has_month & has_day, F.concat_ws("-", part(1), part(2), part(3))).when(has_month, F.concat_ws("-", part(1), part(2))).otherwise(part(1))
    timed = F.concat(dated, F.lit("T"), part(4), F.lit(":"), part(5), F.lit(":"), part(6))
    return F.when(part(1) == "", None).when(has_month & has_day & (part(6) != ""), timed).otherwise(dated)


def scanned(text: Column, size: Column, least: int = 20, ratio: float = 0.1) -> Column:
    """Whether an extracted text is too thin for its file: few letters and digits, or few for its bytes."""
    n = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return (n < least) | (n < size * ratio)


def prose_like(text: Column) -> Column:
    """Enough words, mostly letters, of ordinary length, with sentence punctuation."""
    t = F.trim(text)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n = F.size(words)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    solid = F.greatest(F.length(F.regexp_replace(t, r"\s", "")), F.lit(1))
    plain = F.size(F.filter(words, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").rlike(r"^\p{L}+$")))
    marks = F.length(F.regexp_replace(t, r"[^.,?!]", "")) / F.greatest(F.length(t), F.lit(1))
    return F.when(n < 8, False).otherwise((letters / solid > 0.85) & (plain / n > 0.70) & (letters / n).between(3.0, 8.0) & (marks > 0.005))


# What tells code. Characters by their density; starts of a line; words before a space; parts of a line.
CODE_SYMBOLS = ";{}()[]=<>|"
CODE_STARTS = ("$ ", "#!", "> ", "% ")
CODE_WORDS = ("use", "import", "def", "fn", "class", "SELECT", "select", "impl")
CODE_PARTS = ("C:\\", "/usr/", "./", "0x")


def _any(values: tuple[str, ...]) -> str:
    return "(?:" + "|".join(map(re.escape, values)) + ")"


#: Further signs: flags, a key with its value, a line that goes on, frames of hexadecimal digits, addresses, paths of several segments.
_CODE_LINE = re.compile(
    "|".join((
        "^" + _any(CODE_STARTS), rf"(?:^|[ \t]){_any(CODE_WORDS)} ", _any(CODE_PARTS), r"(?:^|\s)(?:--[^\W\d_]|-[A-Za-z][A-Za-z0-9]*(?=\s|$))", r"^[\w-]{1,30}[:=]\s*\S", r"\\\s*$",
        r"^[0-9]+#\s*[0-9A-Fa-f]{2,}\s*$", r"(?:^|[^\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?=[^\w.]|$)", r"\S*/\S*/\S*",
    ))
)


def code_like(content: str) -> bool:
    """Indented lines, dense symbols, or any line that looks like a command, a path, an assignment, hex or an address."""
    lines = [x for x in content.splitlines() if x.strip()]
    if not lines:
        return False
    if len(lines) >= 2 and sum(x.startswith(("  ", "\t")) for x in lines) / len(lines) >= 0.4:
        return True
    symbols = sum(c in CODE_SYMBOLS for c in content)
    return symbols >= 3 and symbols / len(content) > 0.02 or any(_CODE_LINE.search(x.lstrip()) for x in lines)


def snippet(text: Column, cap: int) -> Column:
    """truncate_snippet() of a column: for the rows of a page, not for whole tables."""
    return F.udf(lambda x: None if x is None else truncate_snippet(x, cap)[0], "string", useArrow=True)(text)


def truncate_snippet(text: str, cap: int) -> tuple[str, bool]:
    """A prefix of about cap characters that ends at a paragraph, a sentence or a word, and whether text was cut.

    Paragraphs and sentences may end from cap / 2 to cap * 1.2; a word ends at cap at the latest; failing these it is a hard cut.
    The prefix is never empty for a text that isn't.
    """
    if len(text) <= cap:
        return text, False
    low, high = cap // 2, min(len(text), cap + cap // 5)
    low = min(low, high)
    cuts = [text.rfind("\n\n", low, high)]
    # A terminator counts if white space or the text's end follows it and an optional closer; what lies beyond the window is looked at, too.
    ends = [m.end() for m in re.finditer(r"[.!?][\"')\]）]?(?=\s|\Z)", text[low : high + 1]) if m.end() <= high - low]
    cuts.append(low + ends[-1] if ends else -1)
    cuts.append(max((m.start() for m in re.finditer(r"\s", text[: cap + 1])), default=-1))
    cut = next((c for c in cuts if c > 0), cap)
    kept = text[:cut].rstrip()
    return kept or text[:cut], True
