"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

Native: Catalyst expressions only, one narrow pass, no shuffle. The four base kinds follow their
patterns and checks alone. The further kinds (iban, ssn, local_phone, secret) are kept when
``score = prior + bonus`` reaches the threshold, where the bonus is for a context word within
``CONTEXT_CHARS`` code points before the span; an IBAN must also satisfy mod 97.

Defined results: a null or empty text has no spans. Offsets count code points. Patterns use
possessive repeats and look-behinds so that scanning is linear and iterative however long a text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import let

CONTEXT_CHARS = 40
THRESHOLD = 0.6

# The patterns of the base kinds, in the order in which spans are listed.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"(?:0*+(?:[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])|0++)"
OCTETS = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
BASE_KINDS = ("email", "ip", "card", "phone")

# The further kinds as (pattern, prior, context words).
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
EXTRA = {
    "iban": (IBAN, 0.7, r"iban|account|konto|compte|cuenta|bank"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, r"ssn|social security|sozialversicherung|social"),
    "local_phone": (r"(?<![0-9+().-])(?<!\+[0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", 0.4, r"phone|tel|call|fax|mobile|cell|mobil"),
    "secret": (r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\x20{0,3}[=:]\x20{0,3}[\"'][A-Za-z0-9+/_-]{16,128}[\"']", 0.8, r"key|login|auth"),
}
CONTEXT_BONUS = 0.2
SPAN = "array<struct<start:int,end:int,hit:string,near:string>>"
#: Matches that one fold appends; a text's matches are folded in blocks of so many, as appending copies what is there.
FOLD = 128


def _blocks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / FOLD).cast("int") - 1, F.lit(0))), lambda b: F.slice(items, b * FOLD + 1, F.lit(FOLD)))


def _last(text: Column) -> Column:
    return F.substring(text, -CONTEXT_CHARS, CONTEXT_CHARS)


def locate(text: Column, pattern: str, check=None) -> Column:
    """array<struct<start,end,hit,near>> of the pattern's leftmost non-overlapping matches whose hit passes the check, by code points; near is what stands just before.

    Splitting at the pattern gives what lies between the matches, so running lengths give offsets. Blocks of matches are
    summed up first, so that the work is linear in the text however many matches it has.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    hit = lambda x: F.coalesce(x["hit"], F.lit(""))

    def move(acc, x):
        return F.struct((acc["at"] + F.length(x["gap"]) + F.length(hit(x))).alias("at"), _last(F.concat(acc["tail"], x["gap"], hit(x))).alias("tail"))

    def fold(block):
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), move)

    def onwards(acc, x):
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.struct((last["at"] + x["at"]).alias("at"), _last(F.concat(last["tail"], x["tail"])).alias("tail"))))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        span = F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"), _last(F.concat(acc["tail"], x["gap"])).alias("near"))
        good = x["hit"].isNotNull() if check is None else x["hit"].isNotNull() & F.coalesce(check(x["hit"]), F.lit(False))
        after = move(acc, x)
        return F.struct(after["at"].alias("at"), after["tail"].alias("tail"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def spans(blocks):
        opening = F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")))
        openings = F.aggregate(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), fold), opening, onwards)
        none = F.array().cast(SPAN)
        inside = lambda o: F.transform(blocks, lambda block, k: F.aggregate(block, F.struct(F.get(o, k)["at"].alias("at"), F.get(o, k)["tail"].alias("tail"), none.alias("out")), step, lambda acc: acc["out"]))
        return F.flatten(let(openings, inside))

    return F.when(text.rlike(pattern), let(pairs, lambda x: let(_blocks(x), spans))).otherwise(F.array().cast(SPAN))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _mod97(hit: Column) -> Column:
    """ISO 7064 mod 97-10: the first four characters go last, letters count from 10."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")

    def step(acc, c):
        code = F.ascii(c)
        return F.when((code >= 48) & (code <= 57), (acc * 10 + code - 48) % 97).when((code >= 65) & (code <= 90), (acc * 100 + code - 55) % 97).otherwise(acc)

    return F.aggregate(chars, F.lit(0), step) == 1


def _scored(spans: Column, prior: float, words: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["hit"], F.least(F.lit(1.0), F.lit(prior) + F.when(F.lower(s["near"]).rlike(words), CONTEXT_BONUS).otherwise(0.0)).alias("score")))


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, text and, per kind, array<struct<start,end,hit,score>>.

    Other columns of the input are dropped, so clashing names do no harm. Repeated rows stay repeated.
    """
    base = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    checks = {
        "email": (EMAIL, None, 0.9, r"mail|contact|write"),
        "ip": (IP, lambda hit: hit.rlike(OCTETS), 0.8, r"\bip\b|host|server|addr"),
        "card": (CARD, lambda hit: let(_digits(hit), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d)), 0.8, r"card|visa|pay|credit"),
        "phone": (PHONE, lambda hit: F.length(_digits(hit)).between(8, 15), 0.8, EXTRA["local_phone"][2]),
    }
    columns = []
    for kind, (pattern, check, prior, words) in checks.items():
        columns.append(_scored(locate(text, pattern, check), prior, words).alias(kind))
    for kind, (pattern, prior, words) in EXTRA.items():
        spans = locate(text, pattern, _mod97 if kind == "iban" else None)
        columns.append(F.filter(_scored(spans, prior, words), lambda s: s["score"] >= threshold - 1e-9).alias(kind))
    return base.select("doc_id", "text", *columns)


def digest(found: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and the list of all spans."""
    told = lambda kind: F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(F.array_join(F.concat(*map(told, BASE_KINDS)), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*map(told, (*BASE_KINDS, *EXTRA))), ",").alias("spans"),
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in EXTRA),
    )


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, length_col: str | None = None) -> DataFrame:
    """The input's columns with every found span of the text replaced by its kind in angle brackets; length_col, if given, gets the new length.

    Overlapping spans are merged first; the kind that starts first names them. A null text stays null.
    """
    kinds = (*BASE_KINDS, *EXTRA)
    # The spans are computed beside the row itself, so that no join is needed.
    carried = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    spans = find_pii(carried.select(F.col("row").alias("doc_id"), F.col("row").getField(text_col).alias("text")), "doc_id", "text", threshold)
    named = lambda kind: F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    every = F.array_sort(F.concat(*map(named, kinds)))
    spans = spans.select("doc_id", "text", every.alias("spans"))

    # What has been gone past is the greatest end so far. A block's spans lie in one piece of the text, whose own pieces are short ways off.
    def pieces(block, at):
        piece = F.substring(F.col("text"), at + 1, F.element_at(block, -1)["start"] - at)

        def step(acc, s):
            parts = F.array(F.substring(acc["piece"], acc["at"] - at + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))
            after = F.greatest(acc["at"], s["end"]).alias("at")
            return F.struct(after, F.when(s["start"] < acc["at"], acc["parts"]).otherwise(F.concat(acc["parts"], parts)).alias("parts"), acc["piece"].alias("piece"))

        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast("array<string>").alias("parts"), piece.alias("piece")), step, lambda acc: F.array_join(acc["parts"], ""))

    def rebuilt(blocks):
        ends = F.transform(blocks, lambda block: F.array_max(F.transform(block, lambda s: s["end"])))
        past = F.aggregate(ends, F.array(F.lit(0)), lambda acc, end: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), end))))
        whole = lambda x: F.concat(F.array_join(F.transform(blocks, lambda block, k: pieces(block, F.get(x, k))), ""), F.substring(F.col("text"), F.element_at(x, -1) + 1, F.length("text")))
        return let(past, whole)

    cleaned = let(_blocks(F.col("spans")), rebuilt)
    out = spans.select(F.col("doc_id").alias("row"), F.when(F.size("spans") > 0, cleaned).otherwise(F.col("doc_id").getField(text_col)).alias("clean"))

    def column(name: str) -> Column:
        own = F.col("row").getField(name)
        if name == length_col:
            return F.when(F.col("clean").isNotNull(), F.length("clean").cast(documents.schema[name].dataType)).otherwise(own)
        return F.col("clean") if name == text_col else own

    return out.select(*(column(c).alias(c) for c in documents.columns))
