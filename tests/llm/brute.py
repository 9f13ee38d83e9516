"""Plain-Python versions that the operators are held against."""

import hashlib
import re
from collections import Counter, defaultdict

BLANK = "[^\x20\x09-\x0d]+"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    text = text or ""
    count = lambda s: len(re.sub("[^0-9]", "", s))
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= count(s) <= 19 and luhn(re.sub("[^0-9]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= count(s) <= 15),
    ]
    spans = [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m.group())]
    n = Counter(k for k, _, _ in spans)
    return [n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))]


def quality(text):
    text = text or ""
    words = re.findall(BLANK, text)
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    hit = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    n = len(words)
    return [n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n]


def contamination(text, items):
    lower = lambda s: s.translate({c: c + 32 for c in range(65, 91)})
    cut = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s or ""))
    words = cut(text)
    hit, found = set(), set()
    for item, t in items:
        w = cut(t)
        size = min(10, len(w))
        for k in range(len(w) - size + 1) if w else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == w[k : k + size]:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
    return [len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)]


def shingles(text, n):
    words = re.findall(BLANK, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def components(docs, n=4, percent=85):
    """{row number: (set size, smallest id reachable)} for [(doc_id, text)]."""
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    best = {}
    for k, (doc, _) in enumerate(docs):
        best[find(k)] = min(best.get(find(k), doc), doc)
    return [(len(sets[k]), best[find(k)]) for k in range(len(docs))]


def repeats(texts, length=400):
    """For each text: bytes, bytes removed, spans, digest of what stays."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def passages(text, words=25, group=26):
    """(first byte, byte after the last, words) of each passage: of each group windows the one of least key, the first of equals."""
    raw = (text or "").encode()
    found = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]  # bytes.lower() is A-Z only
    key = [int(hashlib.md5(w).hexdigest()[:8], 16) for _, _, w in found]
    starts = range(len(found) - words + 1)
    rank = [(key[i] + 3 * key[i + 1], i) for i in starts]
    chosen = {min(rank[g : g + group])[1] for g in range(max(1, len(rank) - group + 1))} if rank else ()
    return [(found[i][0], found[i + words - 1][1], tuple(w for _, _, w in found[i : i + words])) for i in sorted(chosen)]


def units(text, min_words=10):
    """(first byte, byte after the last, kind and words) of each line of enough words and of each passage."""
    out, at, lines = [], 0, (text or "").encode().split(b"\n")
    for k, line in enumerate(lines):
        stop = at + len(line) + (k + 1 < len(lines))
        words = tuple(re.findall(rb"[^\x20\x09-\x0d]+", line.lower()))
        if len(words) >= min_words:
            out.append((at, stop, ("line", words)))
        at = stop
    return out + [(a, b, ("passage", w)) for a, b, w in passages(text)]


def unit_dedup(rows):
    """For each (id, text): id, bytes, bytes removed, spans, digest of what stays, the spans and how many passages occur elsewhere."""
    first, places = {}, defaultdict(set)
    for key, text in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        for a, _, name in sorted(units(text)):
            first.setdefault(name, (key, text, a))
            places[name].add((key, text, a))
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        own = units(text)
        for a, b, name in own:
            if first[name] != (key, text, a):
                gone[a:b] = b"\1" * (b - a)
        edges = [k for k in range(len(raw) + 1) if (k < len(raw) and gone[k]) != (k > 0 and bool(gone[k - 1]))]
        spans = ",".join(f"{a}:{b}" for a, b in zip(edges[::2], edges[1::2], strict=True))
        shared = sum(1 for _, _, name in own if name[0] == "passage" and len(places[name]) > 1)
        out.append((key, len(raw), sum(gone), len(edges) // 2, sha(bytes(c for c, g in zip(raw, gone, strict=True) if not g)), spans, shared))
    return out
