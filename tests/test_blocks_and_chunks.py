"""Markdown blocks, heading paths and chunkers."""

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from loamline.operators import blocks, chunking, extract

MD = """---
title: T
---
# A

One.

Two ![pic](x.png) three.

```py
x = 1

y = 2
```

## B

| a | b |
|---|---|
| 1 | x\\|y |

***
last
"""


def test_blocks():
    got = [(b["kind"], b["level"], b["text"]) for b in blocks.to_blocks(MD)]
    assert got == [
        ("frontmatter", None, "title: T"), ("heading", 1, "A"), ("text", None, "One."), ("image", None, "pic"), ("text", None, "Two  three."), ("code", None, "x = 1\n\ny = 2"),
        ("heading", 2, "B"), ("table", None, "| a | b |\n| --- | --- |\n| 1 | x\\|y |"), ("text", None, "last"),
    ]
    assert blocks.to_blocks("") == [] and [b["page"] for b in blocks.to_blocks("a\n\n# b", [(0, 1), (3, 2)])] == [1, 2]


def test_front_matter():
    assert blocks.split_front_matter("---\r\na: 1\r\n---\r\nx") == ("a: 1", "x")
    assert blocks.split_front_matter("---\na: 1\n---") == ("a: 1", "") and blocks.split_front_matter("x\n---\n---") == (None, "x\n---\n---")


def test_heading_index():
    index = blocks.HeadingIndex("# A\n## B\n# C\n### D\nx")
    assert index.path(0) == ["A"] and index.path(5) == ["A", "B"] and index.path(9) == ["C"] and index.path(100) == ["C", "D"] and blocks.HeadingIndex("x").path(0) == []


def test_heading_paths_keep_gaps(spark):
    rows = [("u", 0, "heading", 1, "A"), ("u", 1, "heading", 3, "C"), ("u", 2, "text", None, "t"), ("u", 3, "heading", 1, "D"), ("u", 4, "text", None, "t")]
    got = blocks.heading_paths(spark.createDataFrame(rows, "uri string, seq int, kind string, level int, text string")).orderBy("seq").collect()
    assert [r["heading_path"] for r in got] == [[], ["A"], ["A", "", "C"], ["A", "", "C"], ["D"]]


def test_windows():
    assert chunking.window_turns(["x"] * 10, 6, 3, 999) == [(0, 6), (3, 9), (6, 10), (9, 10)]
    assert len(chunking.window_turns(["x"] * 6, 4, 2, 999)) == 3
    assert chunking.window_turns(["x" * 10] * 4, 3, 1, 22) == [(0, 2), (2, 4), (3, 4)]
    assert chunking.message_prefix("Alice", "2026-01-01T10:00:00Z") + "Hello!" == "[Alice] (2026-01-01T10:00:00Z): Hello!"
    assert chunking.segment_prefix("Speaker", 0, 1999) == "[Speaker] (0-1999): " and chunking.segment_prefix(None, 0, 9) == "(0-9): "


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=12), st.integers(1, 5), st.integers(1, 5))
def test_every_turn_is_in_a_window(sizes, window, stride):
    spans = chunking.window_turns(["x" * n for n in sizes], window, min(stride, window), 40)
    assert {k for a, b in spans for k in range(a, b)} == set(range(len(sizes)))


def test_tables():
    head = "| a | b |\n|---|---|"
    assert chunking.split_table(head, 40) == [(head, 0, len(head))]
    text = head + "\n" + "\n".join(f"| {k} | {k} |" for k in range(5))
    pieces = chunking.split_table(text, 39)
    assert [p.count("\n") - 1 for p, _, _ in pieces] == [2, 2, 1] and all(p.startswith(head) for p, _, _ in pieces)
    long = head + "\n| " + "x" * 1000 + " | y |"
    pieces = chunking.split_table(long, 40)
    assert len(pieces) > 1 and all(long[a:b] == p for p, a, b in pieces)
    assert chunking.split_table("no | table", 40) == [("no | table", 0, 10)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(5, 50))
def test_spans_are_exact_and_cover(text, target):
    prose = chunking.split_prose(text, target)
    assert all(b - a <= target and text[a:b] == text[a:b].strip() for a, b in prose)
    assert "".join("".join(text[a:b].split()) for a, b in prose) == "".join(text.split())
    code = chunking.split_code(text, target)
    assert "".join(text[a:b] for a, b in code) == text and all(len(text[a:b]) <= target for a, b in code)


def test_chunks_of_a_document(spark):
    rows = [("u", 0, "heading", "A"), ("u", 1, "text", "word " * 600), ("u", 2, "image", ""), ("u", 3, "frontmatter", "k: v"), ("v", 0, "code", "x\n" * 10)]
    got = chunking.chunk_blocks(spark.createDataFrame(rows, "uri string, seq int, kind string, text string")).collect()
    assert {(r["resource_id"], r["block_seq"]) for r in got} == {("u", 0), ("u", 1), ("u", 3), ("v", 0)} and len({r["chunk_id"] for r in got}) == len(got)
    assert all(len(r["text"]) <= 1024 for r in got)


def test_message_chunks_come_first():
    turns = [{"seq": 0, "kind": "text", "text": "t"}, *({"seq": k, "kind": "message", "text": "m", "sender": "s"} for k in (1, 2))]
    got = chunking.chunk_document("r", turns)
    assert [c["block_seq"] for c in got] == [1, 0] and got[0]["window_block_seqs"] == [1, 2] and got[0]["text"] == "[s]: m\n\n[s]: m"


def test_html_to_markdown():
    html = "<html><head><title> T  x </title></head><body><nav>no</nav><header><h1>Head</h1></header><article><h2>A</h2><p>One <b>two</b> <a href='u'>l</a></p><ul><li>a<li>b</ul></article><article>second</article><footer>no</footer></body></html>"
    markdown, title = extract.html_to_markdown(html)
    assert title == "T x" and markdown.startswith("# Head") and "## A" in markdown and "One **two** [l](u)" in markdown and "second" in markdown and "no" not in markdown
    assert extract.html_to_markdown("<main>m</main>x")[0] == "m" and extract.html_to_markdown("<div role='main'>r</div>x")[0] == "r" and extract.html_to_markdown("<p>x")[0] == "x"


def test_parser_chain():
    one = lambda n, b: extract.parse_one(n, b)[1:5]
    assert one("a.md", b"# T\r\nx") == ("ok", None, "markdown", "# T\nx") and one("a.bin", b"\0") == ("unsupported", "no parser takes it", None, None)
    assert one("a.pdf", b"%PDF-1.4")[0] == "unsupported" and one("a.epub", b"junk")[0] == "error" and one("a.txt", b"  ")[0] == "empty"
    assert one("x", b" <p>hi</p>")[3] == "hi" and one("a.csv", b"a,b\n1,2")[3] == "| a | b |\n| --- | --- |\n| 1 | 2 |" and one("Cargo.lock", b"x")[2] == "plaintext" and one("a.md", b"\xff")[0] == "unsupported"


def test_markdown_clean_up():
    assert extract.demote_headings("# Real Title\n# lower start\n```\n# in fence\n```\n## Ends with the") == "# Real Title\nlower start\n```\n# in fence\n```\nEnds with the"
    prose = "The quick brown fox jumps over the lazy dog, and then it rests."
    assert extract.demote_fences(f"```\n{prose}\n```") == prose and extract.demote_fences("```\nx = 1\n```") == "```\nx = 1\n```"
    assert extract.pdf_string(b"\xfe\xff\x00A") == "A" and extract.pdf_string(b"caf\xe9") == "café"


def test_office_and_epub():
    import io
    import zipfile

    def archive(parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, v in parts.items():
                z.writestr(k, v)
        return out.getvalue()

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = archive({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>'})
    assert extract.parse_one("a.docx", docx)[4:6] == ("# Title\n\nBody", "Title")
    epub = archive({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>', "o/p.opf": '<package><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Book</dc:title></metadata><manifest><item id="b" href="2.html"/><item id="a" href="1.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>', "o/1.html": "<p>one</p>", "o/2.html": "<p>two</p>"})
    assert extract.parse_one("a.epub", epub)[4:] == ("one\n\ntwo", "Book", {"dc.title": "Book"})


def test_headings_that_stay_and_go():
    stay = ["Note:", "Appendix A", "Anesthesia in the OR", "iOS Basics", "von Neumann Architecture", "pH", "J. R. Smith and Sons", "The Sum. A Part", "[Draft] Chapter Three", "US$ 2 Trillion", "What Are We Here For", "日本"]
    go = ["ends with a mark,", "Ends with a dash -", "Ends with a dash —", "Opens (", "Reasons to", "lower start here", "$ ls -la", "> quoted", "[*] Started the handler", "C:\\Windows", "#!/bin/sh", "One thing. Two things. Three things", "x" * 201]
    assert [x for x in stay if extract.spurious_heading(x)] == [] and [x for x in go if not extract.spurious_heading(x)] == []


def test_every_article_is_main_content(spark):
    html = "<body><header> Top </header><article>one</article><div>ad</div><article id='x'>two</article></body>"
    rows = spark.createDataFrame([(html,), ("<body><main>m</main></body>",), ("<p>bare</p>",)], "html string")
    assert [r[0] for r in rows.select(extract.html_text("html")).collect()] == ["Top onetwo", "m", "bare"]


def test_nested_elements_are_kept_whole(spark):
    """Against html.parser: nested and several articles, unclosed and stray tags, a blank first header."""
    from html.parser import HTMLParser

    class Inner(HTMLParser):
        def __init__(self, html, tag):
            super().__init__(convert_charrefs=False)
            self.html, self.tag, self.open, self.found = html, tag, [], []
            self.lines = [0]
            for line in html.split("\n"):
                self.lines.append(self.lines[-1] + len(line) + 1)
            self.feed(html)
            self.close()
            for k, start in self.open:
                self.found.append((k, html[start:]))

        def at(self):
            row, column = self.getpos()
            return self.lines[row - 1] + column

        def handle_starttag(self, tag, attrs):
            if tag == self.tag:
                self.open.append((self.at(), self.at() + len(self.get_starttag_text())))

        def handle_endtag(self, tag):
            if tag == self.tag and self.open:
                k, start = self.open.pop()
                self.found.append((k, self.html[start : self.at()]))

    pages = [
        "<article>A <article>B</article> C</article>",
        "<body><ARTICLE class='x'>one\n<p>two</p></ARTICLE><div></div><article>three<article><article>four</article></article>five</article></body>",
        "</article>stray<article>open <article>closed</article> to the end",
        "<articles>no</articles><article/ >yes</article>",
        "none at all", "",
    ]
    rows = spark.createDataFrame([(p,) for p in pages], "html string")
    got = [r[0] for r in rows.select(extract.inner_markup(F.col("html"), "article")).collect()]
    assert got == [[x for _, x in sorted(Inner(p, "article").found)] for p in pages]
    assert [len(x) for x in got] == [2, 4, 2, 1, 0, 0]
    heads = spark.createDataFrame([("<header> </header><header>second</header><article>x</article>",), ("<header>first</header><article>x</article>",), ("<main>a<main>b</main>c</main>",)], "html string")
    assert [r[0] for r in heads.select(extract.html_main(F.col("html"))).collect()] == ["x", "firstx", "a<main>b</main>c"]
