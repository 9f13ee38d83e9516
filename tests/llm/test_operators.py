"""Each operator against a plain-Python version, on a fixture of hard cases and on part of the small tables."""

import hashlib
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from loamline.llm import arrays, bpe, common, components, decontaminate, line_dedup, ngram_join, pii, quality, queries, suffix_dedup, suffixes, token_counts, toxicity, url_filter
from loamline.session import ship

SF = "/root/testdata/sf0.001"
#: Extra columns whose names operators use inside.
CLASH = ["row", "words", "score", "rid", "n", "digest", "ranges", "kept", "start", "size", "spans", "email", "id", "label", "word", "raw", "low", "token", "need", "clean"]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    ship(spark)
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    texts = [
        None, "", " \t\n", "x", "A b c", "a B\nc", base, base, base + " tail", base.replace("seven", "SEVEN"), base.replace("eight", "acht"), "The " * 400, "é" * 500, "日本 " * 50 + "😀",
        "mail a.b@c.de, +1 (017) 555-7713, 4111 1111 1111 1111 and 10.0.0.1; GB82 WEST 1234 5698 7654 32", "<|endoftext|> it's <|endoftext|>", "w" * 30_000, " ".join(f"k{i}" for i in range(20_000)),
        *(base + " " + base.upper() + f" v{i}" for i in range(5)), "line one has quite a few words in it for sure\nshort\n" + base + "\n" + base + "\n",
    ]
    rows = [(k, t, "en", "src0", len(t or "")) for k, t in enumerate(texts)] + [(6, base, "en", "src0", len(base)), (None, base, None, None, None), (None, None, None, None, None)]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return out.withColumns({c: F.lit("clash") for c in CLASH}).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(hard):
    return hard.filter("false")


@pytest.fixture(scope="module")
def small(spark):
    return ship(spark).read.parquet(f"{SF}/documents.parquet").cache()


def same(got, documents, want, columns):
    """Whether the rows agree with want(id, text) for each input row, repeats included."""
    a = sorted(repr((r["doc_id"], [r[c] for c in columns])) for r in got.collect())
    b = sorted(repr((r["doc_id"], list(want(r["doc_id"], r["text"])))) for r in documents.select("doc_id", "text").collect())
    assert a == b


def test_pii(hard, small, empty):
    columns = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    for docs in (hard, small):
        same(pii.digest(pii.find_pii(docs)), docs, lambda _, t: brute.pii(t), columns)
    assert pii.digest(pii.find_pii(empty)).count() == 0
    spans = pii.digest(pii.find_pii(hard)).filter("doc_id = 14").first()
    assert spans["spans"].split(",")[-1].startswith("iban:") and spans["n_iban"] == 1


def test_pii_context_and_checks(spark):
    rows = [(1, "call 555-123-4567"), (2, "nothing 555-123-4567"), (3, "GB82 WEST 1234 5698 7654 33"), (4, 'token = "0123456789abcdef0123"'), (5, "4111 1111 1111 1112"), (6, "999.1.1.1 1.2.3.4.5.6.7.8"), (7, "a@b.c_d@e.f")]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: "local_phone:5:17", 2: "", 3: "", 4: "secret:0:30", 5: "", 6: "ip:10:17,ip:18:25", 7: "email:0:5,email:5:11"}


def test_redaction(hard):
    got = pii.redact(hard, length_col="n_chars")
    assert got.columns == hard.columns and got.count() == hard.count()
    row = got.filter("doc_id = 14").first()
    assert row["text"] == "mail <email>, <phone>, <card> and <ip>; <iban>" and row["n_chars"] == len(row["text"]) and row["row"] == "clash"
    assert got.filter("doc_id is null and text is null").count() == 1
    same(got.filter("doc_id <> 14"), hard.filter("doc_id <> 14"), lambda _, t: [t], ["text"])


def test_quality(hard, small, empty):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for docs in (hard, small):
        same(quality.judge(docs), docs, lambda _, t: brute.quality(t), columns)
    assert quality.judge(empty).count() == 0 and quality.judge(small).filter("base_failed and kept").count() == 0


def test_quality_keeps_clean_documents(spark, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = quality.judge(small).join(labels, "doc_id").filter("not base_failed")
    assert got.filter("quality = 1 and not kept").count() == 0 and got.filter("quality = 0 and kept").count() <= 0.1 * got.filter("quality = 0").count()
    kept = quality.keep_good(small)
    assert kept.columns == small.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.judge(small).filter("kept").collect()}


def test_quality_order_doesnt_matter(small):
    rules = quality.default_rules()
    a, b = (sorted(map(tuple, quality.judge(small, rules=r).select("doc_id", "kept").collect())) for r in (rules, rules[::-1]))
    assert a == b


def test_quality_sample_is_drawn_over_the_whole_table(spark):
    docs = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("w "), F.col("id")).alias("text"))
    drawn = [int(r["text"][2:]) for r in quality.sample_texts(docs, "text", 200).select("text").collect()]
    assert 120 <= len(drawn) <= 200 and len({*drawn}) == len(drawn) and sum(x >= 2000 for x in drawn) >= 40
    assert quality.sample_texts(docs.filter("false"), "text").count() == 0
    assert quality.sample_texts(docs.limit(7).union(docs.limit(1).select(F.lit(None).cast("string"))), "text").count() == 7


def test_rules_are_ordered_by_rejection_per_cost(small):
    sample = quality.sample_texts(small, "text")
    often, never = quality.Rule("often", F.col("n_words") >= 0), quality.Rule("never", F.col("n_words") < 0)
    assert [r.name for r in quality.order_rules(sample, [never, often])] == ["often", "never"]
    assert quality.order_rules(sample.filter("false"), [never, often]) == [never, often]


def test_contamination(spark, hard, small, empty):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "A b C"), (3, ""), (4, None), (5, "k1 k2 k3"), (6, "one two three four five six seven eight nine ten eleven"), (7, "the THE the the the the the the the the"), (8, "ß absent")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    short = hard.filter("length(text) < 20000 or text is null")
    for blocks in (100_000, 3):
        got = decontaminate.digest(decontaminate.contamination(short, bench, block_windows=blocks))
        same(got, short, lambda _, t: brute.contamination(t, items), columns)
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(small, bench.filter("false")).filter("contaminated").count() == 0
    kept = decontaminate.keep_clean(short, bench)
    assert kept.columns == short.columns and kept.count() == decontaminate.contamination(short, bench).filter("not contaminated").count()


def test_contamination_on_tables(spark, small):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    docs = small.filter("doc_id < 60")
    same(decontaminate.digest(decontaminate.contamination(docs, bench)), docs, lambda _, t: brute.contamination(t, items), ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_ngram_join(hard, small, words, percent):
    for docs in (hard.filter("doc_id is not null and (length(text) < 20000 or text is null)"), small):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        want = brute.components(rows, words, percent)
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs, words, percent).collect())
        assert got == sorted((d, n, c) for (d, _), (n, c) in zip(rows, want, strict=True))


def test_ngram_join_chains(spark):
    """Neighbours in a chain are similar, its ends are not: all of it is one component."""
    rows = [(100 - k, " ".join(f"w{j}" for j in range(k, k + 60))) for k in range(0, 40, 2)] + [(k, f"only one of these {k}") for k in range(200, 205)]
    random.Random(5).shuffle(rows)
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs, 4, 85).collect()}
    want = brute.components(rows, 4, 85)
    assert got == {d: c for (d, _), (_, c) in zip(rows, want, strict=True)} and got[100] == 62


def test_ngram_join_edges(hard, empty):
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.near_duplicates(hard).count() == hard.count()
    kept = ngram_join.keep_one(hard)
    assert kept.columns == hard.columns and kept.filter("text is null").count() == 2 and kept.filter("doc_id = 7").count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(2, 41)}, **{k: 100 for k in range(101, 130)}, 201: 200}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"length": 60, "anchor": 20}, {"length": 60, "anchor": 20, "hot": 3}, {"length": 8, "anchor": 8}])
def test_suffix_dedup(hard, small, options):
    for docs in (hard.filter("length(text) < 5000 or text is null"), small.filter("doc_id < 80")):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        want = brute.repeats([t for _, t in rows], options.get("length", 400))
        got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, **options))
        a = sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got.collect())
        assert a == sorted(repr((d, *w)) for (d, _), w in zip(rows, want, strict=True))


def test_suffix_dedup_over_tiles(spark, monkeypatch, empty):
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(9000))
    docs = spark.createDataFrame([(1, text), (2, "q" + text[3000:3700]), (3, text[100:200])], "doc_id long, text string")
    want = brute.repeats([text, "q" + text[3000:3700], text[100:200]])
    monkeypatch.setattr(suffix_dedup, "TILE", 1000)
    rows = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect()}
    assert [rows[k] for k in (1, 2, 3)] == want and suffix_dedup.remove_repeats(empty).count() == 0


def test_deep_shallow_sort():
    rng = random.Random(3)
    for _ in range(800):
        alphabet = rng.choice([b"a", b"ab", b"abc"])
        some = lambda n: bytes(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
        base = some(30)
        strings = [base[: rng.randint(0, len(base))] + some(6) for _ in range(rng.randint(1, 12))]
        known = min(len(os.path.commonprefix(strings)), rng.randint(0, 20))
        order, lcp = suffixes.deep_shallow_sort(strings, known, rng.choice([0, 1, 3, 8]))
        assert [strings[k] for k in order] == sorted(strings)
        assert all(lcp[i] == suffixes.common_prefix(strings[order[i - 1]], strings[order[i]]) for i in range(1, len(order)))


def test_line_dedup(hard, small, empty):
    for docs in (hard.filter("doc_id is not null"), small):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = line_dedup.digest(line_dedup.remove_lines(docs))
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, brute.unit_dedup(rows)))
    assert line_dedup.remove_lines(empty).count() == 0 and line_dedup.remove_lines(hard).count() == hard.count()


def test_bpe(hard, small, empty):
    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(bpe.default_path())

    def want(_, text):
        ids = known.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    for docs in (hard, small):
        same(bpe.digest(docs), docs, want, ["n_tokens", "ids_sha256", "decoded_sha256"])
        same(bpe.decode(bpe.encode(docs)), docs, lambda _, t: [t or ""], ["text"])
    assert bpe.digest(empty).count() == 0


def test_bpe_classes_and_long_words():
    tokenizers = pytest.importorskip("tokenizers")
    known, own = tokenizers.Tokenizer.from_file(bpe.default_path()), bpe.codec(bpe.default_path())
    rng = random.Random(7)
    pool = [chr(c) for c in (*range(0x20, 0x250), 0x558, 0x10940, 0x323B0, 0x2003, 0x3000, 0x200B, 0x180E, 0x1C, 0x85, 0x660, 0x2160, 0x1F600)]
    for _ in range(400):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == known.encode(text, add_special_tokens=False).ids
    for text in ("a" * 3000, "ab" * 500, "é!" * 600, "the" * 400):
        ids = [own.first[b] for b in text.encode()]
        assert own.merge(ids[:]) == own.merge_long(ids[:]) and np.frombuffer(own.encode(text), "<u4").tolist() == known.encode(text, add_special_tokens=False).ids


def test_token_counts(hard, small, empty):
    own = bpe.codec(bpe.default_path())
    for docs, block in ((hard, 64), (small, 1 << 17), (small, 500)):
        same(token_counts.token_counts(docs, block_tokens=block), docs, lambda _, t: [len(own.encode_ordinary(t or "")) // 4], ["n_tokens"])
    assert token_counts.token_counts(empty).count() == 0


def test_token_counts_against_the_library(spark, hard):
    """Counts by the tokenizers library; rows that are dealt anew at each evaluation are still counted once."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    library.encode_special_tokens = True
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    want = sorted(repr((k, len(library.encode(t or "", add_special_tokens=False).ids))) for k, t in rows)
    dealt = hard.withColumn("__r", F.rand()).repartition(4, "__r").drop("__r")
    got = token_counts.token_counts(dealt, block_tokens=64)
    assert sorted(repr((r["doc_id"], r["n_tokens"])) for r in got.collect()) == want
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_odd_token_files(spark, tmp_path):
    (tmp_path / "odd").write_bytes(b"abc")
    with pytest.raises(Exception, match="odd number of bytes"):
        token_counts.scan(token_counts.read_token_files(ship(spark), str(tmp_path)), 0).collect()


def test_flat_token_files(spark, tmp_path):
    streams = {"a": [5, 6, 9, 9, 7, 9, 1], "b": [9], "c": [], "d": [1] * 10 + [9]}
    for name, ids in streams.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    for block in (1, 2, 3, 100):
        rows = token_counts.scan(token_counts.read_token_files(spark, str(tmp_path), block), 9, block).orderBy("file", "block", "place").collect()
        got = {}
        for r in rows:
            got.setdefault(r["file"][-1], []).append(r["n_tokens"])
        assert got == {"a": [2, 0, 1], "b": [0], "d": [10]}


def test_toxicity(spark, hard, small, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = toxicity.fit(big, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    assert 0 < len(model[0]) < 20_000
    rows = toxicity.score(big, model).join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    insult = toxicity.score(spark.createDataFrame([(1, "you idiot and pathetic moron"), (2, "a calm and plain remark")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert insult[0]["predicted"] == 1 and insult[1]["predicted"] == 0
    clean, toxic = [r for r in rows if not r["toxic"]], [r for r in rows if r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean) and sum(r["predicted"] for r in toxic) >= 0.5 * len(toxic)
    got = toxicity.score(hard, model).collect()
    assert len(got) == hard.count() and all(0 <= r["score"] <= 1 for r in got) and toxicity.score(empty, model).count() == 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    none = toxicity.fit(small, labels.filter("false"))
    assert {round(r["score"], 6) for r in toxicity.score(small, none).collect()} == {0.0}


def test_toxicity_learns_from_no_held_out_label(spark, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(small, labels), toxicity.fit(small, turned)
    assert a[2] == b[2] and (a[0] == b[0]).all() and (a[1] == b[1]).all()


def url_rule(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    end = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    end = min([k for k in map(rest.find, "?#") if k >= 0], default=len(rest))
    path = rest[:end]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG", "http://a.example.org/", "http://example.org/es/x?y#z", "http://m.example.org/en/12", "http://x.com/fr/", "http://x.com/de/a", "http://notexample.org/es/", "http://com/de/", "http://casinowin.example.net/en/1", "http://a?b/c://d", "ftp://u@h:80/p", "http://spamfarm.net/x", "http://www.plainnews.net/en/2", "http://x.com\n/de/q"]
    pages = spark.createDataFrame([(k, u, "<title>a win for the farm news</title>" if k % 2 else None) for k, u in enumerate(urls)] + [(0, None, None)], "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "word", "n")})
    rows = url_filter.judge(pages).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, path, rule, ruled = url_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (ruled or r["verdict"]) and r["verdict"] in ("allow", "block")
    verdict = {urls[r["page_id"]]: r["verdict"] for r in rows}
    assert verdict["http://casinowin.example.net/en/1"] == "block" and verdict["http://spamfarm.net/x"] == "block" and verdict["http://www.plainnews.net/en/2"] == "allow" and verdict[None] == "allow"
    assert url_filter.judge(pages.filter("false")).count() == 0


def test_segmenter():
    model = url_filter.Segmenter({"casino": 50, "win": 50, "cas": 1, "spam": 20, "farm": 20})
    assert model.split("casinowin") == ("casino", "win") and model.split("spamfarm") == ("spam", "farm") and model.split("zzq") == ("zzq",) and model.split("") == ()


def test_blocked_hosts_on_tables(spark):
    rows = url_filter.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).filter("rule is null").collect()
    bad = [r for r in rows if any(w in r["host"] for w in ("casino", "adult", "spam", "bets", "pills"))]
    assert bad and all(r["verdict"] == "block" for r in bad) and all(r["verdict"] == "allow" for r in rows if r not in bad)


def test_bloom(spark):
    present = [random.Random(k).getrandbits(63) for k in range(500)]
    found = common.bloom(spark.createDataFrame([(x,) for x in present], "x long"))
    probe = np.array(present, np.uint64)
    assert arrays.in_bloom(found.value, probe).all() and not arrays.in_bloom(found.value, arrays.mix(probe)).any()


def test_queries_agree_with_their_sql(spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    for name, sql in queries.oracle_sql().items():
        frame = queries.queries()[name](spark, SF)
        columns = sorted(frame.columns)
        found = con.execute(sql)
        at = [[d[0] for d in found.description].index(c) for c in columns]
        assert sorted(repr([r[c] for c in columns]) for r in frame.collect()) == sorted(repr([r[k] for k in at]) for r in found.fetchall()), name


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]


def test_passages_inside_lines(spark):
    """Fifty words that two texts share are found wherever they begin, by op9, upper case and line breaks or not, and by op4 where the bytes are equal; texts without any are left alone."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, shared = [], 60
    for k in range(shared):
        body = words(50)
        rows += [(2 * k, " ".join(words(rng.randrange(90)) + body + words(rng.randrange(90)))), (2 * k + 1, " ".join(words(rng.randrange(90))) + " " + "\n".join(body).upper() + " " + " ".join(words(rng.randrange(90))))]
    rows += [(1000 + k, " ".join(words(120))) for k in range(40)] + [(2000 + k, f"x{k} {rows[0][1]}") for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = {r["doc_id"]: r for r in line_dedup.digest(line_dedup.remove_lines(docs)).collect()}
    bytes_ = {r["doc_id"]: r for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs), "n_repeated").collect()}
    for k in range(shared):
        assert lines[2 * k]["n_passages"] and lines[2 * k + 1]["n_passages"] and not lines[2 * k]["n_removed"] and lines[2 * k + 1]["n_removed"]
    assert all(bytes_[k]["n_repeated"] for k in (0, 2000, 2001))
    assert not any(lines[k]["n_passages"] or bytes_[k]["n_repeated"] or x[k]["n_removed"] for x in (lines, bytes_) for k in range(1000, 1040))


def test_suffix_dedup_counts_shorter_strings(hard, small):
    for docs in (hard.filter("length(text) < 5000 or text is null"), small.filter("doc_id < 80")):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs), "n_repeated")
        want = [x[1] for x in brute.repeats([t for _, t in rows], suffix_dedup.SHORT)]
        assert sorted(repr((r["doc_id"], r["n_repeated"])) for r in got.collect()) == sorted(repr((d, w)) for (d, _), w in zip(rows, want, strict=True))
        assert "n_repeated" not in suffix_dedup.remove_repeats(docs, short=None).columns


def test_bloom_sizes(spark):
    for n in (0, 1, 50_000, 400_000):
        held = common.bloom(spark.range(n).selectExpr("xxhash64(id) as x")).value
        inside = spark.range(n).selectExpr("xxhash64(id) as x").toPandas()["x"].to_numpy().view(np.uint64)
        others = spark.range(1_000_000, 1_020_000).selectExpr("xxhash64(id) as x").toPandas()["x"].to_numpy().view(np.uint64)
        assert arrays.in_bloom(held, inside).all() and arrays.in_bloom(held, others).mean() < 0.05 and len(held) * 64 >= 16 * n


def test_shared_folder_is_asked_for():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_keep_one_tells_rows_apart(spark):
    """Shared ids, null ids, repeated rows and clashing names lose no row that is like nothing else."""
    body = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(1, body), (5, body + " x"), (5, other), (7, body + " y"), (7, body + " z"), (None, body), (None, "alone here with a null id"), (8, other), (8, other), (9, None), (10, ""), (3, "short")]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, __row string, __id string")
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(1, body), (5, other), (None, "alone here with a null id"), (9, None), (10, ""), (3, "short")], key=repr)
    assert ngram_join.keep_one(docs).columns == docs.columns and ngram_join.keep_one(docs.filter("false")).count() == 0
    assert ngram_join.keep_one(docs.filter("doc_id = 8")).count() == 1


def test_keep_clean_with_clashing_names(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "a one two three four five six seven eight nine ten b", "x"), (None, "clean", "x"), (4, None, "x")], "doc_id long, text string, __row string")
    assert sorted(map(repr, decontaminate.keep_clean(docs, items).select("doc_id", "text").collect())) == sorted(map(repr, docs.filter("text = 'clean' or text is null").select("doc_id", "text").collect()))


def test_scan_of_two_levels(spark, monkeypatch):
    """Flat token files built here, without the operator's encoder; spans of three blocks, and documents longer than a span."""
    monkeypatch.setattr(token_counts, "SPAN", 3)
    rng, want, rows = random.Random(4), {}, []
    for file in ("a", "b", None):
        counts = [rng.choice([0, 1, 3, 17, 90]) for _ in range(40)]
        ids = [x for n in counts for x in [*(rng.randrange(1, 60_000) for _ in range(n)), 0]] + [5, 6]
        want[file] = counts
        raw = np.array(ids, "<u2").tobytes()
        rows += [(file, k, raw[16 * k : 16 * k + 16]) for k in range(-(-len(raw) // 16))]
    found = token_counts.scan(spark.createDataFrame(rows, "file string, block int, tokens binary").repartition(5), 0, 8).collect()
    for file, counts in want.items():
        assert [r["n_tokens"] for r in sorted((r for r in found if r["file"] == file), key=lambda r: (r["block"], r["place"]))] == counts


def test_token_ids_beyond_16_bits():
    assert token_counts.flat(np.array([1, 65_535])) == b"\x01\x00\xff\xff"
    with pytest.raises(ValueError, match="65536"):
        token_counts.flat(np.array([65_536]))


def test_ftrl_against_a_plain_version():
    """Per-coordinate rates and L1, one number at a time."""
    rng = random.Random(2)
    examples = [(np.unique(rng.sample(range(300), rng.randint(1, 20))), rng.randint(0, 1)) for _ in range(200)]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.2, 1.0
    z, n, bias = [0.0] * 301, [0.0] * 301, 300

    def weight(i):
        if abs(z[i]) <= l1 and i != bias:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1 if z[i] < 0 else 0.0)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(2):
        for at, label in examples:
            x = {int(i): toxicity.SCALE / (len(at) + 1) ** 0.5 for i in at} | {bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - label) * x[i]
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    at, w, b = toxicity.ftrl(examples, 2, alpha, beta, l1, l2)
    want = {i: weight(i) for i in range(300) if weight(i)}
    assert {*map(int, at)} == {*want} and all(abs(want[int(i)] - v) < 1e-9 for i, v in zip(at, w, strict=True)) and abs(b - weight(bias)) < 1e-9
