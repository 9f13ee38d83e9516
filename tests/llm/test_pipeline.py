"""The pipeline stage by stage against plain Python."""

import hashlib

import numpy as np
import pytest

import brute
import corpus_pipeline
from loamline.llm import bpe, common, pii, quality
from loamline.session import ship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = ship(spark).read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_stages_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "BPE encoding and decoding"]


def test_quality_stage(stages):
    kept = {r["doc_id"] for r in quality.judge(stages[0]).filter("kept").collect()}
    assert texts(stages[1]) == {k: t for k, t in texts(stages[0]).items() if k in kept}
    assert not any(brute.quality(t)[-1] for t in texts(stages[1]).values())


def test_near_duplicate_stage(stages):
    rows = list(texts(stages[1]).items())
    want = {c for _, c in brute.components(rows, 5, 80)}
    assert texts(stages[2]) == {k: t for k, t in rows if k in want}


def test_decontamination_stage(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert texts(stages[3]) == {k: t for k, t in texts(stages[2]).items() if not brute.contamination(t, items)[-1]}


def test_personal_data_stage(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert before.keys() == after.keys()
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_pii(stages[3])).collect()}
    for k, text in before.items():
        out, at = "", 0
        for a, b, kind in sorted((int(a), int(b), kind) for kind, a, b in (x.split(":") for x in spans[k].split(",") if x)):
            if a >= at:
                out += text[at:a] + f"<{kind}>"
            at = max(at, b)
        assert after[k] == out + text[at:]
    assert pii.digest(pii.find_pii(stages[4])).filter("spans <> ''").count() == 0


def test_encoding_stage(stages):
    own = bpe.codec(bpe.default_path())
    after = texts(stages[4])
    for r in stages[5].collect():
        ids = own.encode(after[r["doc_id"]])
        assert r["n_tokens"] == len(np.frombuffer(ids, "<u4")) and r["ids_sha256"] == hashlib.sha256(ids).hexdigest() and r["decoded_sha256"] == hashlib.sha256(after[r["doc_id"]].encode()).hexdigest()


def test_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_stages_on_hard_tables(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with clashing names, through every stage."""
    good = " ".join(f"Sentence {k} tells a plain story about town{k} and river{k} in spring." for k in range(12))
    other = " ".join(f"Quite another text {k} speaks of bridge{k} and garden{k} every day." for k in range(12))
    long = " ".join(f"word{k} goes with thing{k * 7} in place{k * 13}." for k in range(12_000))
    rows = [(None, None, None, None, None), (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n", None, "a", 2), (4, good, "en", "a", 1), (4, good, "en", "a", 1), (5, good + " End.", "en", "a", 1), (5, other, "en", "a", 1), (None, other + " Mail a@b.org now.", "en", "a", 1), (6, long, "en", "a", 1), (None, good.replace("spring", "autumn"), None, None, None)]
    hard = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, words string, __row string")
    for docs in (hard, hard.filter("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.cut(stage(spark, docs, SF))
            assert docs.columns == hard.columns, name
        left = docs.orderBy("doc_id", "text").collect()
        assert corpus_pipeline.encoding(spark, docs, SF).count() == len(left)
        if left:
            assert sorted(((r["doc_id"], r["text"][:20]) for r in left), key=repr) == sorted([(4, good[:20]), (5, other[:20]), (6, long[:20]), (None, good[:20])], key=repr)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, hard, SF).collect()
        assert len(out) == {0: 7, 1: 8, 2: 11, 3: 11, 4: 11}[k], (name, [(r["doc_id"], (r["text"] or "")[:20]) for r in out] if k < 4 else None)


def test_encoding_stage_against_the_library(spark):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(bpe.default_path())
    known.no_truncation()
    known.no_padding()
    docs = spark.createDataFrame([(1, "It's 12 o'clock\u00a0— naïve 日本😀"), (2, None), (3, "")], "doc_id long, text string")
    for r in corpus_pipeline.encoding(spark, docs, SF).collect():
        ids = known.encode({1: "It's 12 o'clock\u00a0— naïve 日本😀"}.get(r["doc_id"], ""), add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
