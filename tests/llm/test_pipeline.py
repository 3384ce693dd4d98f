"""The corpus pipeline: each stage against its operator or a plain version, and the whole run."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from quillmesh.llm import quality, secret_scan, toxicity

from .test_near_dups import brute

SF = "/root/testdata/sf0.001"


def test_run(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id: r for r in docs.collect()}
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        if name == "quality":
            want = {r.doc_id for r in quality.op4_quality_rules(spark, SF).where("kept").collect()}
        elif name == "toxicity":
            fitted = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {r.doc_id for r in toxicity.score(docs, *fitted).where("predicted = 0").collect()}
        elif name == "near_dedup":
            ids = sorted(left)
            want = {i for i, (_, c) in brute(ids, [left[i].text for i in ids], 5).items() if i == c}
        else:
            want = set(left)
        docs = spark.createDataFrame(out.collect(), out.schema)
        got = {r.doc_id: r for r in docs.collect()}
        assert set(got) == want, name
        if name == "secrets":
            for i, r in got.items():
                assert r.text == secret_scan.redact(left[i].text, secret_scan.find(left[i].text)) and r.n_chars == len(r.text)
        left = got
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(left)
    for r in rows:
        ids = [*tok.encode(left[r.doc_id].text, add_special_tokens=False).ids, 1]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
    # every row of documents that is lost has a reason: most stay
    assert len(left) > 0.5 * first.select(F.count_distinct("doc_id")).head()[0]


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows(spark):
    """Nulls in every column, repeated rows, a long text, columns with names that operators use themselves: no stage fails, clean rows stay."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("etaoinshrdlu"), 5)) for _ in range(300)]
    good = [" ".join(rng.choice(words, 80)) for _ in range(60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += rows[:3] + [(None, None, None, None, None), (None, good[5], None, None, None), (70, "", "", "", 0), (71, " ".join(rng.choice(words, 250_000)), "en", "s", 1), (71, good[6], "en", "t", 2)]
    extra = ["kept", "score", "row", "bucket", "n", "key", "k", "half", "family", "toxic", "digest", "component_id", "a", "b", "id", "ids"]
    docs = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == names, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    left = [r.doc_id for r in docs.collect()]
    assert set(range(60)) <= set(left) and left.count(0) == 1 and 70 not in left
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(left)
