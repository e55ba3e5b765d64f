"""The pipeline against the same decisions made one document at a time."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import pieces, queries, secrets, spm

from .conftest import ODD, prose
from .test_text import contaminated, groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    stems = {"aa": ["ka", "to", "mi", "ra", "ne"], "bb": ["schl", "ung", "eit", "ver", "und"]}
    item = prose(500, 30)
    rows = [(i, prose(i, 40, stems[k]), k, "s", 0) for i in range(60) for k in ["aa" if i % 2 else "bb"]]
    rows += [(100, rows[5][1], "aa", "s", 0), (101, rows[5][1] + " x", "aa", "s", 0), (102, rows[7][1] + " " + item, "aa", "s", 0), (103, rows[9][1][:80] + " password=abcdef123456", "aa", "s", 0)]
    rows += [(104, None, "aa", "s", 0), (105, "1234 5678 !!", None, "s", 0), (106, "", None, None, None), (107, rows[11][1][:60], None, None, None), (107, rows[11][1][:60], None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(501, 20))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, item


def test_stages(spark, folder):
    at, rows, item = folder
    alive = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    label = groups(dict(alive).items(), 5, 80)
    alive = [(i, t) for i, t in dict(alive).items() if label[i] == i]
    leaks = {r[0] for r in contaminated(alive, [(1, item), (2, prose(501, 20))]) if r[2]}
    want = {i: secrets.redact(t, secrets.spans(t)) for i, t in alive if i not in leaks}
    out = corpus_pipeline.run(spark, at).collect()
    assert {r["doc_id"]: r["text"] for r in out} == want and len(out) == len(want)
    assert leaks == {102} and "[REDACTED]" in want[103] and 100 not in want
    lattice = spm.Lattice(pieces.load())
    assert spm.decode_ids(lattice, [r["ids"] for r in out]) == [r["text"] for r in out]


def test_stage_columns(spark, folder):
    at, _, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "secrets", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.dtypes == docs.dtypes
    assert corpus_pipeline.STAGES[-1][1](spark, docs, at).columns[:5] == docs.columns


def test_empty_input(spark, folder):
    at, _, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, at).count() == 0


def test_odd_rows(spark, folder, odd):
    """Nulls in every column, blank and very long texts, repeated rows and clashing further columns, stage by stage."""
    at, _, _ = folder
    count = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    whole = collections.Counter(ODD)
    stage = dict(corpus_pipeline.STAGES)
    assert not count(stage["language"](spark, odd, at))  # nothing to learn from
    labelled = odd.withColumn("lang", F.lit("aa"))
    assert count(stage["language"](spark, labelled, at)) == collections.Counter({r: n for r, n in whole.items() if r[1] and r[1].strip()})
    assert count(stage["near_dedup"](spark, odd, at)) == collections.Counter({r: 1 for r in whole if r[0] != 7})
    assert count(stage["decontaminate"](spark, odd, at)) == whole
    assert count(stage["secrets"](spark, odd, at)) == whole
    encoded = stage["sentencepiece"](spark, odd, at)
    assert count(encoded) == whole
    assert {r["doc_id"] for r in encoded.where("ids is null or score is null").collect()} == {1}


def test_contract_columns(spark, sf_dir):
    want = {
        "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"], "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op3_lm_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op4_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "op5_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
        "op6_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op8_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op10_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    }
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, sf_dir)
        assert df.columns == columns
        if "doc_id" in columns:
            assert df.count() == n, name
