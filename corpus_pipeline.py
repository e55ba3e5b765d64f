"""A training-corpus pipeline: each stage filters or rewrites what the one before has kept.

Every stage reads the columns of ``documents`` alone, so further columns, whatever their
names, change nothing and are left out; texts of any length are read whole, and an empty
table gives an empty result.  Null ids, languages, sources and lengths pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, neardup, secrets, spm
from tessera.llm.runtime import delete, discard, doc_bucket, mark, shared_dir, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; those without letters or with an undecided one go.

    Null and empty texts have no letters.  Rows with a null id or language are judged but not
    learned from; without any labelled row no language is recognised, and all rows go.
    Of languages that tie, the alphabetically first is taken.  Repeated rows stay or go together.
    """
    model = langid.fit(docs.where(doc_bucket("doc_id", 4) != 2))
    found = langid.identify(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= 0.4)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): that of the smallest id.

    Rows without a word or without an id are linked with nothing and stay.  Of repeated rows (same id and
    text) one stays.  An id stands for all its rows: with several texts, it goes if one of them joins it to a smaller id.
    """
    gone = written(neardup.near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct(), "gone")
    docs = docs.select(*COLUMNS)
    kept = docs.join(gone, "doc_id", "left_anti")
    again = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "again")
    if again.limit(1).count():  # repeated rows: one of each stays
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words, or any whole shorter item, of the benchmark.

    Null and empty texts hold no window and stay, as all rows do beside an empty benchmark.  Rows of one id
    with different texts, and rows without an id, are judged by their own text; repeated rows alike.
    """
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and their lengths counted anew.

    A null text stays null; a text without a secret keeps its given length, null too.  Every row is kept, repeated ones too.
    """
    found = secrets.scan(docs.select(*COLUMNS), redacted=True)
    n_chars = F.when(F.size("spans") > 0, F.char_length("redacted")).otherwise(F.col("n_chars")).cast("long")
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the piece ids of their best segmentation and its score.

    Both are null for a null text; segmentations that tie are decided alike on every machine.  Every row is kept, repeated ones too.
    """
    found = spm.encode(docs.select(*COLUMNS), n=1, chunk_bytes=2 << 20)  # after four stages, the executors' heaps are full-grown
    return found.select(*COLUMNS, F.get("ids", F.lit(0)).alias("ids"), F.get("scores", F.lit(0)).alias("score"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", redact_secrets), ("sentencepiece", encode)]

#: No SQL form: the language model is learned and the segmentation needs a vocabulary file.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    Once a stage is written, the stage before it and the tables made on the way are deleted.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for at, (name, stage) in enumerate(STAGES, 1):
        since = mark()
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            path = f"{shared_dir(spark)}/pipeline-{at}-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            discard(since)
            if before:
                delete(spark, before)
            before = path
    return docs
