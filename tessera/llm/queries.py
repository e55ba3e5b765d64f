"""Thin queries over the synthetic tables, one for each operator, with production parameters.

``QUERIES`` maps a name to a function of (session, table folder); ``ORACLES``
has DuckDB SQL for those that SQL can express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, linedup, lm, neardup, quality, secrets, spm, toxicity
from .oracles import ORACLES as ORACLES
from .runtime import doc_bucket, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("fold", doc_bucket("doc_id", 4))
    model = langid.fit(docs.where("fold <> 2"))
    found = langid.identify(docs.select("doc_id", "text", (F.col("fold") == 2).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (doc_bucket("doc_id", 4) == 2).alias("held_out"))
    model = toxicity.fit(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score(docs, docs.where(doc_bucket("doc_id", 7) != 2))
    return scored.select("doc_id", (doc_bucket("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.filtered(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best segmentations of every text, as digests, and whether the best decodes to the text."""
    encoded = spm.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), n=2, decoded="decoded")
    best, second = F.get("ids", F.lit(0)), F.get("ids", F.lit(1))
    return encoded.select(
        "doc_id", F.size(best).cast("long").alias("n_pieces"), F.get("scores", F.lit(0)).alias("best_score"), F.get("scores", F.lit(1)).alias("second_score"),
        F.xxhash64(best).alias("best_hash"), F.xxhash64(second).alias("second_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage but its earliest occurrence: where it is, and the document that keeps it."""
    found = linedup.removed_spans(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("first_id", "first_doc_id")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))]))
    added = spark.range(1).select(F.lit(-1).alias("conv_id"), roles.alias("x")).select("conv_id", "x.turn", "x.role", F.lit(probe).alias("text"))
    added = added.select(*[F.col(c).cast(kind).alias(c) for c, kind in turns.dtypes])
    back = chat.read_back(chat.windows(turns.unionByName(added)))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_lm_score": op3_lm_score,
    "op4_quality": op4_quality,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_decontamination": op6_decontamination,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_secrets": op8_secrets,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_chat": op10_chat,
}
