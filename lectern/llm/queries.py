"""The queries of this subpackage: thin digests over the operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import align, bpe, chat, credentials, decontaminate, langid, licenses, neardup, pii, quality, repair, suffix, toxicity
from lectern.llm.oracles import ORACLES  # noqa: F401
from lectern.runtime import load


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(load(spark, sf_dir, "documents")).withColumn("spans", pii.spans_column())
    n_spans = F.size("base") + F.coalesce(F.size("added"), F.lit(0))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", n_spans.cast("long").alias("n_spans"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(load(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_conversations(turns, vocabulary=public_tokenizers.path("word_bpe_49k.json")))


def _fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = langid.train(docs.where(_fold(4) != 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.deduplicated(load(spark, sf_dir, "documents"), keep_bytes=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.train(docs, load(spark, sf_dir, "labels").where(_fold(5) != 0))
    found = toxicity.score_documents(docs, model)
    held_out = F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.scan_documents(load(spark, sf_dir, "documents"))

    def n(field: str, value) -> F.Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")

    kinds = [n("kind", k).alias(f"n_{name}") for k, name in enumerate(credentials.KINDS[:3])]
    verdicts = [n("verdict", v).alias(f"n_{v}") for v in ("live", "example", "unclear")]
    base = F.sha2(credentials.joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256")
    return found.select("doc_id", *kinds, base, credentials.joined(F.col("spans")).alias("spans"), *verdicts)


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents")
    return align.align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep_groups=False).drop("groups")


def _damaged(turns: DataFrame) -> DataFrame:
    """Conversations with the damage of the contract: rows dropped, emptied, without their marks, repeated or said by the user."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    what = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), what.alias("what")).where("what <> 0")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("what") == 3, 2).otherwise(1))).alias("time")
    return rows.select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    found = repair.repaired(_damaged(turns))
    whole = turns.select(F.col("conv_id").alias("original")).distinct().join(found, F.col("original").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select(
        F.col("original").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


QUERIES = {f.__name__: f for f in (op1_pii, op2_licenses, op3_chat, op4_language, op5_suffix, op6_bpe, op7_toxicity, op8_decontamination, op9_quality, op10_neardup, op11_secrets, op12_align, op13_repair)}
