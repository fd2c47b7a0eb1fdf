"""Corpus preparation in stages: quality rules, near-dedup, decontamination, PII, BPE.

Each stage takes (spark, docs, sf_dir), works on every document its predecessor kept and
returns a DataFrame; all but the last return the columns of documents. A stage decides by
(doc_id, hash of the text), so rows that share a doc_id are told apart by their text and
rows alike in both share one decision. Repeated rows are one group to the near-dedup stage,
which keeps one of them.

Defined cases: null and empty texts fail the quality rules, and pass the other stages
unchanged (no ids in the last); a null doc_id takes part; very long texts are worked on
whole; columns other than those of documents are dropped; empty tables give empty results.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, neardup, pii, quality
from lectern.llm.arrow import column, map_rows
from lectern.runtime import cut, discard, load, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
DDL = "doc_id long, text string, lang string, source string, n_chars long"


KEY = ["known_id", "has_id", "th"]


def _key() -> list:
    """What tells documents apart, without nulls: known_id and has_id of the doc_id, and th."""
    return [F.coalesce("doc_id", F.lit(0)).alias("known_id"), F.col("doc_id").isNotNull().alias("has_id"), "th"]


def _hashed(docs: DataFrame) -> DataFrame:
    """The columns of documents and KEY; th is the hash of the text."""
    return docs.select(*COLUMNS, F.xxhash64("text").alias("th")).select(*COLUMNS, *_key())


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    stats = cut(quality.rule_statistics(docs))
    fitted = quality.fit(stats, load(spark, sf_dir, "labels"))
    return quality.filtered(docs.select(*COLUMNS), fitted, DDL)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    kept = neardup.near_duplicates(docs).where("kept").select(*_key()).distinct()
    # Repeated rows are combined before they travel, and the join finds them dealt as it needs them.
    return _hashed(docs).dropDuplicates(KEY).join(kept, KEY, "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages contaminate go; passages in others are cut out."""
    return decontaminate.filtered(docs.select(*COLUMNS), load(spark, sf_dir, "benchmark"), DDL)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    # A table, so that Spark knows its size and sends it to the tasks if it is small.
    added = written(pii.added_by_text(pii.find(docs)).select(*_key(), "added"))
    joined = _hashed(docs).join(added, KEY, "left").select(*COLUMNS, "added")

    def per_task():
        def one(batch: pa.RecordBatch) -> dict:
            out, sizes = [], []
            for text, n, more in zip(*(column(batch, c).to_pylist() for c in ("text", "n_chars", "added"))):
                spans = pii.base_spans(text or "") + [(s["start"], s["kind"], s["end"]) for s in more or ()]
                new = pii.redacted(text, spans) if spans else text
                out.append(new)
                sizes.append(len(new) if spans else n)
            return {c: column(batch, c) for c in COLUMNS} | {"text": out, "n_chars": sizes}

        return one

    return map_rows(joined, per_task, DDL)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of every document that is left."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii_redaction),
    ("bpe", bpe_tokens),
]

#: Isolation forests, minima and bootstrapped contexts have no SQL; tests compare brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet to the shared folder and reread."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
