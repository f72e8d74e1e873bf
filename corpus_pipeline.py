"""The corpus pipeline: language ID, near-dedup, decontamination, PII and packing, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import common, decontaminate, language, packing, pii, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier learned, from the labelled ones among them: its kernel speaks for one of its languages by no less
    than it does for texts of the sample, and few n-grams are unknown. A text that is null, empty or without a letter goes; rows that repeat are
    judged alike; rows without doc_id or lang are judged like others; with nothing to learn from, all texts with a letter stay."""
    model = language.fit(language.training_rows(docs))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row_"))
    out = language.predict(rows, model, "row_", judge=True).where((F.col("lang_pred") != "und") & (F.col("near") >= model.least) & (F.col("known") >= model.floor))
    return out.select(*(F.col("row_")[c].alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies: five-word shingles, similarity of 0.8 or more. The one with the smallest doc_id stays, and so do rows without
    one. Documents are told apart by doc_id and text: of different texts under one doc_id, each stays that is no copy; of rows that repeat both,
    one stays. Null texts are empty, and empty texts copies of each other."""
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item. Rows without doc_id are judged by their texts; rows of one doc_id go together."""
    return decontaminate.clean_of(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; null texts stay null, and rows that repeat are redacted alike."""
    out = pii.redact(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences. Null texts are empty (an end mark); rows that repeat are packed as documents of their own."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packed)]

#: Fingerprints, trained classifiers and the tokenizer have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.settled(docs, f"stage_{name}", before)
    common.drop_written(before)  # the last stage's result is a table of its own
    return docs
