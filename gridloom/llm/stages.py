"""Operators as stages over the documents table: each takes and returns documents, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import minhash, packing, pii, substring, toxicity
from gridloom.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the toxicity classifier, fitted on the labels, does not reject."""
    scored = toxicity.score(docs.select(*COLUMNS), toxicity.fit(docs, labels), keep=list(COLUMNS))
    return scored.where(~F.col("rejected")).select(*COLUMNS)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    found = minhash.near_duplicates(docs)
    dropped = materialize(found.where(~F.col("kept")).select("doc_id").distinct(), "stage-dropped")
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def without_repeats(docs: DataFrame) -> DataFrame:
    """Documents without passages that an earlier document or place has; n_chars follows the text."""
    out = substring.substring_dedup(docs.select(*COLUMNS))
    chars = F.when(F.col("n_chunks_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*COLUMNS)


def without_personal_data(docs: DataFrame) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    out = pii.redacted(docs.select(*COLUMNS, F.col("text").alias("_before")), pii.fit())
    chars = F.when(F.col("text") == F.col("_before"), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(chars)).select(*COLUMNS)


def packed(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.pack(docs, tokenizer_path)
