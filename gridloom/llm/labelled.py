"""Bounded, repeatable samples of labelled documents for fitting models on the driver."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import discard, held_out, materialize

#: Labelled rows of each class that a model is fitted on, at most, and the bytes of their texts: rows are taken in the order
#: of a hash of the id until they hold so many, whatever the length of each. With these two, what reaches the driver is
#: bounded whatever the size of the tables.
ROWS_PER_CLASS = 3000
BYTES_PER_CLASS = 64 << 20


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int = ROWS_PER_CLASS, bytes_per_class: int = BYTES_PER_CLASS) -> tuple[Iterator[tuple[str, str | None, int]], float]:
    """(text, lang, label) of a sample of the labelled documents that are not held out, one by one in the order of ids, and
    the share of label 1 among all of them. A document with several labels has the largest; of several texts of one id the
    least counts, a null text as empty. Labels without a document take no part."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    known = materialize(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "labelled", narrow=True)
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    draw = [known.where(F.col("_label") == y).orderBy(*order).limit(rows_per_class) for y in (0, 1)]
    drawn = F.broadcast(draw[0].unionAll(draw[1]))  # two times rows_per_class rows of two numbers
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang")).join(drawn, "doc_id")
    rows = rows.groupBy("doc_id", "_label").agg(F.min(F.struct("text", "lang")).alias("d")).select("doc_id", "_label", "d.*")
    rows = materialize(rows, "labelled-texts")
    before = Window.partitionBy("_label").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.select("doc_id", "_label", F.octet_length("text").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = sizes.where(F.col("before") < bytes_per_class).select("doc_id")

    def stream() -> Iterator[tuple[str, str | None, int]]:
        for r in rows.join(F.broadcast(within), "doc_id").orderBy("doc_id").toLocalIterator():
            yield r["text"], r["lang"], r["_label"]
        discard(known)
        discard(rows)

    return stream(), share


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, **bounds) -> tuple[list[tuple[str, str | None, int]], float]:
    """The same as a list."""
    rows, share = labelled_rows(docs, labels, label, **bounds)
    return list(rows), share
