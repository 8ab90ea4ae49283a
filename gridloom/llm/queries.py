"""The queries over this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import ann, bpe, media, minhash, packing, pii, quality, substring, toxicity, warc
from gridloom.llm.common import held_out, read_table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), bpe.digests, "ids_sha256 string, decoded_sha256 string")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_round_trip(read_table(spark, sf_dir, "pages"))
    return out.select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT html, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN g.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first <> p.page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(_: str, base: list[pii.Span], every: list[pii.Span]) -> tuple:
        joined, whole = (",".join(f"{k}:{a}:{b}" for k, a, b in s) for s in (base, every))
        return *(sum(s[0] == k for s in base) for k in pii.KINDS), hashlib.sha256(joined.encode()).hexdigest(), whole

    columns = [*((f"n_{k}", "bigint", pa.int64()) for k in pii.KINDS), ("base_sha256", "string", pa.string()), ("spans", "string", pa.string())]
    return pii.find(read_table(spark, sf_dir, "documents"), pii.fit(), digest, columns)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = media.media_columns(docs)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("digest").alias("media_sha256"), "feature", "width", "height", "depth", "shard", "offset", "length")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    out = quality.score(docs, quality.fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=2, percent=80)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
    ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles
  FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  WHERE least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, len(shingles)::BIGINT AS n_shingles, min(reach.b) AS component_id, s.doc_id = min(reach.b) AS kept
FROM s JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, shingles
"""


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_media": op5_media,
    "op6_substring": op6_substring,
    "op7_quality": op7_quality,
    "op8_minhash": op8_minhash,
    "op9_ann": op9_ann,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op8_minhash": OP8_SQL,
}
