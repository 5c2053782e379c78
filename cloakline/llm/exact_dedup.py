"""Exact dedup: two-pass Bloom filtering; only possibly repeated rows shuffle.

Two texts are equal when they are identical after deleting every character of
``[\\x20\\x09-\\x0D]``.  Of equal texts the row with the most code points in the
original text stays, then the smallest ``doc_id``.

Pass one reads all texts and builds the filter (``bloom``) of their hashes;
pass two lets every row that the filter calls unique straight through, and
only the others meet in a shuffle, where full SHA-256 values are compared.

Defined cases: a null text is the empty text, and all blank texts are equal to
each other; a null ``doc_id`` sorts first; of rows repeating both ``doc_id``
and text exactly one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.llm import bloom
from cloakline.llm.common import attach, documents, written

BLANKS = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` (with the hex column ``text_sha256``) plus ``maybe``: the filter reports the hash."""
    key = F.conv(F.substring("text_sha256", 1, 16), 16, -10).cast("long")
    hashes = rows.select(key.alias("h"))
    bits = bloom.counted(hashes, rows.count(), 2)
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    schema = rows.withColumn("maybe", F.lit(True)).schema
    at = rows.columns.index("text_sha256")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.array([int(x[:16], 16) for x in batch.column(at).to_pylist()], np.uint64)
            maybe = pa.array(bloom.reported(h, shared.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, maybe], names=[*batch.schema.names, "maybe"])

    return rows.mapInArrow(mark, schema)


def duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.length(F.coalesce("text", F.lit(""))).cast("long").alias("_n"),
                       F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    marked = written(_marked(rows), "exact-dedup")  # ids and hashes, not texts: both branches below read it
    alone = marked.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    same = (marked.where("maybe").groupBy("text_sha256", "doc_id", "_n")
            .agg(F.count(F.lit(1)).alias("_copies")))
    groups = same.groupBy("text_sha256").agg(
        F.sum("_copies").alias("group_size"), F.count(F.lit(1)).alias("_members"),
        F.max(F.struct(F.col("_n").alias("n"), F.col("doc_id").isNull().alias("null"),
                       F.bitwise_not("doc_id").alias("id"))).alias("_best"))  # falls as the id grows, for every long
    full = attach(same, groups, "text_sha256", "_members", rows.count())
    met = full.select("doc_id", F.bitwise_not("_best.id").alias("keep_id"), "group_size", "_n", "_best", "text_sha256",
                      F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    stays = ((F.col("_copy") == 1) & (F.col("_n") == F.col("_best.n"))
             & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return alone.unionByName(met.select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept as they are.

    Rows the filter calls unique pass straight through; of the others one row
    per text is kept by a map-side combined aggregate, so copies of one text,
    however many, never meet in one task.
    """
    rows = docs.select(F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    marked = _marked(rows)
    order = F.struct(F.length(F.coalesce(F.col("_row.text"), F.lit(""))).alias("n"),
                     F.col("_row.doc_id").isNull().alias("null"), F.bitwise_not(F.col("_row.doc_id").cast("long")).alias("id"))
    met = marked.where("maybe").groupBy("text_sha256").agg(F.max_by("_row", order).alias("_row"))
    return marked.where(~F.col("maybe")).select("_row.*").unionByName(met.select("_row.*"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(documents(spark, sf_dir))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
