"""Document fingerprints: a threshold-scaled sketch, in DataFrame functions only.

The fingerprint of a text is the set of 64-bit hashes of its five-word shingles
that lie below a fixed fraction of the hash range, so it grows with the text
and two fingerprints can be compared or merged whatever the lengths: the sketch
of a union is the union of the sketches, and the share of one sketch found in
the other estimates containment.  A text none of whose hashes lies below the
threshold keeps its smallest hash, which also survives a merge (of a union, the
hashes below the threshold, or else the smallest).

Defined cases: words are lower-cased runs of ``[^\\x20\\x09-\\x0D]``; with fewer
than five words the whole sequence is one shingle; a null, empty or blank text
has the empty fingerprint, which is like (1.0) another empty one and unlike
(0.0) any other.  Likeness is the estimated Jaccard index.  Documents are
ordered by ``doc_id`` (null first), then text; the first follows the last; a
single document follows itself.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakline.llm.common import documents, written
from cloakline.llm.neighbours import previous

SHINGLE = 5             # words
FRACTION = 1 / 8        # of all hashes are kept
BLOCK_BITS = 9          # 2**9 consecutive ids travel together


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    words = F.filter(F.split(F.lower(text), "[ \t-\r]+"), lambda w: w != "")
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= width, F.transform(
        F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])))
        .when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>")))[0]


def sketch(text: Column, fraction: float = FRACTION, width: int = SHINGLE) -> Column:
    """Sorted distinct shingle hashes below ``fraction`` of the range, or else the smallest."""
    below = -(1 << 63) + int(fraction * (1 << 64))
    return F.transform(F.array(shingle_hashes(text, width)), lambda h: F.transform(
        F.array(F.filter(h, lambda x: x < F.lit(below).cast("long"))),
        lambda kept: F.when(F.size(kept) > 0, F.array_sort(F.array_distinct(kept)))
        .otherwise(F.slice(F.array_sort(h), 1, 1)))[0])[0]


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Sketch of the union of two texts' shingles, from their sketches alone."""
    below = -(1 << 63) + int(fraction * (1 << 64))
    return F.transform(F.array(F.array_sort(F.array_union(a, b))), lambda h: F.transform(
        F.array(F.filter(h, lambda x: x < F.lit(below).cast("long"))),
        lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.slice(h, 1, 1)))[0])[0]


def printed(sketched: Column) -> Column:
    return F.array_join(F.transform(sketched, F.hex), ",")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard index of the texts of two sketches."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch and the next document's text and sketch, in doc_id order.

    Blocks of 2**BLOCK_BITS ids shuffle once, each with the first document of
    the block after it; ids only are read to find which block comes after which.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    block = F.coalesce(F.shiftright("doc_id", BLOCK_BITS), F.lit(-(1 << 62)).cast("long"))  # null ids first
    firsts = rows.groupBy(block.alias("_block")).agg(F.min("doc_id").alias("_first"))
    before = previous(firsts.select("_block"), "_block")
    around = written(firsts.join(before, "_block").withColumnRenamed("prev", "_to"), "blocks")
    dealt = rows.withColumn("_block", block).join(around, "_block").withColumn("_halo", F.explode(
        F.when(F.col("doc_id").eqNullSafe(F.col("_first")), F.array(F.lit(False), F.lit(True)))
        .otherwise(F.array(F.lit(False)))))
    dealt = dealt.select("doc_id", "text", "_halo",
                         F.when(F.col("_halo"), F.col("_to")).otherwise(F.col("_block")).alias("_block"))
    sketched = dealt.repartition("_block").withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("_block").orderBy("_halo", F.col("doc_id").asc_nulls_first(), "text")
    led = sketched.select("doc_id", "text", "sketch", "_halo", F.lead("text").over(order).alias("next_text"),
                          F.lead("sketch").over(order).alias("next_sketch"))
    return led.where(~F.col("_halo")).drop("_halo")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    rows = with_next(docs).withColumn("_edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                       F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "next_sketch",
                       sketch(F.col("_edited")).alias("_edited"))
    return rows.select("doc_id", "n_chars", "edited_sha256", printed(F.col("sketch")).alias("fingerprint"),
                       printed(F.col("_edited")).alias("edited_fingerprint"),
                       likeness(F.col("sketch"), F.col("_edited")).alias("near_edited"),
                       likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
                       containment(F.col("sketch"), F.col("next_sketch")).alias("contained_in_next"))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
