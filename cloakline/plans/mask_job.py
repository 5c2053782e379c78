"""MK-9 corpus job: scan -> (detector spans) -> merge -> route -> mask -> vault.

One narrow stage over the documents.  A shuffle happens only when a
per-document side table (detector replies, abstraction phrases) is joined,
and then on ``doc_id`` alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.operators import mask as M
from cloakline.operators import scan as SC
from cloakline.operators import spans as SP
from cloakline.sources.patterns import InlinePattern


def attach_detections(docs: DataFrame, replies: DataFrame, sensitivity: Column | float = 0.7) -> DataFrame:
    """Join detector replies (kind='detect') on doc_id and validate them in-row."""
    sens = sensitivity if isinstance(sensitivity, Column) else F.lit(float(sensitivity))
    # one reply per document (duplicates keep the largest raw text), so the
    # left join can never multiply documents
    det = replies.filter(F.col("kind") == "detect").groupBy("doc_id").agg(F.max("raw").alias("_detect_raw"))
    joined = docs.join(det, "doc_id", "left")
    parsed = SP.parse_detect(F.col("_detect_raw"))
    return joined.withColumn("detections", SP.detector_spans(parsed, F.col("text"), sens)).drop("_detect_raw")


def detections_from_column(docs: DataFrame, raw_col: str, sensitivity: Column | float = 0.7) -> DataFrame:
    """Detector replies already on the document row (e.g. from
    ``hooks.reply_column``): parsed and validated in-row, no join."""
    sens = sensitivity if isinstance(sensitivity, Column) else F.lit(float(sensitivity))
    parsed = SP.parse_detect(F.col(raw_col))
    return docs.withColumn("detections", SP.detector_spans(parsed, F.col("text"), sens)).drop(raw_col)


def attach_phrases(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """Abstraction phrases per (doc_id, span) as a per-document map (SC-14 cap applied)."""
    from cloakline.functions.text import cap_words

    # one phrase per (doc, span): repeated rows keep the smallest phrase
    # (deterministic), so map keys stay unique
    entries = F.array_sort(F.collect_list(F.struct(F.col("span"), cap_words(F.col("phrase")).alias("phrase"))))
    per_doc = phrases.groupBy("doc_id").agg(
        F.map_from_entries(SP.first_wins(entries, "struct<span:string,phrase:string>", "span")).alias("phrase_map")
    )
    return docs.join(per_doc, "doc_id", "left")


def mask_corpus(
    docs: DataFrame,
    patterns: list[InlinePattern],
    secret: Column,
    with_detections: bool = False,
    with_phrases: bool = False,
    all_occurrences: bool = False,
) -> DataFrame:
    """Masked table: doc_id, masked, spans, mask_items, counters."""
    scanned = SC.scan(docs, patterns)
    merged = scanned.withColumn("merged", F.expr(SP.merge_sql("hits", "detections" if with_detections else None)))
    if with_detections:
        merged = merged.withColumn("cache_misses", SP.cache_misses(F.col("hits"), F.col("detections")))
    else:
        merged = merged.withColumn("cache_misses", F.lit(0))
    return M.routed_mask(merged, "merged", secret, "phrase_map" if with_phrases else None, all_occurrences)


def vault_rows(masked: DataFrame, key: Column, key_id: str, applied_only: bool = False) -> DataFrame:
    """MK-6 vault records for encrypt-routed spans (compat: skipped ones too)."""
    src = "spans" if applied_only else "mask_items"
    items = masked.select("doc_id", F.explode_outer(src).alias("it")).filter(F.col("it.action") == "encrypt")
    if applied_only:
        items = items.withColumn("tid", F.regexp_extract(F.col("it.replacement"), r"<<ENC:([^:]+):ENC>>", 1))
    else:
        items = items.withColumn("tid", F.col("it.token_id"))
    return items.select(
        "doc_id",
        F.col("tid").alias("token_id"),
        F.lit(key_id).alias("key_id"),
        F.aes_encrypt(F.col("it.span").cast("binary"), key, F.lit("GCM")).alias("ciphertext"),
        F.length(F.col("it.span")).alias("original_len"),
    )


def output_records(masked: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """PRJ-3: one output record per document: text, masked text, applied
    spans, counters, and a nested ``validation`` struct only when the
    document was validated (null otherwise)."""
    from cloakline.operators.mask import mask_counts

    base = masked.select("doc_id", F.col("text").alias("original"), "masked", "spans", "cache_hits",
                         "cache_misses", *mask_counts("spans"))
    if validation is None:
        return base.withColumn("validation", F.lit(None).cast(
            "struct<is_clean:boolean,is_fluent:boolean,is_accurate:boolean,leaked_spans:array<string>,"
            "over_encrypted:array<string>,fluency_score:double,leakage_confidence:double,total_reward:double>"))
    v = validation.select("doc_id", F.struct("is_clean", "is_fluent", "is_accurate", "leaked_spans", "over_encrypted",
                                             "fluency_score", "leakage_confidence", "total_reward").alias("validation"))
    return base.join(v, "doc_id", "left")
