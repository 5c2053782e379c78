"""Vault operators: span encryption (MK-6), decryption with tamper
detection (MK-7), sentence restore (MK-8, JN-8) and import (ST-5, SNK-8).

Ciphertexts come from the built-in ``aes_encrypt`` in GCM mode (random
96-bit nonce carried in the output, 128-bit tag).  Token ids are derived
deterministically (see ``mask.token_id``) so the masked text and the vault
agree even when a task is retried or the two sinks are written separately.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakline.functions.text import TOKEN_REGEX, token_text
from cloakline.operators.spans import first_wins


def encrypt_spans(items: DataFrame, key: Column, key_id: str) -> DataFrame:
    """MK-6: ``(doc_id, token_id, span)`` -> vault rows."""
    return items.select(
        "doc_id", "token_id", F.lit(key_id).alias("key_id"),
        F.aes_encrypt(F.col("span").cast("binary"), key, F.lit("GCM")).alias("ciphertext"),
        F.length("span").alias("original_len"),
    )


def decrypt(vault: DataFrame, key: Column) -> DataFrame:
    """MK-7: plaintext per vault row; null plaintext = tampered or wrong key."""
    return vault.withColumn(
        "plaintext", F.try_aes_decrypt(F.col("ciphertext"), key, F.lit("GCM")).cast("string")
    ).withColumn("status", F.when(F.col("plaintext").isNull(), F.lit("rejected")).otherwise(F.lit("ok")))


def restore(masked: DataFrame, vault: DataFrame, key: Column, masked_col: str = "masked") -> DataFrame:
    """MK-8 / JN-8: replace every occurrence of each token by its plaintext.

    The vault is read only for the documents asked for (semi join), grouped
    once per document (bounded by the document's own spans) and joined back
    on ``doc_id``; both sides are hash partitioned on ``doc_id`` only.
    Tokens without a usable vault record are kept, counted and listed in
    ``unmatched`` (``unmatched_tokens`` has them as rows).
    """
    wanted = masked.select("doc_id")
    dec = decrypt(vault.join(wanted, "doc_id", "left_semi"), key)
    # collect_list skips the nulls of rejected rows; a filter on the
    # plaintext would be pushed below and decrypt every row twice
    # a vault written twice (a retried append) may repeat a token: the
    # first usable record per token wins, so map keys stay unique
    entries = F.array_sort(F.collect_list(F.when(F.col("plaintext").isNotNull(),
                                                 F.struct("token_id", "plaintext"))))
    per_doc = dec.groupBy("doc_id").agg(
        F.map_from_entries(first_wins(entries, "struct<token_id:string,plaintext:string>", "token_id"))
        .alias("_plain")
    )
    j = masked.join(per_doc, "doc_id", "left")
    ids = F.array_distinct(F.regexp_extract_all(F.col(masked_col), F.lit(TOKEN_REGEX), 1))
    restored = F.aggregate(
        ids, F.col(masked_col),
        lambda acc, t: F.when(F.element_at(F.col("_plain"), t).isNotNull(),
                              F.replace(acc, token_text(t), F.element_at(F.col("_plain"), t))).otherwise(acc),
    )
    lost = F.filter(ids, lambda t: F.element_at(F.col("_plain"), t).isNull())
    return j.select(
        "*", restored.alias("restored"), F.size(ids).alias("n_tokens"),
        (F.size(ids) - F.size(lost)).alias("n_restored"), lost.alias("unmatched"),
    ).drop("_plain")


def unmatched_tokens(restored: DataFrame) -> DataFrame:
    """JN-8: one row (doc_id, token_id) per token of a restored table without a usable vault record."""
    return restored.select("doc_id", F.explode("unmatched").alias("token_id"))


def import_vault(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """ST-5: union; on an equal (doc_id, token_id) the incoming row wins."""
    both = current.withColumn("_src", F.lit(0)).unionByName(incoming.withColumn("_src", F.lit(1)))
    w = Window.partitionBy("doc_id", "token_id").orderBy(F.col("_src").desc())
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_src")


def to_text_form(vault: DataFrame) -> DataFrame:
    """SC-17: ciphertexts as base64 text (for JSON exports); ``from_text_form``
    reverses it."""
    return vault.withColumn("ciphertext", F.base64("ciphertext"))


def from_text_form(vault: DataFrame) -> DataFrame:
    return vault.withColumn("ciphertext", F.unbase64("ciphertext"))
