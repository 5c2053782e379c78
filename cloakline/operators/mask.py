"""Masking operators MK-1 .. MK-5 as in-row folds (``aggregate``).

A fold keeps the exact sequential semantics (each replacement is searched
again in the live text) while staying a pure Catalyst expression: no
shuffle, no Python.  The cost is linear in text length per span, i.e.
bounded per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline import constants as C
from cloakline.functions.text import route, token_text

APPLIED_TYPE = (
    "array<struct<label:string,span:string,phi_type:string,action:string,replacement:string,source:int>>"
)


def token_id(secret: Column, doc_id: Column, idx: Column, span: Column) -> Column:
    """Deterministic, keyed token id (stable across retries and sinks)."""
    material = F.concat_ws("|", secret, doc_id.cast("string"), idx.cast("string"), span)
    return F.substring(F.sha2(material, 256), 1, 16)


def demo_keys(spark, key_id: str = "demo", seed_text: str = "cloakline-demo-key") -> DataFrame:
    """A keys table ``(key_id, key BINARY)`` with one derived 32-byte key (tests only)."""
    return spark.range(1).select(F.lit(key_id).alias("key_id"), F.unhex(F.sha2(F.lit(seed_text), 256)).alias("key"))


def key_column(keys: DataFrame, key_id: str) -> Column:
    """The key as a scalar subquery, absent from plan text; a missing key stops the job before it masks anything."""
    missing = F.raise_error(F.lit(f"no key for key id {key_id!r}")).cast("binary")
    return F.coalesce(keys.filter(F.col("key_id") == key_id).select("key").scalar(), missing)


def order_for_mask(spans: Column, text: Column) -> Column:
    """SO-2: first occurrence descending, merge order on ties; absent spans dropped."""
    keyed = F.transform(
        spans,
        lambda s, i: F.struct(
            (-(F.instr(text, s["span"]) - 1)).alias("k"), i.alias("i"),
            (F.instr(text, s["span"]) - 1).alias("idx"), s.alias("s"),
        ),
    )
    return F.array_sort(F.filter(keyed, lambda x: x["idx"] >= 0))


def with_replacements(ordered: Column, doc_id: Column, secret: Column, phrases: Column | None) -> Column:
    """PRJ-1 routing and JN-3 replacement lookup for each ordered span."""

    def one(x):
        s = x["s"]
        action = route(s["phi_type"])
        tid = token_id(secret, doc_id, x["idx"], s["span"])
        phrase = F.element_at(phrases, s["span"]) if phrases is not None else F.lit(None).cast("string")
        abstract = F.coalesce(F.nullif(s["abstraction_role"], F.lit("")), phrase, F.lit(C.REDACTED))
        return F.struct(
            x["idx"].alias("idx"), s["label"].alias("label"), s["span"].alias("span"),
            s["phi_type"].alias("phi_type"), action.alias("action"),
            F.when(action == "encrypt", tid).alias("token_id"),
            F.when(action == "encrypt", token_text(tid)).otherwise(abstract).alias("replacement"),
            s["source"].alias("source"),
        )

    return F.transform(ordered, one)


def fold_first(text: Column, items: Column, all_occurrences: bool = False) -> Column:
    """MK-1/MK-2 fold: each item replaced at its first live occurrence (or all).

    Returns ``struct<text, applied>``; items not found in the live text are
    skipped and absent from ``applied``.
    """
    init = F.struct(text.alias("text"), F.array().cast(APPLIED_TYPE).alias("applied"))

    def step(acc, x):
        p = F.instr(acc["text"], x["span"])
        found = p > 0
        if all_occurrences:
            new_text = F.replace(acc["text"], x["span"], x["replacement"])
        else:
            new_text = F.overlay(acc["text"], x["replacement"], p, F.length(x["span"]))
        rec = F.struct(x["label"].alias("label"), x["span"].alias("span"), x["phi_type"].alias("phi_type"),
                       x["action"].alias("action"), x["replacement"].alias("replacement"), x["source"].alias("source"))
        return F.struct(
            F.when(found, new_text).otherwise(acc["text"]).alias("text"),
            F.when(found, F.array_append(acc["applied"], rec)).otherwise(acc["applied"]).alias("applied"),
        )

    return F.aggregate(items, init, step)


def fold_at_offsets(text: Column, items: Column) -> Column:
    """MK-3/MK-5 fold: replace at recorded 0-based offsets, items already right-to-left."""
    return F.aggregate(
        items, text,
        lambda acc, x: F.overlay(acc, x["replacement"], x["start"] + 1, x["end"] - x["start"]),
    )


def _enc_types_sql() -> str:
    return ", ".join("'" + t + "'" for t in C.ENCRYPT_TYPES)


def items_sql(spans_col: str, text_col: str, doc_col: str, secret_col: str, phrases_col: str | None) -> str:
    """SQL text of SO-2 ordering + PRJ-1 routing + JN-3 replacements
    (same semantics as ``order_for_mask`` + ``with_replacements``)."""
    t = f"`{text_col}`"
    ordered = (f"array_sort(filter(transform(`{spans_col}`, (s, i) -> named_struct('k', -(instr({t}, s.span) - 1), "
               f"'i', i, 'idx', instr({t}, s.span) - 1, 's', s)), x -> x.idx >= 0))")
    enc = f"upper(x.s.phi_type) IN ({_enc_types_sql()})"
    tid = (f"substring(sha2(concat_ws('|', `{secret_col}`, CAST(`{doc_col}` AS STRING), CAST(x.idx AS STRING), "
           f"x.s.span), 256), 1, 16)")
    phrase = f"try_element_at(`{phrases_col}`, x.s.span)" if phrases_col else "CAST(NULL AS STRING)"
    return (f"transform({ordered}, x -> named_struct('idx', x.idx, 'label', x.s.label, 'span', x.s.span, "
            f"'phi_type', x.s.phi_type, 'action', CASE WHEN {enc} THEN 'encrypt' ELSE 'abstract' END, "
            f"'token_id', CASE WHEN {enc} THEN {tid} END, "
            f"'replacement', CASE WHEN {enc} THEN concat('{C.ENCRYPT_MARKER}', {tid}, '{C.ENCRYPT_END}') "
            f"ELSE coalesce(nullif(x.s.abstraction_role, ''), {phrase}, '{C.REDACTED}') END, "
            f"'source', x.s.source))")


def fold_sql(text_col: str, items_col: str, all_occurrences: bool = False) -> str:
    """SQL text of ``fold_first`` over named columns."""
    new_text = ("replace(acc.text, x.span, x.replacement)" if all_occurrences else
                "overlay(acc.text PLACING x.replacement FROM instr(acc.text, x.span) FOR length(x.span))")
    rec = ("named_struct('label', x.label, 'span', x.span, 'phi_type', x.phi_type, 'action', x.action, "
           "'replacement', x.replacement, 'source', x.source)")
    return (f"aggregate(`{items_col}`, named_struct('text', `{text_col}`, 'applied', CAST(array() AS {APPLIED_TYPE})), "
            f"(acc, x) -> named_struct('text', CASE WHEN instr(acc.text, x.span) > 0 THEN {new_text} ELSE acc.text END, "
            f"'applied', CASE WHEN instr(acc.text, x.span) > 0 THEN array_append(acc.applied, {rec}) "
            f"ELSE acc.applied END))")


def routed_mask(df: DataFrame, spans_col: str, secret: Column, phrases_col: str | None = None,
                all_occurrences: bool = False, text_col: str = "text") -> DataFrame:
    """MK-1: order (SO-2), route (PRJ-1), look up replacements (JN-3), fold.

    Adds ``mask_items`` (every positioned span with its token/replacement,
    used for the vault), ``masked`` and ``spans`` (the applied ones).
    """
    # built from SQL text over named columns: one parse on the JVM instead
    # of hundreds of Python-to-JVM calls for the lambda trees
    df = df.withColumn("_secret", secret)  # subqueries cannot sit inside lambdas
    out = df.withColumn("mask_items", F.expr(items_sql(spans_col, text_col, "doc_id", "_secret", phrases_col)))
    out = out.withColumn("_fold", F.expr(fold_sql(text_col, "mask_items", all_occurrences)))
    return out.select("*", F.col("_fold.text").alias("masked"), F.col("_fold.applied").alias("spans")) \
        .drop("_fold", "_secret")


def mask_counts(spans: str = "spans") -> list[Column]:
    """PRJ-3 counts of the applied spans."""
    s = F.col(spans)
    return [
        F.size(s).alias("span_count"),
        F.size(F.filter(s, lambda x: x["action"] == "encrypt")).alias("encrypted_count"),
        F.size(F.filter(s, lambda x: x["action"] == "abstract")).alias("abstracted_count"),
    ]


def sequential_encrypt(text: Column, spans: Column, doc_id: Column, secret: Column) -> Column:
    """MK-2: encrypt a given list of span texts in list order, first live occurrence each."""
    items = F.transform(
        spans,
        lambda s, i: F.struct(
            F.lit(None).cast("string").alias("label"), s.alias("span"), F.lit(C.UNKNOWN_TYPE).alias("phi_type"),
            F.lit("encrypt").alias("action"),
            token_text(token_id(secret, doc_id, i, s)).alias("replacement"), F.lit(2).alias("source"),
        ),
    )
    return fold_first(text, items)


def regex_baseline(text: Column, hits_off: Column, doc_id: Column, secret: Column) -> Column:
    """MK-4: hits by start descending (pattern, match order on ties); each
    distinct text encrypted once at its leftmost live occurrence."""
    keyed = F.array_sort(F.transform(
        hits_off, lambda h, i: F.struct((-h["start"]).alias("k"), i.alias("i"), h["span"].alias("span"))
    ))
    from cloakline.operators.spans import first_wins
    distinct = first_wins(keyed, "struct<k:int,i:int,span:string>")
    items = F.transform(
        distinct,
        lambda x: F.struct(
            F.lit(None).cast("string").alias("label"), x["span"].alias("span"), F.lit(None).cast("string").alias("phi_type"),
            F.lit("encrypt").alias("action"),
            token_text(token_id(secret, doc_id, F.instr(text, x["span"]) - 1, x["span"])).alias("replacement"),
            F.lit(0).alias("source"),
        ),
    )
    return fold_first(text, items)["text"]


def full_encryption(text: Column, gt_texts: Column, doc_id: Column, secret: Column) -> Column:
    """MK-5: distinct truth spans found beforehand, by (position, text)
    descending, replaced at those positions.  Returns struct<masked, pred>."""
    present = F.filter(F.array_distinct(gt_texts), lambda g: (g != "") & F.contains(text, g))
    keyed = F.array_sort(F.transform(
        present, lambda g: F.struct((-(F.instr(text, g) - 1)).alias("k"), g.alias("span"))
    ), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1)
        .when(a["span"] > b["span"], -1).when(a["span"] < b["span"], 1).otherwise(0))
    items = F.transform(
        keyed,
        lambda x: F.struct(
            (-x["k"]).alias("start"), (-x["k"] + F.length(x["span"])).alias("end"), x["span"].alias("span"),
            token_text(token_id(secret, doc_id, -x["k"], x["span"])).alias("replacement"),
        ),
    )
    return F.struct(fold_at_offsets(text, items).alias("masked"), F.transform(keyed, lambda x: x["span"]).alias("pred"))
