"""Pattern-memory life cycle as batch operators (MK-10, MK-11):
feedback (AG-14), promotion (WN-3), prune (FLT-6), capacity (SO-3),
insert-if-absent (ST-4), role write-back (JN-4) and stats (AG-11).

Batch semantics: a batch reads one version of the pattern table and
produces the next, pruned once at the end (documented departure).  The table
as each sentence found it, pruned after every sentence, and its growth (WN-2)
are in ``lifecycle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakline import constants as C
from cloakline.functions.text import learned_label
from cloakline.operators.running import ordinal, running_sums


def feedback_from_spans(spans: DataFrame, leaked: str = "leaked_spans", over: str = "over_encrypted") -> DataFrame:
    """FLT-8 + JN-9 input: one row per applied span with a label.

    ``spans``: (seq, doc_id, span, label, leaked_spans, over_encrypted).
    correct = span neither leaked nor over-encrypted.
    """
    return spans.filter(F.col("label").isNotNull() & (F.col("label") != "")).select(
        "seq", "label",
        (~F.coalesce(F.array_contains(F.col(leaked), F.col("span")), F.lit(False))
         & ~F.coalesce(F.array_contains(F.col(over), F.col("span")), F.lit(False))).alias("correct"),
    )


def apply_feedback(patterns: DataFrame, feedback: DataFrame, day=None, exact_prune: bool = False,
                   block: int = 1 << 16) -> DataFrame:
    """AG-14 + WN-3 + JN-9: new counters, confidence and promotion per label.

    Unknown labels are ignored (inner join).  Promotion is tested at every
    step with running counts (exact, never revoked).  Feedback order is
    ``seq`` (unique per label); the running counts are skew-safe, ``block``
    being a range of ``seq`` that one task can hold.

    ``exact_prune``: FLT-6 tested at every step as well; a label is removed
    at the first step where it qualifies, even if later feedback would
    lift it (the per-sentence behaviour).  Default: prune the final state
    once per batch (``prune``).
    """
    fb = feedback.join(patterns.select("label", F.col("hits").alias("h0"), F.col("misses").alias("m0")),
                       "label", "inner")
    fb = fb.withColumn("_h", F.col("correct").cast("long")).withColumn("_m", (~F.col("correct")).cast("long"))
    run = running_sums(fb, ["label"], "seq", ["_h", "_m"], block)
    hk = F.col("h0") + F.col("run__h")
    tk = hk + F.col("m0") + F.col("run__m")
    promo_step = (hk >= C.HIT_PROMOTE_THRESHOLD) & ((hk.cast("double") / tk) > C.PROMOTE_CONFIDENCE_ABOVE)
    prune_step = ((hk.cast("double") / tk) < C.CONFIDENCE_PRUNE_BELOW) & (tk > C.PRUNE_MIN_OBSERVATIONS)
    per_label = run.groupBy("label").agg(
        F.sum("_h").alias("d_hits"), F.sum("_m").alias("d_misses"),
        F.min(F.when(promo_step, F.col("seq"))).alias("promoted_at"),
        F.min(F.when(prune_step, F.col("seq"))).alias("pruned_at"),
    )
    j = patterns.join(per_label, "label", "left")
    if exact_prune:
        j = j.filter(F.col("pruned_at").isNull())
    touched = F.col("d_hits").isNotNull()
    hits = F.col("hits") + F.coalesce(F.col("d_hits"), F.lit(0))
    misses = F.col("misses") + F.coalesce(F.col("d_misses"), F.lit(0))
    total = hits + misses
    conf = F.when(touched, F.when(total > 0, hits.cast("double") / total).otherwise(F.lit(C.NEW_PATTERN_CONFIDENCE))) \
        .otherwise(F.col("confidence"))
    stamp = F.lit(day).cast("date") if day is not None else F.current_date()
    return j.select(
        "label", "pattern_seq", "regex", "phi_type", "abstraction_role",
        hits.alias("hits"), misses.alias("misses"), conf.alias("confidence"),
        (F.col("promoted") | F.coalesce(F.col("promoted_at").isNotNull(), F.lit(False))).alias("promoted"),
        F.when(touched, stamp).otherwise(F.col("last_updated")).alias("last_updated"),
    )


def prune(patterns: DataFrame) -> DataFrame:
    """FLT-6: drop confidence < 0.40 with more than 10 observations."""
    return patterns.filter(~((F.col("confidence") < C.CONFIDENCE_PRUNE_BELOW)
                             & ((F.col("hits") + F.col("misses")) > C.PRUNE_MIN_OBSERVATIONS)))


def cap(patterns: DataFrame, limit: int = C.MAX_MEMORY_ENTRIES) -> DataFrame:
    """SO-3: over ``limit`` rows, drop the lowest-confidence unpromoted rows
    (ties in insertion order); promoted rows are never dropped.

    What stays of the unpromoted rows are the best ``limit - promoted`` ones,
    so a distributed top-``limit`` holds them all and only those are ranked.
    """
    unpromoted = patterns.filter(~F.col("promoted"))
    best = [F.col("confidence").desc(), F.col("pattern_seq").desc()]
    top = unpromoted.orderBy(*best).limit(limit).withColumn("_rank", F.row_number().over(Window.orderBy(*best)))
    room = patterns.agg(F.lit(limit) - F.count_if("promoted")).scalar()
    kept = top.filter(F.col("_rank") <= room).select(*patterns.columns)
    return patterns.filter(F.col("promoted")).unionByName(kept)


def insert_if_absent(patterns: DataFrame, new: DataFrame) -> DataFrame:
    """ST-4: rows of ``new`` whose label is absent are appended after the
    existing ones, keeping their own order (``pattern_seq``)."""
    base = patterns.select(F.coalesce(F.max("pattern_seq"), F.lit(-1))).scalar()
    fresh = ordinal(new.join(patterns.select("label"), "label", "left_anti"), ["pattern_seq", "label"])
    fresh = fresh.withColumn("pattern_seq", (base + F.col("_ordinal")).cast("int"))
    return patterns.unionByName(fresh.select(*patterns.columns))


def write_back_roles(patterns: DataFrame, phrases: DataFrame) -> DataFrame:
    """JN-4: the first phrase becomes the role of the pattern it came from; a
    pattern that has a role keeps it.

    ``phrases``: (seq, pos, label, phrase), in the order of ``seq``, ``pos``.
    """
    first = phrases.filter(F.col("label").isNotNull()).groupBy("label").agg(
        F.min_by("phrase", F.struct("seq", "pos")).alias("_new_role"))
    return patterns.join(first, "label", "left").withColumn(
        "abstraction_role", F.coalesce(F.nullif(F.col("abstraction_role"), F.lit("")), F.col("_new_role"))).drop("_new_role")


def stats(patterns: DataFrame) -> DataFrame:
    """AG-11: total, promoted, mean confidence."""
    return patterns.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("promoted")).alias("promoted"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))


# ------------------------------------------------------------------ learning
def shape_regex(span) -> F.Column:
    """MK-10 shape of a span: digit runs -> \\d{n}, letter runs -> [A-Za-z]{n},
    whitespace runs -> \\s+, any other character escaped; word boundaries
    added where the span starts/ends with a word character."""
    pieces = F.regexp_extract_all(span, F.lit(r"\d+|[A-Za-z]+|\s+|[^\dA-Za-z\s]"), 0)
    body = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit(r"\d{"), F.length(p).cast("string"), F.lit("}")))
                                    .when(p.rlike(r"^[A-Za-z]+$"), F.concat(F.lit("[A-Za-z]{"), F.length(p).cast("string"), F.lit("}")))
                                    .when(p.rlike(r"^\s+$"), F.lit(r"\s+"))
                                    .otherwise(F.concat(F.lit("\\"), p))), "")
    head = F.when(span.rlike(r"^[\dA-Za-z]"), F.lit(r"\b")).otherwise(F.lit(""))
    tail = F.when(span.rlike(r"[\dA-Za-z]$"), F.lit(r"\b")).otherwise(F.lit(""))
    return F.concat(head, body, tail)


def learn_patterns(learnable: DataFrame, min_support: int = 2) -> DataFrame:
    """MK-10 (our definition): shapes of learnable spans with enough support
    become new unpromoted patterns at confidence 0.5; label by SC-16 from the
    first span of the shape; first label wins.

    ``learnable``: (seq, pos, span, phi_type).
    """
    shaped = learnable.withColumn("regex", shape_regex(F.col("span")))
    g = shaped.groupBy("phi_type", "regex").agg(
        F.count(F.lit(1)).alias("support"),
        F.min_by("span", F.struct("seq", "pos")).alias("first_span"),
        F.min(F.struct("seq", "pos")).alias("first_at"),
    ).filter(F.col("support") >= min_support)
    g = g.withColumn("label", learned_label(F.col("phi_type"), F.col("first_span")))
    w = Window.partitionBy("label").orderBy("first_at")
    g = g.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    g = ordinal(g.drop("_rn"), ["first_at"])
    return g.select(
        "label", (F.col("_ordinal") - 1).cast("int").alias("pattern_seq"), "regex", "phi_type",
        F.lit(None).cast("string").alias("abstraction_role"), F.lit(0).cast("long").alias("hits"),
        F.lit(0).cast("long").alias("misses"), F.lit(C.NEW_PATTERN_CONFIDENCE).alias("confidence"),
        F.lit(False).alias("promoted"), F.current_date().alias("last_updated"), "support",
    )
