"""Critic and controller operators: validation replies (MK-14, SC-22),
reward (AG-15), parameter fold (WN-5) and the missed-type focus list (WN-4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakline import constants as C
from cloakline import schemas as S
from cloakline.operators.running import apply_step, compose, prefix_clamp, running_sums, step
from cloakline.operators.spans import repair_critic


def parse_validation(replies: DataFrame, docs: DataFrame) -> DataFrame:
    """MK-14: pivot the three reply kinds per document (one grouped pass, one join on doc_id),
    parse them with SC-2(b) repair, and fill the SC-22 defaults.

    ``docs``: (seq, doc_id, cache_hits, encrypted ARRAY<STRING>).
    The over-encryption check is skipped (accurate, nothing flagged) when
    nothing was encrypted.
    """
    # one pass over the replies: a conditional aggregate per doc_id pivots
    # the three kinds (one shuffle of the reply rows, one join); duplicate
    # replies of a kind keep the largest raw text (deterministic)
    kinds = replies.filter(F.col("kind").isin("leakage", "fluency", "overencryption")).groupBy("doc_id").agg(
        F.max(F.when(F.col("kind") == "leakage", F.col("raw"))).alias("_lk"),
        F.max(F.when(F.col("kind") == "fluency", F.col("raw"))).alias("_fl"),
        F.max(F.when(F.col("kind") == "overencryption", F.col("raw"))).alias("_oe"),
    )
    parsed = kinds.select(
        "doc_id",
        F.from_json(repair_critic(F.col("_lk")), S.LEAKAGE_REPLY).alias("lk"),
        F.from_json(repair_critic(F.col("_fl")), S.FLUENCY_REPLY).alias("fl"),
        F.from_json(repair_critic(F.col("_oe")), S.OVERENC_REPLY).alias("oe"),
    )
    j = docs.join(parsed, "doc_id", "left")
    none_enc = F.size(F.coalesce(F.col("encrypted"), F.array())) == 0
    empty = F.array().cast("array<string>")
    return j.select(
        "seq", "doc_id", "cache_hits",
        F.coalesce(F.col("lk.is_clean"), F.lit(True)).alias("is_clean"),
        F.coalesce(F.col("fl.is_fluent"), F.lit(True)).alias("is_fluent"),
        F.when(none_enc, F.lit(True)).otherwise(F.coalesce(F.col("oe.is_accurate"), F.lit(True))).alias("is_accurate"),
        F.coalesce(F.col("lk.leaked_spans"), empty).alias("leaked_spans"),
        F.when(none_enc, empty).otherwise(F.coalesce(F.col("oe.over_encrypted"), empty)).alias("over_encrypted"),
        F.coalesce(F.col("fl.fluency_score"), F.lit(C.DEFAULT_FLUENCY_SCORE)).alias("fluency_score"),
        F.coalesce(F.col("lk.confidence"), F.lit(C.DEFAULT_LEAKAGE_CONFIDENCE)).alias("leakage_confidence"),
    )


def reward_columns(v: DataFrame) -> DataFrame:
    """AG-15: breakdown entries present only when they apply; total rounded to 3."""
    correct = F.when(F.col("is_clean"), F.lit(C.REWARD_CORRECT_REDACTION))
    missed = F.when(~F.col("is_clean"), F.lit(C.REWARD_MISSED_PHI) * F.size("leaked_spans"))
    over = F.when(~F.col("is_accurate"), F.lit(C.REWARD_OVER_ENCRYPTION) * F.size("over_encrypted"))
    cache = F.when(F.col("cache_hits") > 0, F.lit(C.REWARD_CACHE_HIT) * F.col("cache_hits"))
    util = F.when(F.col("is_fluent"), F.lit(C.REWARD_UTILITY_PRESERVED))
    # insertion order of the breakdown decides the float summation order
    total = F.aggregate(F.filter(F.array(correct, missed, over, cache, util), lambda x: x.isNotNull()),
                        F.lit(0.0), lambda a, x: a + x)
    return v.select(
        "*", correct.alias("r_correct_redaction"), missed.alias("r_missed_phi"), over.alias("r_over_encryption"),
        cache.alias("r_cache_hit_bonus"), util.alias("r_utility_preserved"),
        F.round(total, 3).alias("total_reward"),
    )


def param_trace(v: DataFrame, sensitivity0: float = C.SENSITIVITY_DEFAULT,
                min_conf0: float = C.MIN_CONFIDENCE_DEFAULT, fanout: int = 256) -> DataFrame:
    """WN-5: parameter values after each validation (``seq`` dense, 0-based).

    Integer thousandths keep the arithmetic exact; each row's update is a
    clamp step and the ordered fold runs as a parallel tree scan.
    """
    leak = ~F.col("is_clean") & (F.size("leaked_spans") > 0)
    over = ~F.col("is_accurate") & (F.size("over_encrypted") > 0)
    up = step(int(round(C.SENSITIVITY_STEP * 1000)), None, int(round(C.SENSITIVITY_MAX * 1000)))
    down = step(-int(round(C.SENSITIVITY_STEP * 1000)), int(round(C.SENSITIVITY_MIN * 1000)), None)
    ident = step(0)
    s_step = compose(F.when(leak, up).otherwise(ident), F.when(over, down).otherwise(ident))
    mc_up = step(int(round(C.MIN_CONFIDENCE_UP * 1000)), None, int(round(C.MIN_CONFIDENCE_MAX * 1000)))
    mc_dn = step(-int(round(C.MIN_CONFIDENCE_DOWN * 1000)), int(round(C.MIN_CONFIDENCE_MIN * 1000)), None)
    loosen = F.col("is_clean") & (F.size("over_encrypted") == 0)
    m_step = compose(F.when(over, mc_up).otherwise(ident), F.when(loosen, mc_dn).otherwise(ident))
    base = v.select("seq", s_step.alias("s_step"), m_step.alias("m_step"))
    after = prefix_clamp(base, "seq", ["s_step", "m_step"], fanout)  # both parameters in one fold
    s_milli = apply_step(F.col("prefix_s_step"), F.lit(int(round(sensitivity0 * 1000))))
    m_milli = apply_step(F.col("prefix_m_step"), F.lit(int(round(min_conf0 * 1000))))
    return after.select("seq", (s_milli / 1000.0).alias("sensitivity"), (m_milli / 1000.0).alias("min_confidence"))


def focus_trace(v: DataFrame, spans: DataFrame) -> DataFrame:
    """WN-4: focus list after each validation.

    ``v``: (seq, doc_id, is_clean, leaked_spans); ``spans``: (doc_id, pos,
    span, phi_type) processed spans.  Types of processed spans whose text
    leaked are appended in first-seen order; a clean validation clears the
    list.  Island = running count of clean validations (skew-safe scan).

    An island's types with the place where each was first seen are one short
    list (as long as there are types); a validation's list is the part of it
    up to its own place.  The lists of the few long islands are broadcast, so
    a run without any clean validation stays spread over all tasks.
    """
    vv = v.withColumn("_clean", F.col("is_clean").cast("long"))
    isl = running_sums(vv, [], "seq", ["_clean"]).withColumnRenamed("run__clean", "island")
    leak_rows = isl.filter(~F.col("is_clean") & (F.size("leaked_spans") > 0))
    typed = leak_rows.join(spans, "doc_id").filter(F.array_contains(F.col("leaked_spans"), F.col("span"))) \
        .filter(F.col("phi_type").isNotNull() & (F.col("phi_type") != ""))
    first = typed.groupBy("island", "phi_type").agg(F.min(F.struct("seq", "pos")).alias("first"))
    lists = first.groupBy("island").agg(F.array_sort(F.collect_list(F.struct("first", "phi_type"))).alias("xs"))
    sizes = isl.groupBy("island").agg(F.count(F.lit(1)).alias("_n"))
    out = attach_lists(isl.select("seq", "is_clean", "island"), lists.join(sizes, "island"), "island", "xs")
    seen = F.filter("xs", lambda x: ~F.col("is_clean") & (x["first"]["seq"] <= F.col("seq")))
    return out.select("seq", F.coalesce(F.transform(seen, lambda x: x["phi_type"]), F.array().cast("array<string>")).alias("phi_types_focus"))


def attach_lists(rows: DataFrame, groups: DataFrame, key: str, value: str, share: int = 1000) -> DataFrame:
    """``rows`` with the column ``value`` of their group (null without one); no task gets a large group's rows.

    ``groups``: (key >= 0, value, _n = its rows), one row per key.  Keys with more than a ``share``-th of all
    rows, so at most ``share`` of them, are broadcast; their rows go to the other join under keys of their own.
    """
    least = rows.agg((F.count(F.lit(1)) / share)).scalar()
    large = groups.filter(F.col("_n") > least).select(F.col(key).alias("_large"), F.col(value).alias("_own"))
    small = groups.filter(F.col("_n") <= least).select(F.col(key).alias("_key"), F.col(value).alias("_other"))
    j = rows.join(F.broadcast(large), F.col(key) == F.col("_large"), "left")
    j = j.withColumn("_dealt", F.when(F.col("_large").isNull(), F.col(key)).otherwise(-1 - F.monotonically_increasing_id()))
    j = j.join(small, F.col("_dealt") == F.col("_key"), "left")
    return j.select(*rows.columns, F.coalesce("_own", "_other").alias(value))
