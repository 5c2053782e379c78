"""Span operators: detector replies (SC-1/2, FLT-1/2), merge and dedup
(ST-1, WN-6), cache misses (JN-2), learnable spans (FLT-5), skip gate (FLT-4).

All per-document span work is in-row on nested arrays (higher-order
functions), so it runs inside the scan's stage without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline import constants as C
from cloakline import schemas as S
from cloakline.functions.text import strip

SPAN_TYPE = (
    "struct<source:int,label:string,span:string,phi_type:string,abstraction_role:string,"
    "confidence:double,promoted:boolean,has_pattern:boolean>"
)

# --- FIXED VALUES: reply clean-up expressions ---
FENCE = r"```json|```"
CTRL_DROP = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
CTRL_ALL = r"[\x00-\x1f\x7f]"
STRAY_BACKSLASH = r"""\\(?!["\\/bfnrtu])"""
FIRST_ARRAY = r"(?s)(\[.*?\])"


def strip_fences(raw) -> Column:
    """SC-1: remove ```json and ``` markers, then strip."""
    return strip(F.regexp_replace(raw, FENCE, ""))


def repair_detect(raw) -> Column:
    """SC-2(a): fences off, control characters except tab/LF/CR dropped."""
    return F.regexp_replace(strip_fences(raw), CTRL_DROP, "")


def repair_critic(raw) -> Column:
    """SC-2(b): fences off, all control characters to spaces, stray backslashes doubled."""
    x = F.regexp_replace(strip_fences(raw), CTRL_ALL, " ")
    return F.regexp_replace(x, STRAY_BACKSLASH, r"\\\\")


def first_array(x) -> Column:
    """SC-2(c): the first ``[...]`` (non-greedy, across lines) when present."""
    found = F.regexp_extract(x, FIRST_ARRAY, 1)
    return F.when(found != "", found).otherwise(x)


def parse_detect(raw) -> Column:
    """Detector reply -> ARRAY<STRUCT<span, phi_type, confidence, has_pattern>>; null on bad JSON."""
    fixed = repair_detect(raw)
    return F.when(F.startswith(fixed, F.lit("[")), F.from_json(fixed, S.DETECT_REPLY))


def detector_spans(parsed: Column, text: Column, sensitivity: Column) -> Column:
    """FLT-1 + FLT-2 + PRJ-2 on a parsed reply, order kept (``pos`` = reply index)."""
    min_conf = F.lit(1.0) - sensitivity.cast("double")
    valid = F.filter(
        F.transform(F.coalesce(parsed, F.array().cast(S.DETECT_REPLY)), lambda s, i: F.struct(i.alias("pos"), s.alias("s"))),
        lambda x: x["s"].isNotNull() & x["s"]["span"].isNotNull() & x["s"]["phi_type"].isNotNull()
        & F.contains(text, x["s"]["span"])
        & (F.coalesce(x["s"]["confidence"], F.lit(C.DETECTOR_DEFAULT_CONFIDENCE)) >= min_conf),
    )
    return F.transform(
        valid,
        lambda x: F.struct(
            F.lit(1).alias("source"),
            F.lit(None).cast("string").alias("label"),
            x["s"]["span"].alias("span"),
            F.upper(x["s"]["phi_type"]).alias("phi_type"),
            F.lit(None).cast("string").alias("abstraction_role"),
            F.coalesce(x["s"]["confidence"], F.lit(C.DETECTOR_DEFAULT_CONFIDENCE)).alias("confidence"),
            F.lit(False).alias("promoted"),
            F.coalesce(x["s"]["has_pattern"], F.lit(False)).alias("has_pattern"),
        ),
    )


def hits_as_spans(hits) -> Column:
    return F.transform(
        hits,
        lambda h: F.struct(
            F.lit(0).alias("source"), h["label"].alias("label"), h["span"].alias("span"),
            h["phi_type"].alias("phi_type"), h["abstraction_role"].alias("abstraction_role"),
            h["confidence"].alias("confidence"), h["promoted"].alias("promoted"),
            F.lit(False).alias("has_pattern"),
        ),
    )


def first_wins(spans, elem_type: str = SPAN_TYPE, key: str = "span") -> Column:
    """WN-6: keep the first element of each ``key`` value (array order decides).

    The key list rides in the fold accumulator so it is built once per row.
    """
    init = F.struct(F.transform(spans, lambda s: s[key]).alias("texts"),
                    F.array().cast(f"array<{elem_type}>").alias("out"), F.lit(1).cast("long").alias("i"))

    def step(acc, s):
        keep = F.array_position(acc["texts"], s[key]) == acc["i"]
        return F.struct(acc["texts"].alias("texts"),
                        F.when(keep, F.array_append(acc["out"], s)).otherwise(acc["out"]).alias("out"),
                        (acc["i"] + 1).alias("i"))

    return F.aggregate(spans, init, step, lambda acc: acc["out"])


def first_wins_sql(arr_sql: str, elem_type: str = SPAN_TYPE, key: str = "span") -> str:
    """SQL text of ``first_wins`` (``arr_sql`` is evaluated twice: keep it cheap)."""
    return (f"aggregate({arr_sql}, named_struct('texts', transform({arr_sql}, s -> s.{key}), "
            f"'out', CAST(array() AS array<{elem_type}>), 'i', CAST(1 AS BIGINT)), "
            f"(acc, s) -> named_struct('texts', acc.texts, 'out', CASE WHEN array_position(acc.texts, s.{key}) = acc.i "
            f"THEN array_append(acc.out, s) ELSE acc.out END, 'i', acc.i + 1), acc -> acc.out)")


def merge_sql(hits_col: str, det_col: str | None = None) -> str:
    """SQL text of ``merge`` over named columns."""
    h = (f"transform(`{hits_col}`, h -> named_struct('source', 0, 'label', h.label, 'span', h.span, "
         f"'phi_type', h.phi_type, 'abstraction_role', h.abstraction_role, 'confidence', h.confidence, "
         f"'promoted', h.promoted, 'has_pattern', false))")
    if det_col is None:
        return first_wins_sql(h)
    return first_wins_sql(f"concat({h}, coalesce(`{det_col}`, CAST(array() AS array<{SPAN_TYPE}>)))")


def merge(hits, detections=None) -> Column:
    """ST-1: cache hits before detector spans, first wins by text."""
    h = hits_as_spans(hits)
    if detections is None:
        return first_wins(h)
    return first_wins(F.concat(h, F.coalesce(detections, F.array().cast(f"array<{SPAN_TYPE}>"))))


def cache_misses(hits, detections) -> Column:
    """JN-2: detector spans whose text is not among the cache-hit texts (duplicates counted)."""
    hit_texts = F.transform(hits, lambda h: h["span"])
    return F.size(F.filter(F.coalesce(detections, F.array().cast(f"array<{SPAN_TYPE}>")),
                           lambda d: ~F.array_contains(hit_texts, d["span"])))


def learnable(hits, detections) -> Column:
    """FLT-5: cache misses flagged ``has_pattern``."""
    hit_texts = F.transform(hits, lambda h: h["span"])
    return F.filter(F.coalesce(detections, F.array().cast(f"array<{SPAN_TYPE}>")),
                    lambda d: ~F.array_contains(hit_texts, d["span"]) & d["has_pattern"])


def skip_detector(hits) -> Column:
    """FLT-4: at least two promoted hits (counted, not distinct) -> skip the detector."""
    return F.size(F.filter(hits, lambda h: h["promoted"])) >= 2

