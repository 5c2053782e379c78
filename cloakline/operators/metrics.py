"""Evaluation operators: exact match (JN-5, SC-10), overlap match (JN-6,
SC-11), per-type tables (AG-4, AG-5), summaries (AG-1..3, AG-6..10, AG-17),
count windows (WN-1) and attack success (JN-7, AG-16).

Per-sample work is in-row on arrays; corpus summaries are single
``groupBy`` aggregations (partial aggregation before the shuffle), and
per-type tables go through long tables so that no per-type array is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.functions import scoring as S
from cloakline.functions.text import exact_leakage, quasi_risk, shares_token, token_set, utility
from cloakline.operators.quantiles import quantiles, with_quantiles


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------- per sample
def exact_counts(gt_texts, pred_texts) -> tuple[Column, Column, Column]:
    """JN-5 / ST-2: tp, fp, fn over the distinct text sets."""
    g, p = F.array_distinct(_c(gt_texts)), F.array_distinct(_c(pred_texts))
    return F.size(F.array_intersect(g, p)), F.size(F.array_except(p, g)), F.size(F.array_except(g, p))


def with_tokens(texts) -> Column:
    """Pair every text with its token set once (lambdas re-evaluate captured expressions)."""
    return F.transform(_c(texts), lambda x: F.struct(x.alias("t"), token_set(x).alias("k")))


def _overlaps(p, g) -> Column:
    """SC-8 on pre-tokenised structs (t = text, k = token set)."""
    return (F.coalesce(F.arrays_overlap(p["k"], g["k"]), F.lit(False))
            | F.contains(g["t"], p["t"]) | F.contains(p["t"], g["t"]))


def greedy_overlap(gt_tok, pred_tok) -> Column:
    """JN-6: truth in order takes the first free prediction that overlaps.

    Inputs are ``with_tokens`` arrays held in their own columns; returns the
    used prediction indexes (0-based); tp = their count.
    """
    g, p = _c(gt_tok), _c(pred_tok)
    init = F.array().cast("array<int>")

    def take(used, gt):
        free = F.filter(F.transform(p, lambda x, j: F.struct(j.alias("j"), x.alias("x"))),
                        lambda e: ~F.array_contains(used, e["j"]) & _overlaps(e["x"], gt))
        return F.when(F.size(free) > 0, F.array_append(used, free[0]["j"])).otherwise(used)

    return F.when(F.size(p) == 0, init).otherwise(F.aggregate(g, init, take))


def overlap_tp(gt_tok, pred_tok) -> Column:
    """Matched count of JN-6; keep it in its own column (it is read six times)."""
    return F.size(greedy_overlap(gt_tok, pred_tok))


def overlap_record(gt_tok, pred_tok, tp0=None) -> Column:
    """Per-sample overlap tp/fp/fn and P/R/F1 with the SC-11 edge cases.

    ``tp0``: a column holding ``overlap_tp`` (computed in an earlier
    projection so that the fold runs once per row).
    """
    g, p = _c(gt_tok), _c(pred_tok)
    tp = _c(tp0) if tp0 is not None else overlap_tp(g, p)
    fp = F.size(p) - tp
    fn = F.size(g) - tp
    n_g, n_p = F.size(g), F.size(p)
    both = (n_g == 0) & (n_p == 0)
    tp = F.when(both | (n_p == 0) | (n_g == 0), 0).otherwise(tp)
    fp = F.when(both, 0).when(n_p == 0, 0).when(n_g == 0, n_p).otherwise(fp)
    fn = F.when(both, 0).when(n_p == 0, n_g).when(n_g == 0, 0).otherwise(fn)
    pr, rc, f1 = S.overlap_prf(n_g, n_p, tp, fp, fn)
    return F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), pr.alias("precision"),
                    rc.alias("recall"), f1.alias("f1"))


def exact_record(gt_texts, pred_texts) -> Column:
    tp, fp, fn = exact_counts(gt_texts, pred_texts)
    p, r, f = S.exact_prf(tp, fp, fn)
    return F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), p.alias("precision"),
                    r.alias("recall"), f.alias("f1"))


# ------------------------------------------------------------- per type
def type_long(df: DataFrame, spans_col: str, side: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Explode ``(span, phi_type)`` structs to distinct ``(keys, phi_type, span)`` rows."""
    return (df.select(*keys, F.explode_outer(spans_col).alias("s")).filter(F.col("s").isNotNull())
            .select(*keys, F.coalesce(F.col("s.phi_type"), F.lit("UNKNOWN")).alias("phi_type"),
                    F.col("s.span").alias("span"))
            .distinct().withColumn(side, F.lit(True)))


def per_type_exact(truth: DataFrame, pred: DataFrame, keys: tuple[str, ...] = ("doc_id",),
                   group: tuple[str, ...] = ()) -> DataFrame:
    """AG-4: full outer join of distinct (doc, type, span) on both sides, then counts."""
    j = truth.join(pred, [*keys, "phi_type", "span"], "full_outer")
    agg = j.groupBy(*group, "phi_type").agg(
        F.count_if(F.col("in_gt") & F.col("in_pred")).alias("tp"),
        F.count_if(F.col("in_pred") & F.col("in_gt").isNull()).alias("fp"),
        F.count_if(F.col("in_gt") & F.col("in_pred").isNull()).alias("fn"),
    )
    p, r, f = S.plain_prf("tp", "fp", "fn")
    return agg.select(*group, "phi_type", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"),
                      f.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def per_type_overlap(truth_lists: DataFrame, pred_lists: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """AG-5: per (keys, type) lists on both sides, JN-6 in-row, then sums.

    ``truth_lists``/``pred_lists``: ``(keys..., phi_type, texts ARRAY<STRING>)``
    with list order preserved.
    """
    j = truth_lists.withColumnRenamed("texts", "gt").join(
        pred_lists.withColumnRenamed("texts", "pred"), [*keys, "phi_type"], "full_outer")
    j = j.select(*keys, "phi_type",
                 F.expr(with_tokens_sql("coalesce(gt, CAST(array() AS array<string>))")).alias("gt"),
                 F.expr(with_tokens_sql("coalesce(pred, CAST(array() AS array<string>))")).alias("pred"))
    j = j.select("*", F.expr(overlap_tp_sql("gt", "pred")).alias("_tp0"))
    return j.select(*keys, "phi_type", F.expr(overlap_record_sql("gt", "pred", "_tp0")).alias("m"))


# ------------------------------------------------------------- summaries
def round_cols(df: DataFrame, places: int = 6) -> DataFrame:
    """Report rounding of every double column."""
    return df.select(*[F.round(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def latency_stats(df: DataFrame, latency: str, group: tuple[str, ...] = ()) -> DataFrame:
    """AG-6 / AG-7: mean, median, p95 (linear interpolation, exact), min, hit/miss means; groups of any size."""
    lat = F.col(latency)
    base = df.groupBy(*group).agg(
        F.avg(lat).alias("mean_ms"),
        F.min(lat).alias("min_ms"),
        F.coalesce(F.avg(F.when(F.col("cache_hits") > 0, lat)), F.lit(0.0)).alias("cache_hit_mean_ms"),
        F.coalesce(F.avg(F.when(F.col("cache_misses") > 0, lat)), F.lit(0.0)).alias("cache_miss_mean_ms"),
        F.count(F.lit(1)).alias("n"),
    )
    both = with_quantiles(base, quantiles(df, group, latency, [0.5, 0.95]), group, ["median_ms", "p95_ms"])
    return both.select(*group, "mean_ms", "median_ms", "p95_ms", "min_ms", "cache_hit_mean_ms", "cache_miss_mean_ms", "n")


def micro_macro(records: DataFrame) -> DataFrame:
    """AG-1/2/3/8/9 over per-sample records with tp/fp/fn/precision/recall/f1."""
    agg = records.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.avg("utility").alias("avg_utility_score"),
        F.avg("total_reward").alias("avg_reward"),
        F.avg(F.when(F.col("cache_hits") > 0, 1.0).otherwise(0.0)).alias("cache_hit_rate"),
    )
    p, r, f = S.plain_prf("tp", "fp", "fn")
    miss = S.ratio(F.col("fn"), F.col("tp") + F.col("fn"), 0.0)
    return agg.select("n_samples", "tp", "fp", "fn", "macro_precision", "macro_recall", "macro_f1",
                      p.alias("micro_precision"), r.alias("micro_recall"), f.alias("micro_f1"),
                      miss.alias("miss_rate"), "avg_utility_score", "avg_reward", "cache_hit_rate")


def security_by_system(records: DataFrame) -> DataFrame:
    """AG-10 / AG-17."""
    return records.groupBy("system").agg(
        F.avg("leakage").alias("exact_leakage"), F.avg("quasi_risk").alias("quasi_id_risk"),
        F.avg("utility").alias("utility_score"), F.count(F.lit(1)).alias("n"))


def detection_by_system(records: DataFrame) -> DataFrame:
    """AG-2 per system (macro means)."""
    return records.groupBy("system").agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def scale_windows(records: DataFrame, samples: DataFrame, size: int = 100) -> DataFrame:
    """WN-1: complete tumbling count windows in ``seq`` order per system; gaps in ``seq`` do not matter.

    Places come from the samples' ``seq`` alone (every system has every sample), so the systems run once.
    """
    from cloakline.operators.running import ordinal

    records = records.join(ordinal(samples.select("seq"), ["seq"], "_place"), "seq")
    b = F.floor((F.col("_place") - 1) / size)
    agg = records.groupBy("system", b.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("f1").alias("f1"), F.avg("latency_ms").alias("latency_ms"),
        F.avg(F.when(F.col("cache_hits") > 0, 1.0).otherwise(0.0)).alias("cache_hit_rate"))
    return agg.filter(F.col("n") == size).select(
        "system", ((F.col("bucket") + 1) * size).alias("step"), "f1", "latency_ms", "cache_hit_rate")


def recovered_tokens(gt_sets, guess_sets) -> Column:
    """JN-7 on token sets: truth spans sharing a token with some guess.

    The guess sets ride in the fold accumulator (computed once per row).
    """
    init = F.struct(_c(guess_sets).alias("g"), F.lit(0).alias("n"))
    return F.aggregate(_c(gt_sets), init, lambda acc, t: F.struct(
        acc["g"].alias("g"),
        (acc["n"] + F.when(F.exists(acc["g"], lambda q: F.coalesce(F.arrays_overlap(q, t), F.lit(False))), 1)
         .otherwise(0)).alias("n")), lambda acc: acc["n"])


# ------------------------------------------------------------- SQL-text builders
# Same semantics as the Column builders above, written as Spark SQL over
# named columns so that a query's expression tree is parsed on the JVM in
# one call (the Column builders cost hundreds of Python-to-JVM calls).
def _ws() -> str:
    from cloakline.functions.text import WHITESPACE_RUN
    return "r'" + WHITESPACE_RUN + "'"


# --- FIXED VALUES: the white space of an ASCII text, blanks aside ---
ASCII_SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x20)]))


def tokens_sql(x: str) -> str:
    """An ASCII text is split at single blanks, which needs no regex (it is compiled on every call)."""
    blanks = f"translate(lower({x}), '{ASCII_SPACE.encode('unicode_escape').decode().replace('x', 'u00')}', '{' ' * len(ASCII_SPACE)}')"
    return (f"CASE WHEN length({x}) = octet_length({x}) THEN array_remove(split({blanks}, ' ', -1), '') "
            f"ELSE filter(split(lower({x}), {_ws()}, -1), t -> t != '') END")


def with_tokens_sql(arr: str) -> str:
    return f"transform({arr}, x -> named_struct('t', x, 'k', array_distinct({tokens_sql('x')})))"


def typed_tokens_sql(spans: str) -> str:
    """``with_tokens`` of span structs, with their types."""
    return (f"transform({spans}, s -> named_struct('t', s.span, 'k', array_distinct({tokens_sql('s.span')}), "
            f"'y', coalesce(s.phi_type, 'UNKNOWN')))")


def types_sql(g: str, p: str) -> str:
    """The types of two ``typed_tokens`` lists, in the order in which they are met."""
    return f"array_distinct(concat(transform({g}, s -> s.y), transform({p}, s -> s.y)))"


def pairs_sql(g: str, p: str, types: str | None = None) -> str:
    """Both lists as a pair, then cut by each of the ``types`` (list order kept)."""
    whole = f"array(named_struct('g', {g}, 'p', {p}))"
    if types is None:
        return whole
    parts = f"transform({types}, y -> named_struct('g', filter({g}, s -> s.y = y), 'p', filter({p}, s -> s.y = y)))"
    return f"CASE WHEN {types} IS NULL THEN {whole} ELSE concat({whole}, {parts}) END"


def sizes_sql(pairs: str, types: str | None = None) -> str:
    """Lengths of both lists of every pair, with its type (null: of all spans)."""
    name = "CAST(NULL AS STRING)" if types is None else f"CASE WHEN i > 0 THEN {types}[i - 1] END"
    return f"transform({pairs}, (x, i) -> named_struct('y', {name}, 'g', size(x.g), 'p', size(x.p)))"


def typed_counts_sql(sizes: str, n: str) -> str:
    """(phi_type, tp, fp, fn) by type, of ``sizes_sql`` and the matches ``n`` of the same pairs."""
    return (f"transform(slice({sizes}, 2, size({sizes})), (x, i) -> named_struct('phi_type', x.y, 'tp', {n}[i + 1], "
            f"'fp', x.p - {n}[i + 1], 'fn', x.g - {n}[i + 1]))")


def overlap_tp_sql(g: str, p: str) -> str:
    free = (f"filter(transform({p}, (x, j) -> named_struct('j', j, 'x', x)), e -> NOT array_contains(used, e.j) "
            f"AND (coalesce(arrays_overlap(e.x.k, gt.k), false) OR contains(gt.t, e.x.t) OR contains(e.x.t, gt.t)))")
    fold = (f"aggregate({g}, CAST(array() AS array<int>), (used, gt) -> CASE WHEN size({free}) > 0 "
            f"THEN array_append(used, {free}[0].j) ELSE used END)")
    return f"size(CASE WHEN size({p}) = 0 THEN CAST(array() AS array<int>) ELSE {fold} END)"


def overlap_record_sql(g: str, p: str, tp0: str) -> str:
    return counted_record_sql(f"size({g})", f"size({p})", tp0)


def counted_record_sql(ng: str, np_: str, tp0: str) -> str:
    """``overlap_record_sql`` of the numbers of spans."""
    none, one = f"({ng} = 0 AND {np_} = 0)", f"({ng} = 0 OR {np_} = 0)"  # nothing matches an empty side: tp0 is 0
    prec = f"CASE WHEN {none} THEN 1.0D WHEN {one} THEN 0.0D ELSE CAST({tp0} AS DOUBLE) / {np_} END"
    rec = f"CASE WHEN {ng} = 0 THEN 1.0D WHEN {np_} = 0 THEN 0.0D ELSE CAST({tp0} AS DOUBLE) / {ng} END"
    f1 = f"CASE WHEN {none} THEN 1.0D WHEN {one} THEN 0.0D ELSE 2.0D * {tp0} / ({ng} + {np_}) END"
    return (f"named_struct('tp', {tp0}, 'fp', {np_} - {tp0}, 'fn', {ng} - {tp0}, 'precision', {prec}, 'recall', {rec}, "
            f"'f1', {f1})")


def quasi_sql(ot: str, ms: str) -> str:
    n_out = (f"aggregate({ot}, named_struct('e', array_except({ot}, {ms}), 'n', 0), "
             f"(acc, x) -> named_struct('e', acc.e, 'n', acc.n + CASE WHEN array_contains(acc.e, x) THEN 1 ELSE 0 END), "
             f"acc -> acc.n)")
    return f"CASE WHEN size({ot}) = 0 THEN 0.0D ELSE CAST(size({ot}) - {n_out} AS DOUBLE) / size({ot}) END"


def utility_sql(ot: str, ms: str) -> str:
    o = f"array_distinct({ot})"
    return f"CASE WHEN size({o}) = 0 THEN 1.0D ELSE CAST(size(array_intersect({o}, {ms})) AS DOUBLE) / size({o}) END"


def leakage_sql(masked: str, gt: str) -> str:
    return f"CASE WHEN exists({gt}, g -> g != '' AND contains({masked}, g)) THEN 1 ELSE 0 END"
