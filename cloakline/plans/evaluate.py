"""Evaluation and comparison jobs (3.2, 3.3, MK-12, MK-13).

Every system is a function ``samples -> (system, doc_id, seq, masked,
pred ARRAY<STRUCT<span, phi_type>>, cache_hits, cache_misses)``; systems are
unioned and scored in one job, keyed by ``(system, doc_id)``.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline import constants as C
from cloakline.functions.text import (exact_leakage, quasi_from_tokens, token_set, token_text, tokens,
                                      utility_from_tokens)
from cloakline.operators import lifecycle as LC
from cloakline.operators import mask as M
from cloakline.operators import metrics as MT
from cloakline.operators import scan as SC
from cloakline.operators import spans as SP
from cloakline.operators.matching import matched_few, matched_many
from cloakline.operators.quantiles import quantiles, with_quantiles
from cloakline.session import cut_lineage, stored
from cloakline.sources.patterns import InlinePattern, inline_patterns

LATER = 1 << 30  # place of the first learned pattern: after all of the table's own
PRED_T = "array<struct<span:string,phi_type:string>>"


def _out(df: DataFrame, system: str, masked: Column, pred: Column, hits: Column, misses: Column) -> DataFrame:
    return df.select(F.lit(system).alias("system"), "doc_id", "seq", "text", "phi_spans",
                     masked.alias("masked"), pred.cast(PRED_T).alias("pred"),
                     hits.cast("int").alias("cache_hits"), misses.cast("int").alias("cache_misses"))


def regex_system(samples: DataFrame, patterns: list[InlinePattern], secret: Column) -> DataFrame:
    """MK-4: every seed, no threshold, duplicates kept in the predictions."""
    s = SC.scan(samples, patterns, offsets=True).withColumn("_secret", secret)
    masked = M.regex_baseline(F.col("text"), F.col("hits"), F.col("doc_id"), F.col("_secret"))
    pred = F.transform("hits", lambda h: F.struct(h["span"].alias("span"), h["phi_type"].alias("phi_type")))
    return _out(s, "regex", masked, pred, F.lit(0), F.lit(0))


def full_encryption_system(samples: DataFrame, secret: Column) -> DataFrame:
    """MK-5 over the truth spans."""
    s = samples.withColumn("_secret", secret)
    r = M.full_encryption(F.col("text"), F.transform("phi_spans", lambda x: x["span"]), F.col("doc_id"),
                          F.col("_secret"))
    s = s.withColumn("_r", r)
    pred = F.transform("_r.pred", lambda x: F.struct(x.alias("span"), F.lit(C.UNKNOWN_TYPE).alias("phi_type")))
    return _out(s, "full_encryption", F.col("_r.masked"), pred, F.lit(0), F.lit(0))


def label_map(entities: DataFrame, mapped: tuple[str, ...] = ("ner",)) -> DataFrame:
    """PRJ-4: entity types of the ``mapped`` systems in this library's names, unmapped
    labels and other systems' labels kept (small fixed map, broadcast)."""
    spark = entities.sparkSession
    m = spark.createDataFrame(C.ENTITY_LABEL_MAP, "entity_type string, mapped string")
    return entities.join(F.broadcast(m), "entity_type", "left").withColumn(
        "phi_type", F.when(F.col("system").isin(*mapped), F.coalesce("mapped", "entity_type"))
        .otherwise(F.col("entity_type"))).drop("mapped")


def resolved(entities: Column) -> Column:
    """Entities without overlaps: the longest first, then the leftmost, each kept if it meets none kept before."""
    ranked = F.array_sort(F.transform(entities, lambda e: F.struct(
        (e["start"] - e["end"]).alias("rank"), e["start"].alias("start"), e["end"].alias("end"), e["phi_type"].alias("phi_type"))))
    kept = F.aggregate(ranked, F.filter(ranked, lambda e: F.lit(False)), lambda done, e: F.when(
        F.exists(done, lambda k: (k["start"] < e["end"]) & (e["start"] < k["end"])), done).otherwise(F.array_append(done, e)))
    return F.reverse(F.array_sort(F.transform(kept, lambda e: F.struct(
        e["start"].alias("start"), e["end"].alias("end"), e["phi_type"].alias("phi_type")))))


def offsets_system(samples: DataFrame, entities: DataFrame, secret: Column, systems: tuple[str, ...] = ("ner",),
                   mapped: tuple[str, ...] = ("ner",)) -> DataFrame:
    """MK-3: recorded entities replaced right to left at their offsets, one row per sample and system.

    Entities are grouped once per document (bounded by the document), joined on
    ``doc_id`` (a sample without entities keeps its text), and overlaps are
    resolved before anything is replaced.  Offsets outside the text are ignored.
    """
    named = label_map(entities.filter(F.col("system").isin(*systems)), mapped)
    per_doc = named.groupBy("system", "doc_id").agg(F.collect_list(F.struct("start", "end", "phi_type")).alias("_all"))
    grid = samples.withColumn("system", F.explode(F.array(*[F.lit(x) for x in systems])))
    j = grid.join(per_doc, ["system", "doc_id"], "left").withColumn("_secret", secret)
    inside = F.filter(F.coalesce("_all", F.array().cast("array<struct<start:int,end:int,phi_type:string>>")),
                      lambda e: (e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.length("text")))
    j = j.withColumn("_in", inside).withColumn("ents", resolved(F.col("_in")))
    items = F.transform("ents", lambda e: F.struct(
        e["start"].alias("start"), e["end"].alias("end"),
        token_text(M.token_id(F.col("_secret"), F.col("doc_id"), e["start"],
                              F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"]))).alias("replacement")))
    masked = M.fold_at_offsets(F.col("text"), items)
    pred = F.transform("ents", lambda e: F.struct(
        F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"]).alias("span"), e["phi_type"].alias("phi_type")))
    return j.select("system", "doc_id", "seq", "text", "phi_spans", masked.alias("masked"),
                    pred.cast(PRED_T).alias("pred"), F.lit(0).alias("cache_hits"), F.lit(0).alias("cache_misses"))


def records(outputs: DataFrame, latency: DataFrame | None = None, keep: tuple[str, ...] = (), types: bool = False) -> DataFrame:
    """Per (system, sample): overlap P/R/F1, leakage, quasi risk, utility, latency, and the columns ``keep``.

    ``types``: also the counts by type (AG-5), as a column ``by_type`` from the same tokens.
    Every text is tokenised once, in its own column, and reused; the
    expressions are built from SQL text (``metrics.*_sql``).
    """
    gt = "transform(phi_spans, s -> s.span)"
    tok = _paired(outputs, types).select("*", F.expr(MT.tokens_sql("text")).alias("_ot"),
                                         F.expr(f"array_distinct({MT.tokens_sql('masked')})").alias("_ms"))
    r = _matched(tok, "records", *keep, "system", "doc_id", "seq", "cache_hits",
                 F.expr(MT.leakage_sql("masked", gt)).alias("leakage"),
                 F.expr(MT.quasi_sql("_ot", "_ms")).alias("quasi_risk"),
                 F.expr(MT.utility_sql("_ot", "_ms")).alias("utility"))
    r = r.withColumn("_tp0", F.expr("coalesce(get(_n, 0), 0)"))
    r = r.withColumn("m", F.expr(MT.counted_record_sql("_sizes[0].g", "_sizes[0].p", "_tp0")))
    if latency is not None:
        r = r.join(latency, "doc_id", "left")
    else:
        r = r.withColumn("latency_ms", F.lit(0.0))
    return r.select(*keep, "system", "doc_id", "seq", "m.tp", "m.fp", "m.fn", "m.precision", "m.recall", "m.f1",
                    F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"), "cache_hits", "leakage",
                    "quasi_risk", "utility", *([F.expr(MT.typed_counts_sql("_sizes", "_n")).alias("by_type")] if types else []))


def _paired(outputs: DataFrame, types: bool) -> DataFrame:
    """Outputs with both sides' tokens as ``_pairs``: of all spans, then of each of their types; ``_sizes`` are their lengths."""
    tok = outputs.select("*", F.expr(MT.typed_tokens_sql("phi_spans")).alias("_gt"), F.expr(MT.typed_tokens_sql("pred")).alias("_pr"))
    if types:
        tok = tok.withColumn("_types", F.expr(MT.types_sql("_gt", "_pr")))
    tok = tok.withColumn("_pairs", F.expr(MT.pairs_sql("_gt", "_pr", "_types" if types else None)))
    return tok.withColumn("_sizes", F.expr(MT.sizes_sql("_pairs", "_types" if types else None)))


def _matched(paired: DataFrame, what: str, *columns: Column | str) -> DataFrame:
    """The ``columns`` and ``_sizes`` of ``paired`` rows, with the matches ``_n`` of their pairs.

    Rows are written without texts; of those with too many spans for the JVM the pairs are
    written too, and only these rows are taken to Python.
    """
    few = paired.withColumn("_n", matched_few("_pairs"))
    few = stored(few.select(*columns, "_sizes", "_n", F.when(F.col("_n").isNull(), F.col("_pairs")).alias("_pairs")), what)
    many = few.filter("_n IS NULL").withColumn("_n", matched_many("_pairs"))
    return few.filter("_n IS NOT NULL").unionByName(many).drop("_pairs")


def per_type_overlap(outputs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """AG-5 per (system, type): the per-type truth and prediction lists are
    cut in-row from each (system, doc) output (type union of both sides,
    list order kept), matched by JN-6 in-row, then exploded and summed with
    one partial-aggregated groupBy: no list-building shuffles or joins.
    ``samples`` is accepted for signature compatibility and not needed."""
    m = _matched(_paired(outputs.select("system", "phi_spans", "pred"), True), "types", "system")
    return type_sums(m.select("system", F.expr(MT.typed_counts_sql("_sizes", "_n")).alias("by_type")), ("system",))


def type_sums(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """AG-5 sums by type of the column ``by_type``, with P/R/F1."""
    e = rows.select(*by, F.explode_outer("by_type").alias("m")).filter(F.col("m").isNotNull())
    agg = e.groupBy(*by, F.col("m.phi_type").alias("phi_type")).agg(F.sum("m.tp").alias("tp"), F.sum("m.fp").alias("fp"), F.sum("m.fn").alias("fn"))
    from cloakline.functions.scoring import plain_prf
    p, r, f = plain_prf("tp", "fp", "fn")
    return agg.select(*by, "phi_type", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def attack(outputs: DataFrame, guesses: DataFrame | None = None) -> DataFrame:
    """MK-13: parse guess replies (SC-1/2), JN-7 recovered spans, AG-16 per system.

    ``guesses``: a reply table ``(system, doc_id, raw)`` joined on
    ``(system, doc_id)``; when None, ``outputs`` already carries ``raw``.
    """
    parse = lambda c: F.from_json(SP.first_array(SP.repair_critic(c)), "array<string>")
    if guesses is None:
        j = outputs.withColumn("g", parse(F.col("raw")))
    else:
        one = guesses.groupBy("system", "doc_id").agg(F.max("raw").alias("raw"))  # never multiply rows
        parsed = one.select("system", "doc_id", parse(F.col("raw")).alias("g"))
        j = outputs.join(parsed, ["system", "doc_id"], "left")
    gt = F.filter(F.transform("phi_spans", lambda s: s["span"]), lambda x: x.isNotNull() & (x != ""))
    g = F.filter(F.coalesce(F.col("g"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    # token sets computed once per text, in their own columns
    tok = j.select("system", "doc_id", F.transform(gt, token_set).alias("_gt"),
                   F.transform(g, token_set).alias("_g"))
    per = tok.select("system", "doc_id", MT.recovered_tokens("_gt", "_g").alias("recovered"),
                     F.size("_gt").alias("total_gt"))
    agg = per.groupBy("system").agg(F.sum("total_gt").alias("total_spans"), F.sum("recovered").alias("recovered_spans"))
    from cloakline.functions.scoring import ratio
    return agg.select("system", ratio(F.col("recovered_spans"), F.col("total_spans"), 0.0).alias("attack_success_rate"),
                      "total_spans", "recovered_spans")


def with_fallback(samples: DataFrame, outputs: DataFrame, systems: list[str]) -> DataFrame:
    """PRJ-6: a (system, sample) without output falls back to the original
    text, no predictions, zero latency (the samples once for every system,
    left-joined to the outputs)."""
    grid = samples.select(F.explode(F.array(*[F.lit(s) for s in systems])).alias("system"), "doc_id", "seq", "text", "phi_spans")
    o = outputs.select("system", "doc_id", F.col("masked").alias("_m"), F.col("pred").alias("_p"),
                       F.col("cache_hits").alias("_h"), F.col("cache_misses").alias("_x"))
    j = grid.join(o, ["system", "doc_id"], "left")
    return j.select("system", "doc_id", "seq", "text", "phi_spans",
                    F.coalesce("_m", "text").alias("masked"),
                    F.coalesce("_p", F.array().cast(PRED_T)).alias("pred"),
                    F.coalesce("_h", F.lit(0)).alias("cache_hits"), F.coalesce("_x", F.lit(0)).alias("cache_misses"),
                    F.col("_m").isNull().alias("fallback"))


#: (samples, names) -> outputs of the named systems
Builder = Callable[[DataFrame, tuple[str, ...]], DataFrame]


class Comparison:
    """UDF-2 / JN-11: named systems compared over named datasets.

    A builder is registered with the systems it serves, so that systems made
    from one scan of the samples share it.  Every (dataset, system, sample) has
    a row: where a builder fails, or leaves a sample out, it is the fallback of
    PRJ-6 (``fallback`` says so), and the other systems are compared all the same.
    """

    def __init__(self) -> None:
        self._builders: list[tuple[tuple[str, ...], Builder]] = []

    @property
    def systems(self) -> tuple[str, ...]:
        return tuple(name for names, _ in self._builders for name in names)

    def register(self, names: tuple[str, ...], builder: Builder) -> Comparison:
        if known := set(names) & set(self.systems):
            raise ValueError(f"registered already: {sorted(known)}")
        self._builders.append((tuple(names), builder))
        return self

    def outputs(self, datasets: dict[str, DataFrame], wanted: tuple[str, ...], systems: tuple[str, ...] | None = None) -> DataFrame:
        """Outputs of the ``systems`` (default: all) over the ``wanted`` datasets, with the column ``dataset`` (SNK-4).

        Names that are no dataset or no system are skipped; without any dataset left there is nothing to compare.
        """
        chosen = [x for x in dict.fromkeys(wanted) if x in datasets]
        if not chosen:
            raise ValueError(f"no such dataset: {', '.join(wanted) or 'none given'}")
        out = None
        for dataset in chosen:
            samples, made = datasets[dataset], []
            for names, builder in self._builders:
                asked = tuple(x for x in names if systems is None or x in systems)
                if asked:
                    try:
                        made.append(builder(samples, asked).select("system", "doc_id", "masked", "pred", "cache_hits", "cache_misses"))
                    except Exception as failed:  # one system's failure is its own: its samples fall back
                        warnings.warn(f"{', '.join(asked)} on {dataset}: {failed}", stacklevel=2)
            names = [x for x in self.systems if systems is None or x in systems]
            if not made:
                made = [samples.select(F.lit("").alias("system"), "doc_id", F.col("text").alias("masked"), F.array().cast(PRED_T).alias("pred"),
                                       F.lit(0).alias("cache_hits"), F.lit(0).alias("cache_misses")).limit(0)]
            done = with_fallback(samples, reduce(DataFrame.unionByName, made), names).withColumn("dataset", F.lit(dataset))
            out = done if out is None else out.unionByName(done)
        return out


def benchmark_tables(outputs: DataFrame, latency: DataFrame | None = None,
                     wanted: tuple[str, ...] = ("detection", "latency", "security", "per_type")) -> dict[str, DataFrame]:
    """SNK-4: the detection, latency, security and per-type tables by dataset and system, for ``sinks.write_benchmark``."""
    # the systems run once: every wanted table, that by type too, is made from the scored rows
    types = "per_type" in wanted
    rec = records(outputs, latency, ("dataset", "fallback"), types)
    if len(wanted) > 1 or "latency" in wanted:  # read several times
        rec = stored(rec, "scored")
    by = ("dataset", "system")
    detection = rec.groupBy(*by).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.count(F.lit(1)).alias("n"), F.count_if("fallback").alias("n_fallback"))
    security = rec.groupBy(*by).agg(F.avg("leakage").alias("exact_leakage"), F.avg("quasi_risk").alias("quasi_id_risk"),
                                    F.avg("utility").alias("utility_score"))
    timed = rec.groupBy(*by).agg(F.avg("latency_ms").alias("mean_ms"), F.min("latency_ms").alias("min_ms"))
    timed = with_quantiles(timed, quantiles(rec, by, "latency_ms", [0.5, 0.95]), by, ["median_ms", "p95_ms"])
    tables = {"detection": detection, "latency": timed, "security": security}
    if types:
        tables["per_type"] = type_sums(rec, by)
    return {k: tables[k] for k in wanted}


def systems_wide(samples: DataFrame, secret: Column, names: tuple[str, ...],
                 seed_patterns: list[InlinePattern], min_confidence: float = 0.75, detector: bool = False) -> DataFrame:
    """Row-local systems (cold, warm, regex, full_encryption) from ONE scan of
    the samples: each system is a struct column of the same projection, then
    the row is unpivoted into one row per system (``explode`` of a fixed-size
    array).  Cold and regex share the seed scan; cold's FLT-3 threshold is a
    filter on the hit array (order kept).

    ``detector``: the samples carry ``detections``, which cold and warm merge
    after their hits and count as misses where no hit has their text (MK-12).
    Warm takes its hits from the samples' column ``warm_hits`` (``warm_hits``).
    """
    s = samples.withColumn("_secret", secret)
    if "cold" in names or "regex" in names:
        s = SC.scan(s, seed_patterns, offsets="regex" in names, out="_hoff")  # only regex asks where the hits are
    text, doc, sec = F.col("text"), F.col("doc_id"), F.col("_secret")
    found = "detections" if detector else None

    def pred_of(applied):
        return F.transform(applied, lambda a: F.struct(a["span"].alias("span"), a["phi_type"].alias("phi_type")))

    def mask_system(df, name):
        # merge -> order/route/replace -> fold, each a named column built from SQL text
        df = df.withColumn(f"_{name}_merged", F.expr(SP.merge_sql(f"_{name}_hits", found)))
        df = df.withColumn(f"_{name}_items", F.expr(M.items_sql(f"_{name}_merged", "text", "doc_id", "_secret", None)))
        return df.withColumn(f"_{name}_fold", F.expr(M.fold_sql("text", f"_{name}_items")))

    def pipeline(name):
        misses = SP.cache_misses(F.col(f"_{name}_hits"), F.col(found)) if found else F.lit(0)
        return F.col(f"_{name}_fold.text"), pred_of(F.col(f"_{name}_fold.applied")), F.size(f"_{name}_hits"), misses

    cols = {}
    if "cold" in names:
        s = s.withColumn("_cold_hits", F.filter("_hoff", lambda h: h["confidence"] >= F.lit(float(min_confidence))))
        s = mask_system(s, "cold")
        cols["cold"] = pipeline("cold")
    if "warm" in names:
        s = mask_system(s.withColumn("_warm_hits", F.coalesce("warm_hits", F.array().cast(SC.HIT_TYPE))), "warm")
        cols["warm"] = pipeline("warm")
    if "regex" in names:
        pred = F.transform("_hoff", lambda h: F.struct(h["span"].alias("span"), h["phi_type"].alias("phi_type")))
        cols["regex"] = (M.regex_baseline(text, F.col("_hoff"), doc, sec), pred, F.lit(0), F.lit(0))
    if "full_encryption" in names:
        r = M.full_encryption(text, F.transform("phi_spans", lambda x: x["span"]), doc, sec)
        pred = F.transform(r["pred"], lambda x: F.struct(x.alias("span"), F.lit(C.UNKNOWN_TYPE).alias("phi_type")))
        cols["full_encryption"] = (r["masked"], pred, F.lit(0), F.lit(0))
    arr = F.array(*[F.struct(F.lit(k).alias("system"), m.alias("masked"), p.cast(PRED_T).alias("pred"),
                             h.cast("int").alias("cache_hits"), x.cast("int").alias("cache_misses")) for k, (m, p, h, x) in cols.items()])
    return s.select("doc_id", "seq", "text", "phi_spans", F.explode(arr).alias("o")).select(
        F.col("o.system").alias("system"), "doc_id", "seq", "text", "phi_spans", F.col("o.masked").alias("masked"),
        F.col("o.pred").alias("pred"), F.col("o.cache_hits").alias("cache_hits"), F.col("o.cache_misses").alias("cache_misses"))


def warm_hits(samples: DataFrame, table: DataFrame, learned: DataFrame, sightings: DataFrame, feedback: DataFrame,
              min_confidence: float) -> DataFrame:
    """(doc_id, hits): what each sample finds with the patterns as they were before it (FLT-3 as of the sample).

    ``table``: the patterns before the first sample; ``learned``: those that sightings insert on the way.
    The texts are scanned once, for all patterns that ever are; the hits, without the texts, are written,
    and the labels that change along the samples are asked for their state at each sample that they hit.
    """
    # every pattern that ever is, in the order of insertion: ST-4 without a new table
    fresh = learned.join(table.select("label"), "label", "left_anti").withColumn("pattern_seq", F.col("pattern_seq") + F.lit(LATER))
    inline = sorted(inline_patterns(table.unionByName(fresh.select(*table.columns))), key=lambda p: p.place)
    inline = [replace(p, rank=k + 1) for k, p in enumerate(inline)]
    hits = cut_lineage(SC.scan(samples.select("doc_id", "seq", "text"), inline).select("doc_id", "seq", "hits"))
    told = {r.label for r in feedback.select("label").unionByName(sightings.select("label")).distinct().collect()}
    moving = [p.label for p in inline if p.label in told]
    asked = F.filter(F.array_distinct(F.transform("hits", lambda h: h["label"])), lambda x: x.isin(moving))
    trace = LC.replay(table, sightings, feedback, hits.select("seq", F.explode(asked).alias("label")))
    return LC.as_of(hits, trace, min_confidence)


def per_type_exact(outputs: DataFrame) -> DataFrame:
    """AG-4 in-row: per sample and type, distinct truth and predicted texts;
    tp/fp/fn from set intersection and differences, then one partial-
    aggregated groupBy(phi_type).  (``metrics.per_type_exact`` is the
    long-table form for stored span tables.)"""
    ty = "coalesce(s.phi_type, 'UNKNOWN')"
    cut = (f"transform(array_distinct(concat(transform(phi_spans, s -> {ty}), transform(pred, s -> {ty}))), "
           f"t -> named_struct('phi_type', t, "
           f"'g', array_distinct(transform(filter(phi_spans, s -> {ty} = t), s -> s.span)), "
           f"'p', array_distinct(transform(filter(pred, s -> {ty} = t), s -> s.span))))")
    e = outputs.select(F.explode_outer(F.expr(cut)).alias("c")).filter(F.col("c").isNotNull())
    e = e.select(F.col("c.phi_type").alias("phi_type"),
                 F.size(F.array_intersect("c.g", "c.p")).alias("tp"),
                 F.size(F.array_except("c.p", "c.g")).alias("fp"),
                 F.size(F.array_except("c.g", "c.p")).alias("fn"))
    agg = e.groupBy("phi_type").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    from cloakline.functions.scoring import plain_prf
    p, r, f = plain_prf("tp", "fp", "fn")
    return agg.select("phi_type", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"),
                      (F.col("tp") + F.col("fn")).alias("support"))
