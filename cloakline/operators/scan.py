"""Pattern scan (JN-1) with offsets (SC-3) and per-document hit counters.

Each pattern becomes one literal ``regexp_extract_all`` expression, so the
regex is compiled once per task, documents are never shuffled or joined,
and the same projection serves batch and streaming plans.  Hits are a
nested ``ARRAY<STRUCT>`` in pattern rank order (SO-1), then match order,
which is the order the merge (WN-6) relies on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.sources.patterns import InlinePattern

HIT_TYPE = (
    "array<struct<pattern_rank:int,label:string,span:string,phi_type:string,"
    "abstraction_role:string,promoted:boolean,confidence:double>>"
)
HIT_OFFSET_TYPE = (
    "array<struct<pattern_rank:int,label:string,span:string,phi_type:string,"
    "abstraction_role:string,promoted:boolean,confidence:double,start:int,end:int>>"
)


def _meta(p: InlinePattern) -> list[Column]:
    return [
        F.lit(p.rank).cast("int").alias("pattern_rank"),
        F.lit(p.label).alias("label"),
        F.lit(p.phi_type).alias("phi_type"),
        F.lit(p.abstraction_role).cast("string").alias("abstraction_role"),
        F.lit(p.promoted).alias("promoted"),
        F.lit(p.confidence).cast("double").alias("confidence"),
    ]


def _order(fields: list[Column], span: Column, extra: list[Column] | None = None) -> Column:
    # field order fixed: rank, label, span, type, role, promoted, confidence[, start, end]
    return F.struct(fields[0], fields[1], span.alias("span"), *fields[2:], *(extra or []))


# Patterns per projection when a list is long (keeps each expression and its
# generated code of a manageable size; order across chunks is kept).
CHUNK = 1000

# Prefilter flags, computed once per row in their own projection.  A
# pattern whose required character is absent cannot match, so its regex
# is skipped (exact: the skipped call would return an empty array).
FLAG_COLS = {"digit": "_has_digit", "at": "_has_at"}


def with_flags(df: DataFrame, text_col: str, patterns: list[InlinePattern]) -> DataFrame:
    needed = {p.requires for p in patterns if p.requires}
    text = F.col(text_col)
    if "digit" in needed:
        df = df.withColumn(FLAG_COLS["digit"], F.coalesce(text.rlike("[0-9]"), F.lit(False)))
    if "at" in needed:
        df = df.withColumn(FLAG_COLS["at"], F.coalesce(F.instr(text, "@") > 0, F.lit(False)))
    return df


def _gated(p: InlinePattern, expr: Column, empty_type: str, gated: bool) -> Column:
    if gated and p.requires in FLAG_COLS:
        return F.when(F.col(FLAG_COLS[p.requires]), expr).otherwise(F.array().cast(empty_type))
    return expr


def _raw(s: str | None) -> str | None:
    """Spark SQL raw string literal, or None when it cannot carry the text."""
    if s is None:
        return "CAST(NULL AS STRING)"
    if "'" in s or s.endswith("\\"):
        return None
    return "r'" + s + "'"


def hits_sql(text_col: str, patterns: list[InlinePattern], gated: bool) -> str | None:
    """The hits expression as one SQL text (parsed JVM-side in a single call,
    instead of hundreds of Python-to-JVM calls for the Column tree).  None
    when a pattern text cannot be written as a raw literal."""
    parts = []
    for p in patterns:
        rx, label, typ, role = _raw(p.regex), _raw(p.label), _raw(p.phi_type), _raw(p.abstraction_role)
        if None in (rx, label, typ, role):
            return None
        e = (f"transform(regexp_extract_all(`{text_col}`, {rx}, 0), m -> named_struct("
             f"'pattern_rank', {int(p.rank)}, 'label', {label}, 'span', m, 'phi_type', {typ}, "
             f"'abstraction_role', CAST({role} AS STRING), 'promoted', {str(bool(p.promoted)).lower()}, "
             f"'confidence', CAST({float(p.confidence)!r} AS DOUBLE)))")
        if gated and p.requires in FLAG_COLS:
            e = f"CASE WHEN `{FLAG_COLS[p.requires]}` THEN {e} ELSE CAST(array() AS {HIT_TYPE}) END"
        parts.append(e)
    return "concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]


def hits_expr(text: Column, patterns: list[InlinePattern], gated: bool = False,
              text_col: str | None = None) -> Column:
    """All non-overlapping matches of every pattern, rank order then match order.

    ``gated``: the prefilter flag columns of ``with_flags`` are present.
    ``text_col``: when the text is a plain column, the expression is built
    from SQL text in one call.
    """
    if not patterns:
        return F.array().cast(HIT_TYPE)
    if text_col is not None:
        sql = hits_sql(text_col, patterns, gated)
        if sql is not None:
            return F.expr(sql)

    def one(p: InlinePattern) -> Column:
        meta = _meta(p)
        e = F.transform(F.regexp_extract_all(text, F.lit(p.regex), 0), lambda m: _order(meta, m))
        return _gated(p, e, HIT_TYPE, gated)

    parts = [one(p) for p in patterns]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _offsets(text: Column, p: InlinePattern) -> Column:
    """SC-3: matches with 0-based [start, end) code-point offsets.

    ``split`` yields the gaps between matches and ``regexp_extract_all`` the
    matches; a fold over (gap, match) pairs turns lengths into offsets.
    """
    ms = F.regexp_extract_all(text, F.lit(p.regex), 0)
    gaps = F.split(text, p.regex, -1)
    # gaps has one more element than matches; sizing by gaps avoids a
    # second evaluation of the match array (no CSE inside this expression)
    pairs = F.arrays_zip(ms.alias("m"), F.slice(gaps, 1, F.size(gaps) - 1).alias("g"))
    init = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<m:string,s:int>>").alias("out"))

    def step(acc, x):
        start = acc["pos"] + F.length(x["g"])
        return F.struct(
            (start + F.length(x["m"])).alias("pos"),
            F.array_append(acc["out"], F.struct(x["m"].alias("m"), start.alias("s"))).alias("out"),
        )

    located = F.aggregate(pairs, init, step)["out"]
    return F.transform(
        located,
        lambda e: _order(_meta(p), e["m"], [e["s"].alias("start"), (e["s"] + F.length(e["m"])).alias("end")]),
    )


def offsets_sql(text_col: str, patterns: list[InlinePattern], gated: bool) -> str | None:
    """SQL text of ``hits_with_offsets_expr`` (same fold as ``_offsets``)."""
    parts = []
    t = f"`{text_col}`"
    for p in patterns:
        rx, label, typ, role = _raw(p.regex), _raw(p.label), _raw(p.phi_type), _raw(p.abstraction_role)
        if None in (rx, label, typ, role):
            return None
        # a split compiles its regex on every call: only texts with matches are split, and once
        pairs = (f"zip_with(ms, transform(array(split({t}, {rx}, -1)), gaps -> slice(gaps, 1, size(gaps) - 1))[0], "
                 f"(m, g) -> named_struct('m', m, 'g', g))")
        none = "CAST(array() AS array<struct<m:string,s:int>>)"
        fold = (f"transform(array(regexp_extract_all({t}, {rx}, 0)), ms -> CASE WHEN size(ms) = 0 THEN {none} ELSE "
                f"aggregate({pairs}, named_struct('pos', 0, 'out', {none}), "
                f"(acc, x) -> named_struct('pos', acc.pos + length(x.g) + length(x.m), 'out', "
                f"array_append(acc.out, named_struct('m', x.m, 's', acc.pos + length(x.g))))).out END)[0]")
        e = (f"transform({fold}, e -> named_struct('pattern_rank', {int(p.rank)}, 'label', {label}, 'span', e.m, "
             f"'phi_type', {typ}, 'abstraction_role', CAST({role} AS STRING), "
             f"'promoted', {str(bool(p.promoted)).lower()}, 'confidence', CAST({float(p.confidence)!r} AS DOUBLE), "
             f"'start', e.s, 'end', e.s + length(e.m)))")
        if gated and p.requires in FLAG_COLS:
            e = f"CASE WHEN `{FLAG_COLS[p.requires]}` THEN {e} ELSE CAST(array() AS {HIT_OFFSET_TYPE}) END"
        parts.append(e)
    return "concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]


def hits_with_offsets_expr(text: Column, patterns: list[InlinePattern], gated: bool = False,
                           text_col: str | None = None) -> Column:
    if not patterns:
        return F.array().cast(HIT_OFFSET_TYPE)
    if text_col is not None:
        sql = offsets_sql(text_col, patterns, gated)
        if sql is not None:
            return F.expr(sql)
    parts = [_gated(p, _offsets(text, p), HIT_OFFSET_TYPE, gated) for p in patterns]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def scan(docs: DataFrame, patterns: list[InlinePattern], text_col: str = "text",
         offsets: bool = False, out: str = "hits") -> DataFrame:
    """Adds ``hits`` (nested) and ``cache_hits`` (AG-18, counted before dedup)."""
    text = F.col(text_col)
    flagged = with_flags(docs, text_col, patterns)
    build = hits_with_offsets_expr if offsets else hits_expr
    chunks = [patterns[i:i + CHUNK] for i in range(0, len(patterns), CHUNK)] or [[]]
    if len(chunks) == 1:
        res = flagged.withColumn(out, build(text, patterns, True, text_col))
    else:
        # long pattern lists: one column per chunk (rank order kept), then concat
        names = [f"_{out}_{i}" for i in range(len(chunks))]
        for n, ch in zip(names, chunks):
            flagged = flagged.withColumn(n, build(text, ch, True, text_col))
        res = flagged.withColumn(out, F.concat(*[F.col(n) for n in names])).drop(*names)
    res = res.withColumn("cache_hits", F.size(F.col(out)))
    return res.drop(*[c for c in FLAG_COLS.values() if c in res.columns and c not in docs.columns])


def hits_long(docs: DataFrame, patterns: list[InlinePattern], text_col: str = "text",
              keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The long ``hits`` table: one row per match with offsets (no shuffle)."""
    cols = list(keep) + ([text_col] if text_col not in keep else [])
    scanned = scan(docs.select(*cols), patterns, text_col, offsets=True, out="_h")
    # outer generator: a plain one makes the optimizer add size(h) > 0 below the
    # repartition, evaluating the whole scan twice
    exploded = scanned.select(*keep, F.posexplode_outer("_h").alias("hit_pos", "hit")).filter("hit_pos IS NOT NULL")
    return exploded.select(*keep, "hit_pos", "hit.*")
