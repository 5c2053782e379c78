"""Pattern tables: seed rows (SRC-7), load (SRC-3), validation (FLT-9), order (SO-1).

The pattern table is small by construction: the capacity rule (SO-3) keeps
at most ``MAX_MEMORY_ENTRIES`` unpromoted rows.  Scans inline the patterns
as literal regex expressions (chunked for long lists), so the table is read
once on the driver instead of being joined.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakline import constants as C
from cloakline.schemas import PATTERNS



@dataclass(frozen=True)
class InlinePattern:
    rank: int
    label: str
    regex: str
    phi_type: str
    abstraction_role: str | None
    promoted: bool
    confidence: float
    requires: str | None = None  # exact prefilter hint ("digit" / "at"), see constants.SEED_REQUIRES
    place: int = 0  # insertion order (pattern_seq)


_SEED_REGEX = {label: rx for label, rx, _t, _r in C.SEED_PATTERNS}


def requirement(label: str, regex: str) -> str | None:
    """Prefilter hint for a pattern: only for an unmodified seed regex."""
    if _SEED_REGEX.get(label) == regex:
        return C.SEED_REQUIRES.get(label)
    return None


def seed_patterns(spark: SparkSession) -> DataFrame:
    """SRC-7: the seed rows with fixed counters, in insertion order."""
    day = _dt.date.fromisoformat(C.SEED_DATE)
    rows = [
        (label, i, regex, phi_type, role, C.SEED_HITS, C.SEED_MISSES, C.SEED_CONFIDENCE, C.SEED_PROMOTED, day)
        for i, (label, regex, phi_type, role) in enumerate(C.SEED_PATTERNS)
    ]
    return spark.createDataFrame(rows, PATTERNS)


def load_patterns(spark: SparkSession, path: str | None, fmt: str = "parquet") -> DataFrame:
    """SRC-3: read a pattern table; an empty table when the path is absent."""
    if not path:
        return spark.createDataFrame([], PATTERNS)
    try:
        return spark.read.schema(PATTERNS).format(fmt).load(path)
    except Exception as exc:  # missing path
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], PATTERNS)
        raise


def with_validity(patterns: DataFrame) -> DataFrame:
    """FLT-9: flag regexes Java cannot compile and regexes that match ''.

    ``try_reflect`` runs ``Pattern.matches(regex, '')`` on the executors:
    null means the regex does not compile, 'true' means it accepts the
    empty string (which would make match offsets ambiguous).  Regexes such as
    ``\\b`` that match no characters inside a text are found with a sample text.
    """
    probe = F.expr("try_reflect('java.util.regex.Pattern', 'matches', regex, '')")
    # a match of no characters leaves as much text after it as before it (regexes with back references aside)
    inside = F.when(~F.col("regex").rlike(r"\\[1-9]"), F.expr(
        r"""try_reflect('java.util.regex.Pattern', 'matches', concat('(?s)(.*)(?=(.*)$)(?:', regex, ')(?=\\2$).*'), 'Ab 1-2.')"""))
    patterns = patterns.withColumn("_inside", inside)
    return patterns.withColumn("_probe", probe).withColumn(
        "reject_reason",
        F.when(F.col("regex").isNull(), F.lit("null regex"))
        .when(F.col("_probe").isNull(), F.lit("does not compile"))
        .when((F.col("_probe") == "true") | (F.col("_inside") == "true"), F.lit("matches empty string")),
    ).drop("_probe", "_inside")


def valid_patterns(patterns: DataFrame) -> DataFrame:
    return with_validity(patterns).filter(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantine(patterns: DataFrame) -> DataFrame:
    """Rejected rows with their reason (written to ``patterns_quarantine``)."""
    return with_validity(patterns).filter(F.col("reject_reason").isNotNull())


def inline_patterns(patterns: DataFrame, min_confidence: float | None = None,
                    engine: str = "jvm") -> list[InlinePattern]:
    """FLT-3 + FLT-9 + SO-1, then the bounded driver read used by the scan.

    The threshold is applied on the pattern side *before* the scan, so
    documents never see a pattern below it.  When the table has an
    ``engine`` column, rows marked ``'py'`` (features Java regexes lack) are
    left to the Python scanner (UDF-3, ``hooks.python_scan``) and skip the
    Java validation; ``engine='py'`` selects exactly those rows.
    """
    if "engine" in patterns.columns:
        is_py = F.coalesce(F.col("engine"), F.lit("jvm")) == "py"
        patterns = patterns.filter(is_py if engine == "py" else ~is_py)
    elif engine == "py":
        return []
    df = valid_patterns(patterns) if engine != "py" else patterns
    if min_confidence is not None:
        df = df.filter(F.col("confidence") >= F.lit(float(min_confidence)))
    df = df.select("label", "regex", "phi_type", "abstraction_role", "promoted", "confidence", "pattern_seq")
    # the pattern table is config-sized (SO-3 keeps <= 200 unpromoted rows);
    # any size is handled exactly: the scan splits long lists into chunks
    rows = df.collect()
    rows.sort(key=lambda r: (not r["promoted"], -r["confidence"], r["pattern_seq"]))
    return [
        InlinePattern(i + 1, r["label"], r["regex"], r["phi_type"], r["abstraction_role"],
                      bool(r["promoted"]), float(r["confidence"]), requirement(r["label"], r["regex"]), r["pattern_seq"])
        for i, r in enumerate(rows)
    ]


def seed_inline(min_confidence: float | None = None) -> list[InlinePattern]:
    """The seed rows as inline patterns without a Spark round trip (all valid)."""
    out = []
    for i, (label, regex, phi_type, role) in enumerate(C.SEED_PATTERNS):
        if min_confidence is not None and C.SEED_CONFIDENCE < min_confidence:
            continue
        out.append(InlinePattern(len(out) + 1, label, regex, phi_type, role, C.SEED_PROMOTED, C.SEED_CONFIDENCE,
                                 requirement(label, regex)))
    return out


PATTERN_JSON_ENTRY = (
    "map<string,struct<regex:string,phi_type:string,abstraction_role:string,hits:bigint,misses:bigint,"
    "confidence:double,promoted:boolean,last_updated:string>>"
)


def load_pattern_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3 from the label -> entry JSON object layout.

    The file is one JSON object (a pattern table, bounded by its capacity
    rule) read as whole text; entries keep the object's order, which becomes
    ``pattern_seq`` (the insertion order SO-1 breaks ties with).  A missing
    file gives an empty table.
    """
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], PATTERNS)
        raise
    m = raw.select(F.from_json("value", PATTERN_JSON_ENTRY).alias("m"))
    e = m.select(F.posexplode_outer("m").alias("pos", "label", "v")).filter(F.col("pos").isNotNull())
    return e.select(
        "label", F.col("pos").cast("int").alias("pattern_seq"), F.col("v.regex").alias("regex"),
        F.col("v.phi_type").alias("phi_type"), F.col("v.abstraction_role").alias("abstraction_role"),
        F.coalesce("v.hits", F.lit(0)).cast("long").alias("hits"),
        F.coalesce("v.misses", F.lit(0)).cast("long").alias("misses"),
        F.coalesce("v.confidence", F.lit(C.NEW_PATTERN_CONFIDENCE)).alias("confidence"),
        F.coalesce("v.promoted", F.lit(False)).alias("promoted"),
        F.to_date("v.last_updated").alias("last_updated"),
    )
