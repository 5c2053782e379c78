"""Control-parameter table (SRC-4, SNK-7): versioned rows with defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline import constants as C


def defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(0, C.SENSITIVITY_DEFAULT, [], C.MIN_CONFIDENCE_DEFAULT)],
        "version long, sensitivity double, phi_types_focus array<string>, min_confidence double")


def load_params(spark: SparkSession, root: str | None) -> DataFrame:
    """Latest version; defaults when the table is missing or unreadable;
    missing fields of a stored row are filled from the defaults."""
    if not root:
        return defaults(spark)
    try:
        t = spark.read.parquet(root)
        v = t.agg(F.max("version")).first()[0]
    except Exception:
        return defaults(spark)
    if v is None:
        return defaults(spark)
    row = t.filter(F.col("version") == v)
    cols = set(row.columns)
    return row.select(
        F.col("version").cast("long"),
        (F.coalesce("sensitivity", F.lit(C.SENSITIVITY_DEFAULT)) if "sensitivity" in cols
         else F.lit(C.SENSITIVITY_DEFAULT)).alias("sensitivity"),
        (F.coalesce("phi_types_focus", F.array().cast("array<string>")) if "phi_types_focus" in cols
         else F.array().cast("array<string>")).alias("phi_types_focus"),
        (F.coalesce("min_confidence", F.lit(C.MIN_CONFIDENCE_DEFAULT)) if "min_confidence" in cols
         else F.lit(C.MIN_CONFIDENCE_DEFAULT)).alias("min_confidence"),
    )


PARAMS_JSON = ("struct<agent1:struct<sensitivity:double,phi_types_focus:array<string>>,"
               "agent2:struct<min_confidence_to_apply:double>>")


def load_params_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4 from the nested JSON object layout (detector and masker
    sections); defaults when the file is missing or unreadable and for
    missing fields."""
    try:
        raw = spark.read.text(path, wholetext=True)
        if raw.isEmpty():
            return defaults(spark)
    except Exception:
        return defaults(spark)
    p = raw.select(F.from_json("value", PARAMS_JSON).alias("p"))
    return p.select(
        F.lit(0).cast("long").alias("version"),
        F.coalesce(F.col("p.agent1.sensitivity"), F.lit(C.SENSITIVITY_DEFAULT)).alias("sensitivity"),
        F.coalesce(F.col("p.agent1.phi_types_focus"), F.array().cast("array<string>")).alias("phi_types_focus"),
        F.coalesce(F.col("p.agent2.min_confidence_to_apply"), F.lit(C.MIN_CONFIDENCE_DEFAULT)).alias("min_confidence"),
    )
