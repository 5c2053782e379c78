"""Report and state sinks (SNK-1 .. SNK-8).

All writers are distributed DataFrame writes; nothing is assembled on the
driver.  State tables are versioned folders (``version=N``) written with
overwrite mode, so a retried job rewrites the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """SNK-1 / SNK-3: CSV with a header row."""
    w = df.write.mode("overwrite").option("header", "true")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def write_summary(path: str, summary: DataFrame, latency: DataFrame, per_type: DataFrame,
                  growth: DataFrame) -> None:
    """SNK-2: one JSON row: scalar summary, latency struct, per-type and growth arrays.

    The per-type and growth tables are small aggregates (bounded by the type
    vocabulary and the number of snapshots); they are nested with
    ``collect_list`` inside Spark.
    """
    pt = per_type.agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("support")).alias("_k"), *[F.col(c) for c in per_type.columns]))).alias("_pt"))
    pt = pt.select(F.transform("_pt", lambda x: x.dropFields("_k")).alias("per_type"))
    gr = growth.agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in growth.columns]))).alias("memory_growth"))
    lat = latency.select(F.struct(*[F.col(c) for c in latency.columns]).alias("latency"))
    # one-row pieces attached as scalar subqueries (each returns exactly one row)
    out = summary.select("*", lat.scalar().alias("latency"), pt.scalar().alias("per_type"),
                         gr.scalar().alias("memory_growth"))
    out.coalesce(1).write.mode("overwrite").json(path)


def write_benchmark(tables: dict[str, DataFrame], root: str, dataset_col: str = "dataset") -> list[str]:
    """SNK-4: one folder per table, partitioned by dataset; empty tables skipped."""
    written = []
    for name, df in tables.items():
        if df.isEmpty():
            continue
        w = df.write.mode("overwrite").option("header", "true")
        if dataset_col in df.columns:
            w = w.partitionBy(dataset_col)
        w.csv(f"{root}/benchmark_{name}")
        written.append(name)
    return written


def write_attack(summary: DataFrame, per_sample: DataFrame, root: str, first_n: int = 20) -> None:
    """SNK-5: summary CSV and JSON of the first ``first_n`` samples (SO-6)."""
    write_csv(summary, f"{root}/attack_summary")
    per_sample.filter(F.col("seq") < first_n).write.mode("overwrite").json(f"{root}/attack_samples")


def save_patterns(patterns: DataFrame, root: str, version: int) -> None:
    """SNK-6: one overwrite per batch into a new version folder."""
    patterns.write.mode("overwrite").parquet(f"{root}/version={version}")


def save_params(params: DataFrame, root: str, version: int) -> None:
    """SNK-7: append a parameter version (idempotent per version)."""
    params.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{root}/version={version}")


def export_vault(vault: DataFrame, path: str) -> None:
    """SNK-8 export; import is ``operators.vault.import_vault`` (ST-5)."""
    vault.write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "doc_id", path: str | None = None) -> None:
    """Co-located storage: the masked table and the vault written bucketed by
    ``doc_id`` with the same bucket count make the restore join (and its
    per-document grouping) shuffle-free."""
    w = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
