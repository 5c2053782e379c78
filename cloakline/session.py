"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "cloakline") -> SparkSession:
    """Session with AQE on and the UI off; reuses an active session if any."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CLOAKLINE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SCRATCH: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The setting is read from the session (it cannot be changed at run time).
    Only when it is absent (tests, local runs) a scratch folder is created
    once per application.  The returned base path is stable across restarts
    when configured, which streaming checkpoints rely on; the SparkContext
    is pointed at it for ``DataFrame.checkpoint``.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        base = configured
    elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
    else:
        base = _SCRATCH.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="cloakline-ckpt-"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """As ``cut_lineage``, as a Parquet table in the shared folder: small, and readers take only the columns they use."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin split an input that arrives in fewer splits than the
    cluster has cores (a small single-row-group file); inputs that already
    arrive in enough splits (the normal case at scale) are left alone, so
    no shuffle is added there."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def scale_conf(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 128 << 20,
               scan_split_bytes: int = 64 << 20) -> dict[str, str]:
    """Size shuffles and splits from the input volume (spill-aware defaults).

    * shuffle partitions = input / target size (at least 200), so a shuffle
      of the whole corpus (a ``doc_id`` join) keeps ~128 MB per task; AQE
      coalesces small ones and splits skewed ones;
    * scan splits of 64 MB: the pattern scan is CPU-bound (regex), so
      smaller splits spread it over more cores without more shuffle.
    Returns the settings applied (runtime SQL confs only).
    """
    parts = max(200, -(-int(input_bytes) // target_partition_bytes))
    conf = {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(scan_split_bytes),
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
