"""Structured Streaming jobs (SM-1 .. SM-5).

Every micro-batch runs the batch operators unchanged inside
``foreachBatch``.  Writes go to paths keyed by the batch id with overwrite
mode, so a replayed batch (after an executor or driver loss) rewrites the
same output instead of duplicating it.  The pattern table and the control
parameters are versioned tables with a lineage for each run (the checkpoint
name): batch N of a run reads that run's highest version up to N, or the seeds
when it has none, and writes version N + 1.  So a batch that is replayed reads
what it read before, and another run neither reads nor overwrites it.

Checkpoints live under ``spark.checkpoint.dir`` (the shared folder the
cluster names); a local scratch folder is registered only when the setting
is absent, as in tests.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline import constants as C
from cloakline import schemas as S
from cloakline.operators import control as CT
from cloakline.operators import mask as M
from cloakline.operators import memory as MEM
from cloakline.plans import mask_job as MJ
from cloakline.session import checkpoint_dir
from cloakline.sources import patterns as PS

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _ckpt(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", name)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, in whatever store it names; every other failure is an error."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def read_version(spark: SparkSession, root: str, run: str, upto: int | None = None) -> DataFrame | None:
    """The run's table of the highest version (up to ``upto``, if given), or None when it has none."""
    path = f"{root}/run={run}"
    if not _exists(spark, path):
        return None
    versions = spark.read.parquet(path)
    if upto is not None:
        versions = versions.filter(F.col("version") <= upto)
    last = versions.agg(F.max("version")).first()[0]
    return None if last is None else versions.filter(F.col("version") == last).drop("version")


def write_version(table: DataFrame, root: str, run: str, version: int) -> None:
    table.write.mode("overwrite").parquet(f"{root}/run={run}/version={version}")


def read_patterns(spark: SparkSession, root: str | None, run: str = "memory", upto: int | None = None) -> DataFrame:
    """The pattern table of a memory run, or the seed table when it has written none yet."""
    found = read_version(spark, root, run, upto) if root else None
    return PS.seed_patterns(spark) if found is None else found


def mask_stream(spark: SparkSession, source_dir: str, out_dir: str, keys: DataFrame, key_id: str,
                patterns_root: str | None = None, min_confidence: float = 0.75, name: str = "mask",
                available_now: bool = True, schema: str = DOC_SCHEMA, patterns_run: str = "memory"):
    """SM-1: mask every arriving document; masked rows and vault rows per batch.

    The pattern table is read per micro-batch (a static side would be frozen
    at query start).  Output: ``out_dir/masked/batch=N`` and
    ``out_dir/vault/batch=N``.
    """
    src = spark.readStream.schema(schema).parquet(source_dir)

    def run(batch: DataFrame, batch_id: int) -> None:
        bspark = batch.sparkSession
        pats = PS.inline_patterns(read_patterns(bspark, patterns_root, patterns_run), min_confidence)
        key = M.key_column(keys, key_id)
        docs = batch.select("doc_id", F.col("doc_id").alias("seq"), "text")
        masked = MJ.mask_corpus(docs, pats, F.hex(key)).persist()
        try:
            masked.select("doc_id", "seq", "masked", "cache_hits", "cache_misses", *M.mask_counts("spans"),
                          F.col("spans")).write.mode("overwrite").parquet(f"{out_dir}/masked/batch={batch_id}")
            MJ.vault_rows(masked, key, key_id).write.mode("overwrite").parquet(f"{out_dir}/vault/batch={batch_id}")
        finally:
            masked.unpersist()

    w = src.writeStream.foreachBatch(run).option("checkpointLocation", _ckpt(spark, name))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def validate_stream(spark: SparkSession, masked_dir: str, replies: DataFrame, out_dir: str,
                    name: str = "validate", available_now: bool = True):
    """SM-2: a second query reads the masked sink as a stream and validates it.

    ``replies``: the static reply table (leakage/fluency/overencryption).
    """
    schema = spark.read.parquet(masked_dir).schema
    src = spark.readStream.schema(schema).parquet(masked_dir)

    def run(batch: DataFrame, batch_id: int) -> None:
        enc = F.transform(F.filter("spans", lambda s: s["action"] == "encrypt"), lambda s: s["span"])
        docs = batch.select("seq", "doc_id", "cache_hits", enc.alias("encrypted"))
        own = replies.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")  # not the whole reply table
        v = CT.reward_columns(CT.parse_validation(own, docs))
        # the processed spans travel with the validation (the focus list needs their types)
        typed = batch.select("doc_id", F.transform("spans", lambda s: F.struct(
            s["span"].alias("span"), s["phi_type"].alias("phi_type"))).alias("spans"))
        v.join(typed, "doc_id", "left").write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    w = src.writeStream.foreachBatch(run).option("checkpointLocation", _ckpt(spark, name))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def memory_stream(spark: SparkSession, feedback_dir: str, patterns_root: str, name: str = "memory",
                  available_now: bool = True, schema=S.FEEDBACK):
    """SM-3: pattern memory evolving with a feedback stream ``(seq, label, correct)``.

    Per batch N: version up to N -> AG-14/WN-3 -> prune -> cap -> version N+1.
    """
    src = spark.readStream.schema(schema).parquet(feedback_dir)

    def run(batch: DataFrame, batch_id: int) -> None:
        bspark = batch.sparkSession
        current = read_patterns(bspark, patterns_root, name, batch_id)
        write_version(MEM.cap(MEM.prune(MEM.apply_feedback(current, batch))), patterns_root, name, batch_id + 1)

    w = src.writeStream.foreachBatch(run).option("checkpointLocation", _ckpt(spark, name))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def params_stream(spark: SparkSession, validation_dir: str, params_root: str, name: str = "params",
                  available_now: bool = True, schema=None):
    """SM-4: control parameters evolving with a validation stream.

    A batch folds its validations (WN-5) starting from the version before it
    and appends version N+1 with the final values (the same values if the
    batch is empty); ``seq`` is re-based to a dense 0-based order inside the
    batch.  When the validations carry their processed spans
    (``validate_stream`` output), the focus list (WN-4) is carried across
    batches as well.
    """
    # the files' own schema by default (validations may carry their spans)
    schema = schema or spark.read.parquet(validation_dir).schema
    src = spark.readStream.schema(schema).parquet(validation_dir)

    def run(batch: DataFrame, batch_id: int) -> None:
        bspark = batch.sparkSession
        before = read_version(bspark, params_root, name, batch_id)
        prev = before.first() if before is not None else None
        s0 = prev["sensitivity"] if prev else C.SENSITIVITY_DEFAULT
        m0 = prev["min_confidence"] if prev else C.MIN_CONFIDENCE_DEFAULT
        f0 = list(prev["phi_types_focus"] or []) if prev else []
        from cloakline.operators.running import ordinal
        dense = ordinal(batch, ["seq"]).withColumn("seq", (F.col("_ordinal") - 1).cast("long"))
        trace = CT.param_trace(dense, s0, m0)
        last = trace.orderBy(F.col("seq").desc()).limit(1).first() or {"sensitivity": s0, "min_confidence": m0}
        focus = f0
        if "spans" in batch.columns:
            # WN-4 across batches: the previous list continues until a clean
            # validation; new leaked types are appended in first-seen order
            spans = dense.select("doc_id", F.posexplode_outer("spans").alias("pos", "s")).filter("pos IS NOT NULL") \
                .select("doc_id", "pos", F.col("s.span").alias("span"), F.col("s.phi_type").alias("phi_type"))
            ft = CT.focus_trace(dense, spans).orderBy(F.col("seq").desc()).limit(1).first()
            any_clean = dense.filter("is_clean").limit(1).count() > 0
            tail = list(ft["phi_types_focus"] or []) if ft else []
            focus = tail if any_clean else f0 + [t for t in tail if t not in f0]
        row = [(float(last["sensitivity"]), focus, float(last["min_confidence"]))]
        write_version(bspark.createDataFrame(row, "sensitivity double, phi_types_focus array<string>, min_confidence double"),
                      params_root, name, batch_id + 1)

    w = src.writeStream.foreachBatch(run).option("checkpointLocation", _ckpt(spark, name))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def counters_stream(spark: SparkSession, masked_dir: str, name: str = "counters", query_name: str = "run_counters",
                    validation_dir: str | None = None):
    """SM-5: running counters over the masked stream and, with ``validation_dir``, the stream of its validations
    (streaming aggregation of both, complete mode, in-memory sink for inspection); a reset is a new checkpoint name.

    Rewards and missed values count as their validations arrive, whenever that is.
    """
    sums = ("total_spans", "total_encrypted", "total_abstracted", "total_cache_hits", "total_cache_misses", "missed_phi_count")
    src = spark.readStream.schema(spark.read.parquet(masked_dir).schema).parquet(masked_dir)
    none = F.lit(None).cast("long")
    told = src.select(F.lit(1).alias("sentence"), none.alias("validated"), F.lit(None).cast("double").alias("total_reward"), *[
        (F.lit(0) if c is None else F.coalesce(c, F.lit(0))).cast("long").alias(n) for n, c in zip(
            sums, ("span_count", "encrypted_count", "abstracted_count", "cache_hits", "cache_misses", None), strict=True)])
    if validation_dir:
        val = spark.readStream.schema(spark.read.parquet(validation_dir).schema).parquet(validation_dir)
        told = told.unionByName(val.select(
            F.lit(None).cast("int").alias("sentence"), F.lit(1).cast("long").alias("validated"), "total_reward",
            *[F.lit(0).cast("long").alias(n) for n in sums[:-1]], F.coalesce(F.size("leaked_spans"), F.lit(0)).cast("long").alias(sums[-1])))
    agg = told.agg(F.count("sentence").alias("total_sentences"), F.count("validated").alias("total_validated"),
                   F.coalesce(F.sum("total_reward"), F.lit(0.0)).alias("total_reward"), *[F.sum(n).alias(n) for n in sums])
    return (agg.writeStream.outputMode("complete").format("memory").queryName(query_name)
            .option("checkpointLocation", _ckpt(spark, name)).trigger(availableNow=True).start())
