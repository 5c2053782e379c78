"""Streaming with availableNow equals batch; the driver contract holds."""
import tempfile

from pyspark.sql import functions as F

from mask_samples import SF001
from cloakline import schemas as S
from cloakline.operators import mask as M
from cloakline.plans import mask_job as MJ
from cloakline.sources.patterns import seed_inline
from cloakline.streaming import stream as ST


def test_mask_stream_equals_batch(spark, secret):
    src = tempfile.mkdtemp(prefix="cloakline-src-")
    out = tempfile.mkdtemp(prefix="cloakline-out-")
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    docs.repartition(3).write.mode("overwrite").parquet(src + "/in")
    keys = M.demo_keys(spark)
    q = ST.mask_stream(spark, src + "/in", out, keys, "demo", name="t_mask")
    q.awaitTermination()
    got = spark.read.parquet(out + "/masked").select("doc_id", "masked")
    batch = MJ.mask_corpus(docs.select("doc_id", "text"), seed_inline(0.75), secret).select("doc_id", "masked")
    assert got.count() == batch.count()
    assert got.exceptAll(batch).count() == 0
    # SM-2 a second query validates the masked sink
    from cloakline.sources import corpus, replies
    notes = corpus.notes(spark.read.parquet(f"{SF001}/customer.parquet"))
    vq = ST.validate_stream(spark, out + "/masked", replies.critic_raw(notes), out + "/validation", name="t_val")
    vq.awaitTermination()
    v = spark.read.parquet(out + "/validation")
    assert v.count() == batch.count() and v.filter(F.col("total_reward").isNull()).count() == 0
    # SM-5 counters over the masked sink
    c = ST.counters_stream(spark, out + "/masked", name="t_counters", query_name="t_counters")
    c.awaitTermination()
    row = spark.sql("SELECT * FROM t_counters").collect()[0]
    assert row.total_sentences == batch.count() and row.total_validated == 0 and row.total_reward == 0.0
    # with the validations: the rewards and the missed values of the batch job
    ST.counters_stream(spark, out + "/masked", name="t_counters2", query_name="t_counters2", validation_dir=out + "/validation").awaitTermination()
    both = spark.sql("SELECT * FROM t_counters2").collect()[0]
    want = v.agg(F.sum("total_reward"), F.sum(F.size("leaked_spans")), F.count(F.lit(1))).first()
    assert (both.missed_phi_count, both.total_validated, both.total_sentences) == (want[1], want[2], row.total_sentences)
    assert abs(both.total_reward - want[0]) < 1e-6 and both.total_spans == row.total_spans and want[1] > 0


def test_memory_and_params_streams(spark):
    root = tempfile.mkdtemp(prefix="cloakline-state-")
    fb = spark.createDataFrame([(i, "SSN_standard", i % 5 != 0) for i in range(40)], S.FEEDBACK)
    fb.repartition(2).write.parquet(root + "/fb")
    ST.memory_stream(spark, root + "/fb", root + "/patterns", name="t_mem").awaitTermination()
    p = spark.read.parquet(root + "/patterns")
    v = p.agg(F.max("version")).first()[0]
    row = p.filter((F.col("version") == v) & (F.col("label") == "SSN_standard")).collect()[0]
    assert row.hits == 48 + 32 and row.misses == 2 + 8
    # another run (a new checkpoint name) starts from the seeds and leaves the first run's versions alone
    ST.memory_stream(spark, root + "/fb", root + "/patterns", name="t_mem2").awaitTermination()
    again = {run: ST.read_patterns(spark, root + "/patterns", run).filter("label = 'SSN_standard'").first().hits
             for run in ("t_mem", "t_mem2", "t_none")}
    assert again == {"t_mem": 80, "t_mem2": 80, "t_none": 48}
    # a batch reads the version before it, so writing its own twice changes nothing
    assert ST.read_patterns(spark, root + "/patterns", "t_mem", 0).filter("label = 'SSN_standard'").first().hits == 48
    val = spark.createDataFrame([(i, i, i % 3 != 0, True, True, [] if i % 3 else ["x"], [], 0) for i in range(30)],
                                S.VALIDATION)
    val.write.parquet(root + "/val")
    ST.params_stream(spark, root + "/val", root + "/params", name="t_params").awaitTermination()
    assert spark.read.parquet(root + "/params").count() >= 1
    spark.createDataFrame([], S.VALIDATION).write.parquet(root + "/val0")
    ST.params_stream(spark, root + "/val0", root + "/params0", name="t_params0").awaitTermination()
    # focus list across a batch: leaks after the last clean validation, first-seen order
    from pyspark.sql import types as T
    vs = T.StructType(S.VALIDATION.fields + [T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("span", T.StringType()), T.StructField("phi_type", T.StringType())])))])
    rows = [(0, 0, True, True, True, [], [], 0, [("a", "PERSON")]),
            (1, 1, False, True, True, ["b"], [], 0, [("b", "PHONE"), ("c", "SSN")]),
            (2, 2, False, True, True, ["c", "b"], [], 0, [("b", "PHONE"), ("c", "SSN")])]
    spark.createDataFrame(rows, vs).write.parquet(root + "/val2")
    ST.params_stream(spark, root + "/val2", root + "/params2", name="t_params2").awaitTermination()
    p2 = spark.read.parquet(root + "/params2").collect()[0]
    assert p2.phi_types_focus == ["PHONE", "SSN"] and p2.sensitivity == 0.8


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 40


def test_every_query_runs_on_smoke_data(spark):
    import __spark_entry__ as E
    for name, fn in E.queries().items():
        df = fn(spark, SF001)
        df.write.format("noop").mode("overwrite").save()
