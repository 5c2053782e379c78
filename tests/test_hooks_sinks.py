"""UDF hooks, report sinks and the parameter table."""
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from mask_samples import SF001
from cloakline.operators import hooks
from cloakline.operators import scan as SC
from cloakline.sources import corpus, params, sinks
from cloakline.sources.patterns import seed_inline


def test_python_scan_matches_jvm_scan_on_notes(spark):
    docs = corpus.notes(spark.read.parquet(f"{SF001}/customer.parquet")).select("doc_id", "text")
    pats = seed_inline(0.75)
    jvm = SC.hits_long(docs, pats).select("doc_id", "hit_pos", "label", "span", "start", "end")
    py = hooks.python_scan(docs, pats).select("doc_id", "hit_pos", "label", "span", "start", "end")
    assert jvm.exceptAll(py).count() == 0 and py.exceptAll(jvm).count() == 0


def test_model_reply_hook(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")

    def scorer(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": pdf["doc_id"], "raw": "[]"})

    r = hooks.model_replies(docs, scorer, "detect").orderBy("doc_id").collect()
    assert [(x.doc_id, x.kind, x.raw) for x in r] == [(1, "detect", "[]"), (2, "detect", "[]")]


def test_a_row_that_fails_is_lost_alone(spark):
    bad = {0, 7, 8, 1500, 2999}
    docs = spark.createDataFrame([(i, None if i == 9 else f"t{i}") for i in range(3000)], "doc_id long, text string").repartition(3)

    def scorer(pdf: pd.DataFrame) -> pd.DataFrame:
        if set(pdf["doc_id"]) & bad:
            raise ValueError("no reply " + "x" * 1000)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "raw": pdf["text"]})

    got = {r.doc_id: r for r in hooks.model_replies(docs, scorer, "detect", errors=True).collect()}
    assert set(got) == set(range(3000)) and {i for i, r in got.items() if r.error} == bad
    for i, r in got.items():
        if i in bad:
            assert r.raw is None and r.error.startswith("ValueError: no reply") and len(r.error) == hooks.ERROR_CHARS
        else:
            assert (r.raw, r.kind) == (None if i == 9 else f"t{i}", "detect")
    assert hooks.model_replies(docs.limit(0), scorer, "detect", errors=True).count() == 0

    def told(text: pd.Series) -> pd.Series:
        if text.isin([f"t{i}" for i in bad]).any():
            raise ValueError("no reply")
        return text

    column = docs.withColumn("r", hooks.reply_column(told, errors=True)("text")).collect()
    assert len(column) == 3000
    for r in column:
        want = (None, "ValueError: no reply") if r.doc_id in bad else (r.text, None)
        assert (r.r.raw, r.r.error) == want


def test_sinks_write(spark):
    root = tempfile.mkdtemp(prefix="cloakline-sinks-")
    summary = spark.createDataFrame([(3, 0.5)], "n_samples long, macro_f1 double")
    lat = spark.createDataFrame([(1.0, 2.0)], "mean_ms double, p95_ms double")
    pt = spark.createDataFrame([("SSN", 3), ("PHONE", 5)], "phi_type string, support long")
    gr = spark.createDataFrame([(0, 17), (50, 18)], "step long, total long")
    sinks.write_summary(root + "/summary", summary, lat, pt, gr)
    j = spark.read.json(root + "/summary").collect()[0]
    assert j.latency.p95_ms == 2.0 and [x.phi_type for x in j.per_type] == ["PHONE", "SSN"]
    written = sinks.write_benchmark({"detection": summary.withColumn("dataset", F.lit("notes")),
                                     "empty": summary.limit(0)}, root)
    assert written == ["detection"] and os.path.isdir(root + "/benchmark_detection/dataset=notes")
    sinks.write_attack(spark.createDataFrame([("regex", 0.5)], "system string, rate double"),
                       spark.range(30).select(F.col("id").alias("seq")), root)
    assert spark.read.json(root + "/attack_samples").count() == 20


def test_params_defaults_and_versions(spark):
    root = tempfile.mkdtemp(prefix="cloakline-params-")
    d = params.load_params(spark, root + "/missing").collect()[0]
    assert d.sensitivity == 0.7 and d.min_confidence == 0.75 and d.phi_types_focus == []
    sinks.save_params(spark.createDataFrame([(0.75, ["PERSON"], 0.77)],
                                            "sensitivity double, phi_types_focus array<string>, min_confidence double"),
                      root + "/p", 3)
    r = params.load_params(spark, root + "/p").collect()[0]
    assert r.version == 3 and r.sensitivity == 0.75 and r.phi_types_focus == ["PERSON"]


def test_reply_column_needs_no_join(spark, secret):
    from cloakline.plans import mask_job as MJ
    docs = spark.createDataFrame([(1, 1, "Call Ann Lee at 555-867-5309."), (2, 2, "Nothing here.")],
                                 "doc_id long, seq long, text string")

    def scorer(text: pd.Series) -> pd.Series:
        return text.map(lambda t: '[{"span": "Ann Lee", "phi_type": "person", "confidence": 0.9}]'
                        if "Ann Lee" in t else "[]")

    d = MJ.detections_from_column(docs.withColumn("raw", hooks.reply_column(scorer)("text")), "raw")
    m = MJ.mask_corpus(d, seed_inline(0.75), secret, with_detections=True)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Join" not in plan
    r = {x.doc_id: x.masked for x in m.select("doc_id", "masked").collect()}
    assert "Ann Lee" not in r[1] and "[REDACTED]" in r[1] and "555-867-5309" not in r[1]
    assert r[2] == "Nothing here."


def test_bucketed_restore_is_shuffle_free(spark):
    from cloakline.operators import mask as M
    from cloakline.operators import vault as V
    from cloakline.plans import mask_job as MJ
    keys = M.demo_keys(spark)
    key = M.key_column(keys, "demo")
    docs = corpus.notes(spark.read.parquet(f"{SF001}/customer.parquet"))
    m = MJ.mask_corpus(docs, seed_inline(0.75), F.hex(key))
    sinks.write_bucketed(m.select("doc_id", "masked"), "t_masked", 4)
    sinks.write_bucketed(MJ.vault_rows(m, key, "demo"), "t_vault", 4)
    r = V.restore(spark.table("t_masked"), spark.table("t_vault"), key)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert r.filter(F.col("n_restored") != F.col("n_tokens")).count() == 0


def test_engine_routing(spark):
    import datetime as dt
    from cloakline import schemas as S
    from cloakline.sources import patterns as PS
    rows = [("jvm_ssn", 0, r"\b\d{3}-\d{2}-\d{4}\b", "SSN", None, 0, 0, 0.9, True, dt.date(2026, 1, 1), "jvm"),
            # look-behind plus a conditional group: Python-only syntax
            ("py_id", 1, r"(?<=ID )(<)?\d{4}(?(1)>)", "ID_NUMBER", None, 0, 0, 0.9, True, dt.date(2026, 1, 1), "py")]
    from pyspark.sql import types as T
    schema = T.StructType(S.PATTERNS.fields + [T.StructField("engine", T.StringType())])  # copy, not .add()
    t = spark.createDataFrame(rows, schema)
    assert [p.label for p in PS.inline_patterns(t, 0.5)] == ["jvm_ssn"]
    py = PS.inline_patterns(t, 0.5, engine="py")
    assert [p.label for p in py] == ["py_id"]
    docs = spark.createDataFrame([(1, "ID 1234 and ID <5678>")], "doc_id long, text string")
    assert [r.span for r in hooks.python_scan(docs, py).orderBy("hit_pos").collect()] == ["1234", "<5678>"]


def test_scale_conf_sizes_shuffles(spark):
    from cloakline.session import scale_conf
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        conf = scale_conf(spark, 100 * (1 << 40))  # 100 TB
        assert int(conf["spark.sql.shuffle.partitions"]) == 819200
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") in (str(64 << 20), "67108864b")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))


def test_pattern_json_layout(spark):
    import json
    from cloakline.sources import patterns as PS
    d = tempfile.mkdtemp(prefix="cloakline-pj-")
    doc = {
        "SSN_test": {"regex": r"\b\d{3}-\d{2}-\d{4}\b", "phi_type": "SSN", "abstraction_role": None,
                     "hits": 3, "misses": 1, "confidence": 0.75, "promoted": False, "last_updated": "2026-04-02"},
        "AGE_x": {"regex": r"\b\d{2} years\b", "phi_type": "AGE", "abstraction_role": "an adult",
                  "hits": 48, "misses": 2, "confidence": 0.96, "promoted": True, "last_updated": "2026-04-03"},
    }
    with open(d + "/pattern_memory.json", "w") as f:
        json.dump(doc, f, indent=2)
    t = PS.load_pattern_json(spark, d + "/pattern_memory.json").orderBy("pattern_seq").collect()
    assert [(r.label, r.pattern_seq, r.hits, r.promoted) for r in t] == [("SSN_test", 0, 3, False), ("AGE_x", 1, 48, True)]
    assert str(t[1].last_updated) == "2026-04-03" and t[1].abstraction_role == "an adult"
    assert [p.label for p in PS.inline_patterns(PS.load_pattern_json(spark, d + "/pattern_memory.json"))] == \
        ["AGE_x", "SSN_test"]
    assert PS.load_pattern_json(spark, d + "/missing.json").count() == 0


def test_params_json_layout(spark):
    d = tempfile.mkdtemp(prefix="cloakline-pjs-")
    with open(d + "/p.json", "w") as f:
        f.write('{"agent1": {"sensitivity": 0.8, "phi_types_focus": ["PERSON"]}, '
                '"agent2": {"min_confidence_to_apply": 0.77, "promote_threshold": 20}}')
    with open(d + "/bad.json", "w") as f:
        f.write("{not json")
    r = params.load_params_json(spark, d + "/p.json").collect()[0]
    assert (r.sensitivity, r.phi_types_focus, r.min_confidence) == (0.8, ["PERSON"], 0.77)
    for name in ("bad.json", "missing.json"):
        r = params.load_params_json(spark, d + "/" + name).collect()[0]
        assert (r.sensitivity, r.min_confidence) == (0.7, 0.75)


def test_first_n_and_missing_pattern_table(spark):
    from cloakline.sources import patterns as PS
    notes = corpus.notes(spark.read.parquet(f"{SF001}/customer.parquet"))
    top = corpus.first_n(notes, 5).collect()
    assert [r.seq for r in top] == [0, 1, 2, 3, 4]
    assert PS.load_patterns(spark, tempfile.mkdtemp(prefix="cloakline-np-") + "/absent").count() == 0
    assert PS.load_patterns(spark, None).count() == 0


def test_patterns_that_match_nothing_inside_a_text_are_rejected(spark):
    from cloakline.sources import patterns as PS
    regexes = [r"\b", r"(?=\d)", "x*", r"\d+", r"\bMRN\b", "[", r"(a)\1", r"(?<=-)\d"]
    df = spark.createDataFrame([(r,) for r in regexes], "regex string")
    got = {r.regex: r.reject_reason for r in PS.with_validity(df).collect()}
    assert {k for k, v in got.items() if v is None} == {r"\d+", r"\bMRN\b", r"(a)\1", r"(?<=-)\d"}
    assert got["["] == "does not compile"


def test_duplicate_replies_are_listed(spark):
    from cloakline.sources import replies
    rows = [(1, "detect", "a"), (1, "detect", "b"), (1, "detect", "b"), (1, "leakage", "a"), (2, "detect", "z"), (3, "detect", None)]
    got = replies.duplicates(spark.createDataFrame(rows, "doc_id long, kind string, raw string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "detect", "a"), (1, "detect", "b")]


def test_unmatched_tokens_are_rows(spark, secret):
    from cloakline.operators import mask as M
    from cloakline.operators import vault as V
    key = M.key_column(M.demo_keys(spark), "demo")
    masked = spark.createDataFrame([(1, "x <<ENC:aa:ENC>> <<ENC:bb:ENC>>"), (2, "none")], "doc_id long, masked string")
    items = spark.createDataFrame([(1, "aa", "word")], "doc_id long, token_id string, span string")
    out = V.restore(masked, V.encrypt_spans(items, key, "demo"), key)
    assert [tuple(r) for r in V.unmatched_tokens(out).collect()] == [(1, "bb")]
    assert {r.doc_id: (r.n_tokens, r.n_restored) for r in out.collect()} == {1: (2, 1), 2: (0, 0)}
