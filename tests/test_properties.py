"""Properties: round trip, partition independence, tamper rejection,
brute-force offsets, pattern validation, parallel scans."""
import random
import re

from pyspark.sql import functions as F

from mask_samples import SF001, samples
from cloakline import schemas as S
from cloakline.operators import mask as M
from cloakline.operators import running as RUN
from cloakline.operators import scan as SC
from cloakline.operators import vault as V
from cloakline.plans import mask_job as MJ
from cloakline.sources import corpus
from cloakline.sources import patterns as PS
from cloakline.sources.patterns import InlinePattern, seed_inline


def _notes(spark):
    return corpus.notes(spark.read.parquet(f"{SF001}/customer.parquet"))


def test_round_trip_encrypt_only(spark):
    """decrypt(mask(x)) = x when every pattern routes to encrypt and values do not overlap."""
    enc = [p for p in seed_inline(0.75) if p.phi_type in ("SSN", "PHONE", "EMAIL")]
    keys = M.demo_keys(spark)
    key = M.key_column(keys, "demo")
    docs = _notes(spark).filter(F.col("doc_id") % 4 <= 1)  # variants with dash/dot phones, SSN, e-mail
    m = MJ.mask_corpus(docs, enc, F.hex(key), all_occurrences=True)
    vault = MJ.vault_rows(m, key, "demo", applied_only=True)
    r = V.restore(m.select("doc_id", "masked", "text"), vault, key)
    bad = r.filter(F.col("restored") != F.col("text")).count()
    assert bad == 0
    # no vault token without text in all-occurrences mode
    tokens = m.select("doc_id", F.explode(F.regexp_extract_all("masked", F.lit(r"<<ENC:([^:]+):ENC>>"), 1)).alias("token_id"))
    assert vault.select("doc_id", "token_id").subtract(tokens).count() == 0


def test_partition_independence(spark, secret):
    docs = _notes(spark)
    a = MJ.mask_corpus(docs.repartition(1), seed_inline(0.75), secret).select("doc_id", "masked")
    b = MJ.mask_corpus(docs.repartition(7), seed_inline(0.75), secret).select("doc_id", "masked")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_tamper_rejected(spark):
    keys = M.demo_keys(spark)
    key = M.key_column(keys, "demo")
    docs = samples(spark, [(1, "SSN 123-45-6789 here", [])])
    m = MJ.mask_corpus(docs, seed_inline(0.75), F.hex(key))
    vault = MJ.vault_rows(m, key, "demo")
    flipped = vault.withColumn("ciphertext", F.concat(F.substring("ciphertext", 1, 20),
                                                      F.unhex(F.lit("00")), F.expr("substring(ciphertext, 22)")))
    assert V.decrypt(flipped, key).filter("status = 'rejected'").count() == 1
    r = V.restore(m.select("doc_id", "masked"), flipped, key).collect()[0]
    assert r.n_tokens == 1 and r.n_restored == 0 and "<<ENC:" in r.restored


def test_offsets_against_python_re(spark):
    """SC-3 offsets equal Python ``re.finditer`` (ASCII) on the notes corpus."""
    pats = seed_inline(0.75)
    docs = _notes(spark).select("doc_id", "text")
    got = {(r.doc_id, r.label, r.start, r.end, r.span)
           for r in SC.hits_long(docs, pats).collect()}
    want = set()
    for row in docs.collect():
        for p in pats:
            for mt in re.finditer(p.regex, row.text, re.ASCII):
                want.add((row.doc_id, p.label, mt.start(), mt.end(), mt.group()))
    assert got == want


def test_pattern_validation(spark):
    import datetime as dt
    rows = [("ok", 0, r"\d{3}", "X", None, 0, 0, 0.9, False, dt.date(2026, 1, 1)),
            ("bad", 1, r"(unclosed", "X", None, 0, 0, 0.9, False, dt.date(2026, 1, 1)),
            ("empty", 2, r"a*", "X", None, 0, 0, 0.9, False, dt.date(2026, 1, 1))]
    t = spark.createDataFrame(rows, S.PATTERNS)
    assert {r.label for r in PS.valid_patterns(t).collect()} == {"ok"}
    assert {r.label: r.reject_reason for r in PS.quarantine(t).collect()} == {
        "bad": "does not compile", "empty": "matches empty string"}
    assert [p.label for p in PS.inline_patterns(t, 0.5)] == ["ok"]


def test_running_sums_blocked(spark):
    rnd = random.Random(7)
    rows = [(i, "hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 5)}", rnd.randint(0, 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, key string, v long")
    got = {r.seq: r.run_v for r in RUN.running_sums(df, ["key"], "seq", ["v"], block=64).collect()}
    acc, want = {}, {}
    for s, k, v in rows:
        acc[k] = acc.get(k, 0) + v
        want[s] = acc[k]
    assert got == want


def test_prefix_clamp_tree_scan(spark):
    rnd = random.Random(3)
    steps = []
    for i in range(700):
        a = rnd.choice([50, -50, 20, -10, 0])
        lo = rnd.choice([None, 300, 500])
        hi = rnd.choice([None, 950, 1000])
        steps.append((i, a, lo, hi))
    df = spark.createDataFrame([(i, a, -RUN.BIG if lo is None else lo, RUN.BIG if hi is None else hi)
                                for i, a, lo, hi in steps], "seq long, a long, lo long, hi long")
    df = df.select("seq", F.struct("a", "lo", "hi").alias("st"))
    got = {r.seq: r.x for r in RUN.prefix_clamp(df, "seq", "st", fanout=8)
           .select("seq", RUN.apply_step(F.col("prefix"), F.lit(700)).alias("x")).collect()}
    x, want = 700, {}
    for i, a, lo, hi in steps:
        x = x + a
        if lo is not None:
            x = max(lo, x)
        if hi is not None:
            x = min(hi, x)
        want[i] = x
    assert got == want


def test_sql_built_scan_equals_column_built_scan(spark):
    """The SQL-text construction of the scan equals the Column-API one
    (a pattern with a quote forces the Column-API fallback)."""
    docs = _notes(spark).select("doc_id", "text")
    pats = seed_inline(0.75)
    quoted = pats + [InlinePattern(len(pats) + 1, "Q", r"o'clock|\bcard\b", "X", None, False, 0.5)]
    for offsets in (False, True):
        a = SC.scan(docs, pats, offsets=offsets).select("doc_id", "hits")          # SQL text
        b = docs.select("doc_id", (SC.hits_with_offsets_expr if offsets else SC.hits_expr)(
            F.col("text"), pats).alias("hits"))                                      # Column API
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        c = SC.scan(docs, quoted, offsets=offsets)                                   # falls back
        assert c.filter(F.exists("hits", lambda h: h["label"] == "Q")).count() > 0


def test_restore_and_phrases_tolerate_duplicates(spark, secret):
    keys = M.demo_keys(spark)
    key = M.key_column(keys, "demo")
    docs = samples(spark, [(1, "SSN 123-45-6789 and Ann", [])])
    m = MJ.mask_corpus(docs, seed_inline(0.75), F.hex(key))
    vault = MJ.vault_rows(m, key, "demo")
    twice = vault.unionByName(vault)  # a retried append
    r = V.restore(m.select("doc_id", "masked"), twice, key).collect()[0]
    assert r.restored == "SSN 123-45-6789 and Ann"
    ph = spark.createDataFrame([(1, "Ann", "a person"), (1, "Ann", "the patient")], "doc_id long, span string, phrase string")
    d = MJ.attach_phrases(docs, ph)
    assert d.collect()[0].phrase_map == {"Ann": "a person"}


def test_vault_text_form_round_trip(spark):
    keys = M.demo_keys(spark)
    key = M.key_column(keys, "demo")
    docs = samples(spark, [(1, "SSN 123-45-6789", [])])
    m = MJ.mask_corpus(docs, seed_inline(0.75), F.hex(key))
    vault = MJ.vault_rows(m, key, "demo")
    back = V.from_text_form(V.to_text_form(vault))
    assert dict(V.to_text_form(vault).dtypes)["ciphertext"] == "string"
    assert V.restore(m.select("doc_id", "masked"), back, key).collect()[0].restored == "SSN 123-45-6789"


def test_chunked_scan_equals_single_projection(spark, monkeypatch):
    docs = _notes(spark).select("doc_id", "text")
    pats = seed_inline(0.75)
    one = SC.scan(docs, pats, offsets=True).select("doc_id", "hits")
    monkeypatch.setattr(SC, "CHUNK", 4)
    many = SC.scan(docs, pats, offsets=True).select("doc_id", "hits")
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_per_type_exact_long_form_equals_in_row_form(spark, secret):
    from cloakline.operators import metrics as MT
    from cloakline.plans import evaluate as EV
    n = _notes(spark)
    o = EV.systems_wide(n, secret, ("cold",), seed_inline(None), 0.75)
    inrow = EV.per_type_exact(o)
    long = MT.per_type_exact(MT.type_long(o, "phi_spans", "in_gt"), MT.type_long(o, "pred", "in_pred"))
    cols = ["phi_type", "tp", "fp", "fn", "support"]
    assert inrow.select(*cols).exceptAll(long.select(*cols)).count() == 0
    assert long.select(*cols).exceptAll(inrow.select(*cols)).count() == 0


def test_duplicate_replies_do_not_multiply_documents(spark, secret):
    from cloakline.sources import replies
    n = _notes(spark)
    det = replies.detect_raw(n)
    once = MJ.attach_detections(n, det)
    twice = MJ.attach_detections(n, det.unionByName(det))
    assert once.count() == n.count() == twice.count()
