"""Registered queries: one per operator family of the inventory.

Each function takes ``(spark, sf_dir)``, reads the given tables (or views
Spark derives from them) and returns a DataFrame whose column names match
the SQL twin in ``catalog_sql``.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakline import constants as C
from cloakline.functions.text import route
from cloakline.operators import lifecycle as LC
from cloakline.operators import mask as M
from cloakline.operators import scan as SC
from cloakline.operators import spans as SP
from cloakline.plans import mask_job as MJ
from cloakline.session import checkpoint_dir, cut_lineage, read_table, spread
from cloakline.sources import corpus
from cloakline.functions.text import exact_leakage as leak_expr
from cloakline.functions.text import quasi_from_tokens, token_set, tokens, utility, utility_from_tokens
from cloakline.operators import control as CT
from cloakline.operators import memory as MEM
from cloakline.operators import metrics as MT
from cloakline.operators import quantiles as QU
from cloakline.operators import running as RUN
from cloakline.operators import vault as V
from cloakline.plans import evaluate as EV
from cloakline.sources import patterns as PS
from cloakline.sources import replies
from cloakline.sources.patterns import seed_inline

DEMO_KEY_ID = "demo"
LONG_NUMBER = "[0-9]{3,}"  # what the "digits" system of the comparison masks
SPAN_ORDER = 1 << 32  # places between two samples in the order of their spans: no text has as many


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.notes(spread(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents_as_samples(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def _secret(spark: SparkSession):
    return F.hex(M.key_column(M.demo_keys(spark, DEMO_KEY_ID), DEMO_KEY_ID))


def _masked(spark, docs, **kw) -> DataFrame:
    return MJ.mask_corpus(docs, seed_inline(0.75), _secret(spark), **kw)


def _mask_report(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "masked", "cache_hits", *M.mask_counts("spans"))


# ---------------------------------------------------------------- scan
def pattern_scan(spark, sf_dir):
    """JN-1 over ``documents``: every match of every seed, long form."""
    scanned = SC.scan(_docs(spark, sf_dir).select("doc_id", "text"), seed_inline(0.75))
    return scanned.select("doc_id", F.posexplode_outer("hits").alias("hit_pos", "h")).filter("hit_pos IS NOT NULL").select(
        "doc_id", "hit_pos", F.col("h.label").alias("label"), F.col("h.span").alias("span"),
        F.col("h.phi_type").alias("phi_type"))


def pattern_offsets(spark, sf_dir):
    """SC-3 offsets over ``documents``."""
    long = SC.hits_long(_docs(spark, sf_dir).select("doc_id", "text"), seed_inline(0.75))
    return long.select("doc_id", "hit_pos", "label", "span", "start", "end")


def pattern_scan_notes(spark, sf_dir):
    """JN-1 over the notes corpus, where every seed fires."""
    scanned = SC.scan(_notes(spark, sf_dir).select("doc_id", "text"), seed_inline(0.75), offsets=True)
    return scanned.select("doc_id", F.posexplode_outer("hits").alias("hit_pos", "h")).filter("hit_pos IS NOT NULL").select(
        "doc_id", "hit_pos", F.col("h.label").alias("label"), F.col("h.span").alias("span"),
        F.col("h.start").alias("start"), F.col("h.end").alias("end"))


# ---------------------------------------------------------------- spans
def span_dedup(spark, sf_dir):
    """WN-6/ST-1: distinct span texts per document, first wins."""
    scanned = SC.scan(_notes(spark, sf_dir).select("doc_id", "text"), seed_inline(0.75))
    merged = SP.merge(F.col("hits"))
    return scanned.select(
        "doc_id", "cache_hits",
        F.size(merged).alias("n_distinct"),
        F.array_join(F.transform(merged, lambda s: s["span"]), "|").alias("spans"),
        F.array_join(F.transform(merged, lambda s: s["label"]), "|").alias("labels"),
    )


def span_route(spark, sf_dir):
    """PRJ-1: action per distinct span."""
    scanned = SC.scan(_notes(spark, sf_dir).select("doc_id", "text"), seed_inline(0.75))
    return scanned.select("doc_id", F.posexplode_outer(SP.merge(F.col("hits"))).alias("pos", "s")).filter("pos IS NOT NULL").select(
        "doc_id", "pos", F.col("s.span").alias("span"), F.col("s.phi_type").alias("phi_type"),
        route(F.col("s.phi_type")).alias("action"))


# ---------------------------------------------------------------- masking
def mask_routed(spark, sf_dir):
    """MK-1 on the notes corpus (seed patterns only)."""
    return _mask_report(_masked(spark, _notes(spark, sf_dir)))


def mask_documents(spark, sf_dir):
    """MK-1 on ``documents`` — the headline corpus job."""
    return _mask_report(_masked(spark, _docs(spark, sf_dir)))


def mask_all(spark, sf_dir):
    """MK-1 in ``all_occurrences`` mode on the notes corpus."""
    return _mask_report(_masked(spark, _notes(spark, sf_dir), all_occurrences=True))



# ---------------------------------------------------------------- shared derived inputs
def _replies(notes: DataFrame) -> DataFrame:
    return replies.detect_raw(notes).unionByName(replies.critic_raw(notes))


def _with_detector(spark, sf_dir) -> DataFrame:
    n = _notes(spark, sf_dir)
    d = MJ.attach_detections(n, replies.detect_raw(n))
    return SC.scan(d, seed_inline(0.75))


def _learned_table(spark, sf_dir) -> DataFrame:
    """MK-10 over the detector spans of the notes corpus."""
    d = _with_detector(spark, sf_dir)
    learn = d.select("seq", F.posexplode_outer(SP.learnable(F.col("hits"), F.col("detections"))).alias("pos", "s")).filter("pos IS NOT NULL").select(
        "seq", "pos", F.col("s.span").alias("span"), F.col("s.phi_type").alias("phi_type"))
    return MEM.learn_patterns(learn)


def _warm_patterns(spark, sf_dir) -> DataFrame:
    learned = _learned_table(spark, sf_dir).drop("support").withColumn("last_updated", F.lit(None).cast("date"))
    return MEM.insert_if_absent(PS.seed_patterns(spark), learned)


def _sightings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The learned patterns, and (label, seq, pos) of every learnable span of their shape."""
    d = _with_detector(spark, sf_dir)
    learn = cut_lineage(d.select("seq", F.posexplode_outer(SP.learnable(F.col("hits"), F.col("detections"))).alias("pos", "s")).filter(
        "pos IS NOT NULL").select("seq", "pos", F.col("s.span").alias("span"), F.col("s.phi_type").alias("phi_type")))
    learned = MEM.learn_patterns(learn)
    shapes = learn.select("seq", "pos", "phi_type", MEM.shape_regex(F.col("span")).alias("regex"))
    seen = shapes.join(learned.select("label", "phi_type", "regex"), ["phi_type", "regex"]).select("label", "seq", "pos")
    return learned.drop("support").withColumn("last_updated", F.lit(None).cast("date")), seen


def _warm_hits(spark, sf_dir) -> DataFrame:
    """What the warm system finds in each note: the seeds, and shapes learned from the notes before it.  Its feedback:
    each sighting of a learned shape was correct, and every note found one seed wrong, so that it falls below the threshold."""
    n = _notes(spark, sf_dir)
    learned, seen = _sightings(spark, sf_dir)
    doubts = n.select(F.lit(C.DOUBTED_SEED).alias("label"), "seq", F.lit(0).alias("pos"), F.lit(False).alias("correct"))
    feedback = seen.withColumn("correct", F.lit(True)).unionByName(doubts)
    return EV.warm_hits(n, PS.seed_patterns(spark), learned, seen, feedback, C.MIN_CONFIDENCE_DEFAULT)


def _outputs(spark, sf_dir, systems=("cold", "regex", "full_encryption", "ner")) -> DataFrame:
    """System outputs keyed (system, doc_id): the row-local systems come from one scan of the samples
    (``systems_wide``), cold without detector; the recogniser system joins its entity table on doc_id."""
    n = _notes(spark, sf_dir)
    secret = _secret(spark)
    local = tuple(x for x in systems if x != "ner")
    outs = [EV.systems_wide(n, secret, local, seed_inline(None), C.MIN_CONFIDENCE_DEFAULT)] if local else []
    if "ner" in systems:
        outs.append(EV.offsets_system(n, replies.entities(n), secret))
    return outs[0].unionByName(outs[1]) if len(outs) > 1 else outs[0]


def _compared(spark, sf_dir, systems=("cold", "regex", "full_encryption", "ner")) -> DataFrame:
    """MK-12: as ``_outputs``, with cold and warm as whole pipelines: detector spans merged, misses counted, and the
    warm patterns as each sample found them."""
    n = _notes(spark, sf_dir)
    secret = _secret(spark)
    rows = MJ.attach_detections(n, replies.detect_raw(n))
    if "warm" in systems:
        rows = rows.join(_warm_hits(spark, sf_dir).withColumnRenamed("hits", "warm_hits"), "doc_id", "left")
    out = EV.systems_wide(rows, secret, tuple(x for x in systems if x != "ner"), seed_inline(None), C.MIN_CONFIDENCE_DEFAULT, detector=True)
    return out.unionByName(EV.offsets_system(n, replies.entities(n), secret)) if "ner" in systems else out


def _latency(spark, sf_dir) -> DataFrame:
    """Per-sample latency measurements: ``events.value`` keyed by ``event_id``."""
    return read_table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"),
                                                      F.col("value").alias("latency_ms"))


def _r(df: DataFrame) -> DataFrame:
    return MT.round_cols(df, 6)


# ---------------------------------------------------------------- detector side
def detector_parse(spark, sf_dir):
    """SRC-5 + SC-1/2 + FLT-1/2: valid detector spans, reply order kept."""
    d = _with_detector(spark, sf_dir)
    return d.select("doc_id", F.posexplode_outer("detections").alias("pos", "s")).filter("pos IS NOT NULL").select(
        "doc_id", "pos", F.col("s.span").alias("span"), F.col("s.phi_type").alias("phi_type"),
        F.col("s.confidence").alias("confidence"), F.col("s.has_pattern").alias("has_pattern"))


def cache_misses(spark, sf_dir):
    """JN-2 / AG-18 / FLT-5 counters per document."""
    d = _with_detector(spark, sf_dir)
    return d.select("doc_id", "cache_hits", SP.cache_misses(F.col("hits"), F.col("detections")).alias("cache_misses"),
                    F.size(SP.learnable(F.col("hits"), F.col("detections"))).alias("n_learnable"))


def reply_rejects(spark, sf_dir):
    """SRC-5: replies that the jobs pass over.  Some notes were answered twice, some of them in the same words."""
    told = replies.detect_raw(_notes(spark, sf_dir))
    again = told.filter("doc_id % 10 = 0").withColumn("raw", F.concat("raw", F.lit(" ")))
    return replies.duplicates(told.unionByName(again).unionByName(told.filter("doc_id % 15 = 0")))


def skip_gate(spark, sf_dir):
    """FLT-4: documents whose promoted hits make the detector call unnecessary."""
    s = SC.scan(_notes(spark, sf_dir).select("doc_id", "text"), seed_inline(0.75))
    return s.select("doc_id", F.size(F.filter("hits", lambda h: h["promoted"])).alias("promoted_hits"),
                    SP.skip_detector(F.col("hits")).alias("skip_detector"))


def mask_with_detector(spark, sf_dir):
    """MK-1 with detector spans merged (ST-1) and phrases looked up (JN-3)."""
    n = _notes(spark, sf_dir)
    d = MJ.attach_phrases(MJ.attach_detections(n, replies.detect_raw(n)), replies.phrases(n))
    m = MJ.mask_corpus(d, seed_inline(0.75), _secret(spark), with_detections=True, with_phrases=True)
    return m.select("doc_id", "masked", "cache_hits", "cache_misses", *M.mask_counts("spans"))


# ---------------------------------------------------------------- other maskers
def mask_regex_baseline(spark, sf_dir):
    o = EV.regex_system(_notes(spark, sf_dir), seed_inline(None), _secret(spark))
    return o.select("doc_id", "masked", F.size("pred").alias("n_pred"))


def mask_full_encryption(spark, sf_dir):
    o = EV.full_encryption_system(_notes(spark, sf_dir), _secret(spark))
    return o.select("doc_id", "masked", F.size("pred").alias("n_pred"))


def mask_offsets(spark, sf_dir):
    n = _notes(spark, sf_dir)
    o = EV.offsets_system(n, replies.entities(n), _secret(spark), ("ner", "pii"))
    return o.select("system", "doc_id", "masked", F.array_join(F.transform("pred", lambda p: F.concat_ws(":", p["phi_type"], p["span"])), "|").alias("pred"))


def mask_sequential(spark, sf_dir):
    """MK-2: truth texts encrypted in list order, first live occurrence each."""
    n = _notes(spark, sf_dir).withColumn("_secret", _secret(spark))
    r = M.sequential_encrypt(F.col("text"), F.transform("phi_spans", lambda s: s["span"]), F.col("doc_id"),
                             F.col("_secret"))
    return n.select("doc_id", r["text"].alias("masked"), F.size(r["applied"]).alias("n_applied"))


def label_map(spark, sf_dir):
    """PRJ-4 over the recogniser table."""
    return EV.label_map(replies.entities(_notes(spark, sf_dir))).select(
        "system", "doc_id", "start", "end", "entity_type", "phi_type")


def corpus_load(spark, sf_dir):
    """SRC-1 over a raw annotated layout derived from the notes corpus."""
    a = corpus.load_annotated(corpus.raw_annotated(read_table(spark, sf_dir, "customer")))
    return a.select("doc_id", "text", F.size("phi_spans").alias("n_spans"),
                    F.array_join(F.transform("phi_spans", lambda s: F.concat_ws(":", s["phi_type"], s["span"])), "|")
                    .alias("spans"))


# ---------------------------------------------------------------- vault
def vault_roundtrip(spark, sf_dir):
    """MK-6/7/8 + JN-8: mask, write vault rows, restore from the vault."""
    n = _notes(spark, sf_dir)
    keys = M.demo_keys(spark, DEMO_KEY_ID)
    key = M.key_column(keys, DEMO_KEY_ID)
    m = MJ.mask_corpus(n, seed_inline(0.75), F.hex(key))
    vault = MJ.vault_rows(m, key, DEMO_KEY_ID)
    r = V.restore(m.select("doc_id", "masked"), vault, key)
    return r.select("doc_id", "restored", "n_tokens", "n_restored")


def vault_unmatched(spark, sf_dir):
    """JN-8: the tokens left in the text when vault rows are missing or do not decrypt."""
    key = M.key_column(M.demo_keys(spark, DEMO_KEY_ID), DEMO_KEY_ID)
    m = _masked(spark, _notes(spark, sf_dir))
    vault = MJ.vault_rows(m, key, DEMO_KEY_ID).filter(F.col("doc_id") % 7 != 3)
    broken = F.when(F.col("doc_id") % 11 == 4, F.concat(F.col("ciphertext"), F.lit("x").cast("binary"))).otherwise(F.col("ciphertext"))
    return V.unmatched_tokens(V.restore(m.select("doc_id", "masked"), vault.withColumn("ciphertext", broken), key))


def vault_import(spark, sf_dir):
    """ST-5: vault of compat mode overwritten by the vault of all-occurrences mode."""
    n = _notes(spark, sf_dir)
    keys = M.demo_keys(spark, DEMO_KEY_ID)
    key = M.key_column(keys, DEMO_KEY_ID)
    a = MJ.vault_rows(MJ.mask_corpus(n, seed_inline(0.75), F.hex(key)), key, DEMO_KEY_ID).withColumn("version", F.lit(1))
    b = MJ.vault_rows(MJ.mask_corpus(n, seed_inline(0.75), F.hex(key), all_occurrences=True), key, DEMO_KEY_ID,
                      applied_only=True).withColumn("version", F.lit(2))
    return V.import_vault(a, b).select("doc_id", "token_id", "original_len", "version")


# ---------------------------------------------------------------- metrics
def exact_metrics(spark, sf_dir):
    """JN-5 / SC-10 / SC-7 per sample for the cold system."""
    o = _outputs(spark, sf_dir, ("cold",))
    gt = F.transform("phi_spans", lambda s: s["span"])
    pr = F.transform("pred", lambda s: s["span"])
    r = o.select("doc_id", MT.exact_record(gt, pr).alias("m"), utility(F.col("text"), F.col("masked")).alias("utility"))
    return _r(r.select("doc_id", "m.tp", "m.fp", "m.fn", "m.precision", "m.recall", "m.f1", "utility"))


def overlap_metrics(spark, sf_dir):
    """JN-6 / SC-11 / SC-9 / SC-12 per (system, sample)."""
    rec = EV.records(_compared(spark, sf_dir))
    return _r(rec.select("system", "doc_id", "tp", "fp", "fn", "precision", "recall", "f1", "leakage",
                         "quasi_risk", "utility"))


def per_type_exact(spark, sf_dir):
    """AG-4 for the cold system."""
    return _r(EV.per_type_exact(_outputs(spark, sf_dir, ("cold",))))


def per_type_overlap(spark, sf_dir):
    """AG-5 per (system, type)."""
    o = _compared(spark, sf_dir)
    return _r(EV.per_type_overlap(o))


def micro_macro(spark, sf_dir):
    """AG-1/2/3/8/9 for the cold system with critic rewards."""
    o = _outputs(spark, sf_dir, ("cold",))
    gt = F.transform("phi_spans", lambda s: s["span"])
    pr = F.transform("pred", lambda s: s["span"])
    rec = o.select("doc_id", "seq", "cache_hits", MT.exact_record(gt, pr).alias("m"),
                   utility(F.col("text"), F.col("masked")).alias("utility"))
    n = _notes(spark, sf_dir)
    val = CT.reward_columns(CT.parse_validation(replies.critic_raw(n), _critic_docs(spark, sf_dir)))
    rec = rec.join(val.select("doc_id", "total_reward"), "doc_id", "left")
    rec = rec.select("m.tp", "m.fp", "m.fn", "m.precision", "m.recall", "m.f1", "utility", "cache_hits",
                     F.coalesce("total_reward", F.lit(0.0)).alias("total_reward"))
    return _r(MT.micro_macro(rec))


def evaluation_records(spark, sf_dir):
    """PRJ-5 / SNK-1: the runner's record of each sample, failed samples named in ``error``."""
    n = _notes(spark, sf_dir)
    m = _masked(spark, n)
    gt = F.transform("phi_spans", lambda s: s["span"])
    pr = F.transform("spans", lambda s: s["span"])
    rec = m.select("doc_id", "seq", F.length("text").alias("text_len"), F.size("phi_spans").alias("gt_count"),
                   *M.mask_counts("spans"), MT.exact_record(gt, pr).alias("m"), utility(F.col("text"), F.col("masked")).alias("utility"),
                   "cache_hits", "cache_misses", "masked",
                   F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty text").alias("error"))
    val = CT.reward_columns(CT.parse_validation(replies.critic_raw(n), _critic_docs(spark, sf_dir)))
    rec = rec.join(val.select("doc_id", "is_clean", "total_reward"), "doc_id", "left")
    return _r(rec.select("doc_id", "seq", "text_len", "gt_count", "span_count", "encrypted_count", "abstracted_count", "m.tp", "m.fp",
                         "m.fn", "m.precision", "m.recall", "m.f1", "utility", "cache_hits", "cache_misses", "is_clean",
                         F.coalesce("total_reward", F.lit(0.0)).alias("total_reward"), "masked", "error"))


def system_latency(spark, sf_dir):
    """Measured latency per system: mean, median, 95th percentile, least."""
    rec = EV.records(_outputs(spark, sf_dir, ("cold", "regex")), _latency(spark, sf_dir)).select("system", "latency_ms")
    rec = cut_lineage(rec)  # the quantiles read it a few times
    base = rec.groupBy("system").agg(F.avg("latency_ms").alias("mean_ms"), F.min("latency_ms").alias("min_ms"), F.count(F.lit(1)).alias("n"))
    return _r(QU.with_quantiles(base, QU.quantiles(rec, ("system",), "latency_ms", [0.5, 0.95]), ("system",), ["median_ms", "p95_ms"]))


def mean_latencies(spark, sf_dir):
    """AG-13: mean latency over all sentences, and over those that were validated."""
    n = _notes(spark, sf_dir).select("doc_id").join(_latency(spark, sf_dir), "doc_id", "left")
    seen = replies.critic_raw(_notes(spark, sf_dir)).filter(
        (F.col("kind") == "leakage") & F.col("raw").startswith("{")).select("doc_id").distinct()
    j = n.join(seen.withColumn("_seen", F.lit(True)), "doc_id", "left")
    lat = F.coalesce("latency_ms", F.lit(0.0))
    return _r(j.agg(F.count(F.lit(1)).alias("n"), F.avg(lat).alias("avg_latency_ms"), F.count("_seen").alias("n_validated"),
                    F.avg(F.when(F.col("_seen"), lat)).alias("avg_validated_ms")))


def report_by_type(spark, sf_dir):
    """SC-20: the per-type table as the report prints it, three places, with its place by support."""
    t = EV.per_type_exact(_outputs(spark, sf_dir, ("cold",)))
    place = F.row_number().over(Window.orderBy(F.col("support").desc(), "phi_type"))  # one row per type
    return t.select(place.alias("place"), "phi_type", *[F.round(c, 3).alias(c) for c in ("precision", "recall", "f1")], "support")


def pattern_state(spark, sf_dir):
    """MK-11 with SNK-6: learn, insert, feedback, promote, prune, cap, written as a table and read back."""
    pats, fb = _event_feedback(spark, sf_dir, True)
    table = MEM.insert_if_absent(_warm_patterns(spark, sf_dir), pats)
    out = MEM.cap(MEM.prune(MEM.apply_feedback(table, fb, day="2026-01-01")))
    path = f"{checkpoint_dir(spark).rstrip('/')}/pattern-state-{uuid.uuid4().hex}"
    out.write.parquet(path)
    return _r(spark.read.parquet(path).select("label", "hits", "misses", "confidence", "promoted"))


def security_by_system(spark, sf_dir):
    return _r(MT.security_by_system(EV.records(_compared(spark, sf_dir))))


def detection_by_system(spark, sf_dir):
    return _r(MT.detection_by_system(EV.records(_compared(spark, sf_dir))))


def latency_stats(spark, sf_dir):
    """AG-6/7 over measured latencies (``events.value``) per event type."""
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    e = ev.select("event_type", F.col("value").alias("latency_ms"), (k % 3).alias("cache_hits"),
                  (k % 2).alias("cache_misses"))
    return _r(MT.latency_stats(e, "latency_ms", ("event_type",)))


def scale_windows(spark, sf_dir):
    """WN-1 over the cold and warm systems with measured latencies."""
    rec = EV.records(_compared(spark, sf_dir, ("cold", "warm")), _latency(spark, sf_dir))
    return _r(MT.scale_windows(rec, _notes(spark, sf_dir)))


# ---------------------------------------------------------------- critic and control
def _critic_docs(spark, sf_dir) -> DataFrame:
    n = _notes(spark, sf_dir)
    m = MJ.mask_corpus(n, seed_inline(0.75), _secret(spark))
    enc = F.transform(F.filter("spans", lambda s: s["action"] == "encrypt"), lambda s: s["span"])
    return m.select("seq", "doc_id", "cache_hits", enc.alias("encrypted"))


def critic_reward(spark, sf_dir):
    """MK-14 + SC-22 + AG-15 per document."""
    n = _notes(spark, sf_dir)
    v = CT.reward_columns(CT.parse_validation(replies.critic_raw(n), _critic_docs(spark, sf_dir)))
    return _r(v.select("doc_id", "is_clean", "is_fluent", "is_accurate", F.size("leaked_spans").alias("n_leaked"),
                       F.size("over_encrypted").alias("n_over"), "fluency_score", "leakage_confidence",
                       "r_correct_redaction", "r_missed_phi", "r_over_encryption", "r_cache_hit_bonus",
                       "r_utility_preserved", "total_reward"))


def _event_validations(spark, sf_dir) -> DataFrame:
    """A validation stream derived from ``events`` (seq = event_id)."""
    ev = read_table(spark, sf_dir, "events")
    err = F.col("event_type") == "error"
    pur = (F.col("event_type") == "purchase") & (F.col("value") > 100)
    uid = F.col("user_id").cast("string")
    return ev.select(
        F.col("event_id").alias("seq"), F.col("event_id").alias("doc_id"), (~err).alias("is_clean"),
        F.when(err & (F.col("value") > 50), F.array(F.col("props"), uid))
        .when(err & (F.col("value") > 10), F.array(F.col("props"))).otherwise(F.array().cast("array<string>"))
        .alias("leaked_spans"),
        (~pur).alias("is_accurate"),
        F.when(pur, F.array(uid)).otherwise(F.array().cast("array<string>")).alias("over_encrypted"),
        (F.col("value") < 200).alias("is_fluent"),
        (F.get_json_object("props", "$.k").try_cast("int") % 3).alias("cache_hits"),
    )


def param_control(spark, sf_dir):
    """WN-5: sensitivity and threshold after every validation."""
    return _r(CT.param_trace(_event_validations(spark, sf_dir)))


def focus_list(spark, sf_dir):
    """WN-4: missed-type focus list after every validation."""
    ev = read_table(spark, sf_dir, "events")
    spans = ev.select(F.col("event_id").alias("doc_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.col("props").alias("span"), F.upper("event_type").alias("phi_type")),
        F.struct(F.lit(1).alias("pos"), F.col("user_id").cast("string").alias("span"), F.lit("USER").alias("phi_type")),
    )).alias("s")).select("doc_id", "s.*")
    f = CT.focus_trace(_event_validations(spark, sf_dir), spans)
    return f.select("seq", F.array_join("phi_types_focus", ",").alias("phi_types_focus"))


# ---------------------------------------------------------------- pattern memory
def _event_feedback(spark, sf_dir, per_user: bool) -> tuple[DataFrame, DataFrame]:
    ev = read_table(spark, sf_dir, "events")
    label = F.concat_ws("_", "event_type", F.col("user_id").cast("string")) if per_user else F.col("event_type")
    thr = 30.0 if per_user else 10.0
    fb = ev.select(F.col("event_id").alias("seq"), label.alias("label"), (F.col("value") >= thr).alias("correct"))
    labels = fb.groupBy("label").agg(F.min("seq").alias("first_seq"))
    pats = labels.select(
        "label", F.col("first_seq").cast("int").alias("pattern_seq"), F.lit(r"\d+").alias("regex"),
        F.lit("ID_NUMBER").alias("phi_type"), F.lit(None).cast("string").alias("abstraction_role"),
        F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("misses"),
        F.lit(0.5).alias("confidence"), F.lit(False).alias("promoted"), F.lit(None).cast("date").alias("last_updated"))
    return pats, fb


def pattern_feedback(spark, sf_dir):
    """AG-14: counters and confidence per label after the feedback stream."""
    pats, fb = _event_feedback(spark, sf_dir, False)
    out = MEM.apply_feedback(pats, fb, day="2026-01-01")
    return _r(out.select("label", "hits", "misses", "confidence", "promoted"))


def pattern_promote(spark, sf_dir):
    """WN-3: first step at which each label is promoted (running counts)."""
    pats, fb = _event_feedback(spark, sf_dir, True)
    fbj = fb.withColumn("_h", F.col("correct").cast("long")).withColumn("_m", (~F.col("correct")).cast("long"))
    run = RUN.running_sums(fbj, ["label"], "seq", ["_h", "_m"])
    ok = (F.col("run__h") >= 20) & ((F.col("run__h") / (F.col("run__h") + F.col("run__m"))) > 0.75)
    return run.groupBy("label").agg(F.min(F.when(ok, F.col("seq"))).alias("promoted_at"),
                                    F.sum("_h").alias("hits"), F.sum("_m").alias("misses"))


def pattern_prune_cap(spark, sf_dir):
    """FLT-6 + SO-3 after feedback on per-user labels."""
    pats, fb = _event_feedback(spark, sf_dir, True)
    out = MEM.cap(MEM.prune(MEM.apply_feedback(pats, fb, day="2026-01-01")))
    return _r(out.select("label", "hits", "misses", "confidence", "promoted"))


def pattern_stats(spark, sf_dir):
    """AG-11 over the seed table merged with learned patterns."""
    return _r(MEM.stats(_warm_patterns(spark, sf_dir)))


def pattern_learn(spark, sf_dir):
    """MK-10: shapes learned from detector spans flagged as learnable."""
    return _learned_table(spark, sf_dir).select("label", "regex", "phi_type", "support", "confidence", "promoted")


def seed_merge(spark, sf_dir):
    """SRC-7 / ST-4: seeds inserted where absent into the learned table."""
    learned = _learned_table(spark, sf_dir).drop("support").withColumn("last_updated", F.lit(None).cast("date"))
    merged = MEM.insert_if_absent(learned, PS.seed_patterns(spark))
    return _r(merged.select("label", "pattern_seq", "phi_type", "hits", "misses", "confidence", "promoted"))


def _event_memory(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Patterns of one event type, sightings and feedback of all, one event a sentence: labels come, go and come back."""
    ev = read_table(spark, sf_dir, "events")
    kind = F.col("user_id") % 8
    told = ev.select(F.concat_ws("_", "event_type", kind.cast("string")).alias("label"), F.col("event_id").alias("seq"), "event_type",
                     (F.col("value") >= 20 + 25 * kind).alias("correct"), (F.col("value") >= 40).alias("sighted"))
    pats = told.filter("event_type = 'view'").select("label").distinct().select(
        "label", F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("misses"), F.lit(C.NEW_PATTERN_CONFIDENCE).alias("confidence"),
        F.lit(False).alias("promoted"))
    return pats, told.filter("sighted").select("label", "seq"), told.select("label", "seq", "correct")


def memory_growth(spark, sf_dir):
    """WN-2: pattern-table stats after every 50th sentence, with inserts, prunes and re-inserts."""
    return _r(LC.growth(*_event_memory(spark, sf_dir)))


def pattern_history(spark, sf_dir):
    """WN-2 / FLT-6 / ST-4: when each pattern was inserted, pruned and first promoted, by life."""
    trace = LC.replay(*_event_memory(spark, sf_dir))
    lives = trace.groupBy("label", "since").agg(
        F.max(F.when(F.col("kind") == LC.PRUNE, F.col("seq"))).alias("pruned_at"),
        F.min(F.when(F.col("d_promoted") > 0, F.col("seq"))).alias("promoted_at"),
        F.count_if(F.col("kind") == LC.FEEDBACK).alias("observations"))
    return lives.select("label", F.col("since").alias("inserted_at"), "pruned_at", "promoted_at", "observations")


# ---------------------------------------------------------------- audit and counters
def attack_rate(spark, sf_dir):
    """MK-13: reconstruction audit per system from guess replies."""
    o = _compared(spark, sf_dir)
    # the adversary replies are derived from the same rows: attach, do not re-join
    return _r(EV.attack(o.withColumn("raw", replies.guess_raw_column(F.col("masked")))))


def run_counters(spark, sf_dir):
    """AG-12/13: run totals over the masked table with validation."""
    n = _notes(spark, sf_dir)
    d = MJ.attach_detections(n, replies.detect_raw(n))
    m = MJ.mask_corpus(d, seed_inline(0.75), _secret(spark), with_detections=True)
    enc = F.transform(F.filter("spans", lambda s: s["action"] == "encrypt"), lambda s: s["span"])
    v = CT.reward_columns(CT.parse_validation(replies.critic_raw(n), m.select("seq", "doc_id", "cache_hits", enc.alias("encrypted"))))
    j = m.select("doc_id", "cache_hits", "cache_misses", *M.mask_counts("spans")).join(
        v.select("doc_id", "total_reward", F.size("leaked_spans").alias("n_leaked")), "doc_id", "left")
    return _r(j.agg(
        F.count(F.lit(1)).alias("total_sentences"), F.sum("span_count").alias("total_spans"),
        F.sum("encrypted_count").alias("total_encrypted"), F.sum("abstracted_count").alias("total_abstracted"),
        F.sum("cache_hits").alias("total_cache_hits"), F.sum("cache_misses").alias("total_cache_misses"),
        F.sum("total_reward").alias("total_reward"), F.sum("n_leaked").alias("missed_phi_count")))



def span_feedback(spark, sf_dir):
    """FLT-8 + JN-9 + AG-14: applied spans with a label scored by the critic's
    leaked/over-encrypted lists, folded into the seed table."""
    n = _notes(spark, sf_dir)
    m = MJ.mask_corpus(n, seed_inline(0.75), _secret(spark))
    enc = F.transform(F.filter("spans", lambda s: s["action"] == "encrypt"), lambda s: s["span"])
    v = CT.parse_validation(replies.critic_raw(n), m.select("seq", "doc_id", "cache_hits", enc.alias("encrypted")))
    sp = m.select("doc_id", "seq", F.posexplode_outer("spans").alias("pos", "s")).filter("pos IS NOT NULL")
    sp = sp.join(v.select("doc_id", "leaked_spans", "over_encrypted"), "doc_id").select(
        (F.col("seq") * F.lit(SPAN_ORDER) + F.col("pos")).alias("seq"), F.col("s.span").alias("span"),
        F.col("s.label").alias("label"), "leaked_spans", "over_encrypted")
    fb = MEM.feedback_from_spans(sp)
    out = MEM.apply_feedback(PS.seed_patterns(spark), fb, day="2026-01-01", block=SPAN_ORDER << 12)
    return _r(out.select("label", "hits", "misses", "confidence", "promoted"))


def role_writeback(spark, sf_dir):
    """JN-4: the replacement chosen for a span found by a role-less pattern
    becomes that pattern's role; the first one stays.  A span without a
    phrase gets ``[REDACTED]``, which is written back too (as the reference
    does when its phrase call fails)."""
    n = _notes(spark, sf_dir)
    warm = _warm_patterns(spark, sf_dir)
    m = MJ.mask_corpus(MJ.attach_phrases(n, replies.phrases(n)), PS.inline_patterns(warm, 0.0), _secret(spark),
                       with_phrases=True)
    ph = m.select("seq", F.posexplode_outer("spans").alias("pos", "s")).filter(
        F.col("s.label").isNotNull() & (F.col("s.action") == "abstract")) \
        .select("seq", "pos", F.col("s.label").alias("label"), F.col("s.replacement").alias("phrase"))
    roleless = warm.filter(F.col("abstraction_role").isNull()).select("label")
    ph = ph.join(roleless, "label", "left_semi")
    return MEM.write_back_roles(warm, ph).select("label", "phi_type", "abstraction_role")


def system_fallback(spark, sf_dir):
    """PRJ-6: every (system, sample) present; the text, without predictions, where a
    system failed (here on every fifth document) or gave nothing at all."""
    n = _notes(spark, sf_dir)
    o = _outputs(spark, sf_dir, ("ner",)).filter(F.col("doc_id") % 5 != 2)
    fb = EV.with_fallback(n, o, ["ner", "absent_system"])
    return fb.select("system", "doc_id", "masked", F.size("pred").alias("n_pred"), "fallback")



def utility_scores(spark, sf_dir):
    """SC-7 per document of the masked ``documents`` corpus (whole texts)."""
    m = _masked(spark, _docs(spark, sf_dir))
    t = m.select("doc_id", tokens(F.col("text")).alias("_ot"), token_set(F.col("masked")).alias("_ms"))
    return _r(t.select("doc_id", utility_from_tokens("_ot", "_ms").alias("utility")))


def quasi_risk_scores(spark, sf_dir):
    """SC-9 per document of the masked ``documents`` corpus (whole texts)."""
    m = _masked(spark, _docs(spark, sf_dir))
    t = m.select("doc_id", tokens(F.col("text")).alias("_ot"), token_set(F.col("masked")).alias("_ms"))
    return _r(t.select("doc_id", quasi_from_tokens("_ot", "_ms").alias("quasi_risk")))


def exact_leakage(spark, sf_dir):
    """SC-12 per note and system: a truth value still verbatim in the masked text."""
    o = _outputs(spark, sf_dir, ("cold", "regex"))
    gt = F.transform("phi_spans", lambda s: s["span"])
    return o.select("system", "doc_id", F.when(leak_expr(F.col("masked"), gt), 1).otherwise(0).alias("leakage"))



def cold_warm_detection(spark, sf_dir):
    """MK-12: the pipeline with the seeds alone (cold) against the one that has learned before each sample (warm)."""
    rec = EV.records(_compared(spark, sf_dir, ("cold", "warm")), keep=("cache_misses",))
    return _r(rec.groupBy("system").agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.sum("tp").alias("tp"), F.avg("utility").alias("utility"), F.count(F.lit(1)).alias("n"),
        F.sum("cache_hits").alias("cache_hits"), F.sum("cache_misses").alias("cache_misses")))



def _digits_system(samples: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """A masker of long numbers, registered beside the library's own systems."""
    runs = F.regexp_extract_all("text", F.lit(LONG_NUMBER), 0)
    pred = F.transform(runs, lambda x: F.struct(x.alias("span"), F.lit(C.UNKNOWN_TYPE).alias("phi_type")))
    return samples.select(F.lit(names[0]).alias("system"), "doc_id", F.regexp_replace("text", LONG_NUMBER, C.REDACTED.replace("$", "\\$")).alias("masked"),
                          pred.cast(EV.PRED_T).alias("pred"), F.lit(0).alias("cache_hits"), F.lit(0).alias("cache_misses"))


def _no_system(samples: DataFrame, names: tuple[str, ...]) -> DataFrame:
    raise RuntimeError("the model of this system is not there")


def _dataset_comparison(spark, sf_dir) -> DataFrame:
    secret = _secret(spark)
    known = {"notes": _notes(spark, sf_dir),
             "annotated": corpus.load_annotated(corpus.raw_annotated(spread(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name"))))}
    wide = lambda samples, names: EV.systems_wide(samples, secret, names, seed_inline(None), C.MIN_CONFIDENCE_DEFAULT)
    compared = EV.Comparison().register(("cold", "regex"), wide).register(("digits",), _digits_system).register(("absent",), _no_system)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # "absent" fails on purpose
        return compared.outputs(known, ("notes", "unheard of", "annotated"))


def benchmark_detection(spark, sf_dir):
    """MK-12 / UDF-2 / JN-11 / SNK-4: registered systems over several datasets, one that fails scored as the fallback."""
    return _r(EV.benchmark_tables(_dataset_comparison(spark, sf_dir), wanted=("detection",))["detection"])


def benchmark_per_type(spark, sf_dir):
    """AG-5 by dataset, system and type for the same comparison."""
    return _r(EV.benchmark_tables(_dataset_comparison(spark, sf_dir), wanted=("per_type",))["per_type"])


def negative_control(spark, sf_dir):
    """The corpus job over ``conversations`` (every turn, whole text): a
    negative control where the seeds should find (almost) nothing."""
    conv = spread(read_table(spark, sf_dir, "conversations"))
    docs = conv.select((F.shiftleft("conv_id", 32) + F.col("turn")).alias("doc_id"), "conv_id", "turn", "text") \
        .filter(F.col("text").isNotNull())
    m = MJ.mask_corpus(docs, seed_inline(0.75), _secret(spark))
    return m.select("conv_id", "turn", "cache_hits", *M.mask_counts("spans"),
                    (F.col("masked") == F.col("text")).alias("unchanged"))


def _normalized(fn):
    """Integer outputs widened to bigint so both engines report one integer type."""
    from pyspark.sql import types as T

    def run(spark, sf_dir):
        df = fn(spark, sf_dir)
        small = (T.IntegerType, T.ShortType, T.ByteType)
        return df.select(*[F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, small)
                           else F.col(f.name) for f in df.schema.fields])

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


QUERIES = {
    "pattern_scan": pattern_scan,
    "pattern_offsets": pattern_offsets,
    "pattern_scan_notes": pattern_scan_notes,
    "span_dedup": span_dedup,
    "span_route": span_route,
    "mask_routed": mask_routed,
    "mask_documents": mask_documents,
    "mask_all": mask_all,
    "detector_parse": detector_parse,
    "cache_misses": cache_misses,
    "reply_rejects": reply_rejects,
    "skip_gate": skip_gate,
    "mask_with_detector": mask_with_detector,
    "mask_regex_baseline": mask_regex_baseline,
    "mask_full_encryption": mask_full_encryption,
    "mask_offsets": mask_offsets,
    "mask_sequential": mask_sequential,
    "label_map": label_map,
    "corpus_load": corpus_load,
    "vault_roundtrip": vault_roundtrip,
    "vault_unmatched": vault_unmatched,
    "vault_import": vault_import,
    "exact_metrics": exact_metrics,
    "overlap_metrics": overlap_metrics,
    "per_type_exact": per_type_exact,
    "per_type_overlap": per_type_overlap,
    "micro_macro": micro_macro,
    "security_by_system": security_by_system,
    "detection_by_system": detection_by_system,
    "evaluation_records": evaluation_records,
    "system_latency": system_latency,
    "mean_latencies": mean_latencies,
    "report_by_type": report_by_type,
    "pattern_state": pattern_state,
    "latency_stats": latency_stats,
    "scale_windows": scale_windows,
    "critic_reward": critic_reward,
    "param_control": param_control,
    "focus_list": focus_list,
    "pattern_feedback": pattern_feedback,
    "pattern_promote": pattern_promote,
    "pattern_prune_cap": pattern_prune_cap,
    "pattern_stats": pattern_stats,
    "pattern_learn": pattern_learn,
    "seed_merge": seed_merge,
    "memory_growth": memory_growth,
    "pattern_history": pattern_history,
    "attack_rate": attack_rate,
    "run_counters": run_counters,
    "span_feedback": span_feedback,
    "role_writeback": role_writeback,
    "system_fallback": system_fallback,
    "utility": utility_scores,
    "quasi_risk": quasi_risk_scores,
    "exact_leakage": exact_leakage,
    "cold_warm_detection": cold_warm_detection,
    "benchmark_detection": benchmark_detection,
    "benchmark_per_type": benchmark_per_type,
    "negative_control": negative_control,
}
QUERIES = {k: _normalized(v) for k, v in QUERIES.items()}
