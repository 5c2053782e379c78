"""Pattern memory along the sentences against a table that is changed sentence by sentence."""

import random

import pytest
from pyspark.sql import functions as F

from cloakline.operators import lifecycle as LC
from cloakline.plans import evaluate as EV
from cloakline.schemas import PATTERNS
from cloakline.sources import patterns as PS
from mask_samples import samples

TABLE = "label string, hits long, misses long, confidence double, promoted boolean"


def sentence_by_sentence(start, sightings, feedback, probes, last, every):
    """States that the probes found, and the snapshots."""
    table = {label: [h, m, c, p, -1] for label, h, m, c, p in start}
    found, shots, lives = {}, [], []
    for s in range(last + 1):
        for label in probes.get(s, ()):
            found[label, s] = tuple(table[label][2:]) if label in table else None
        for label in sightings.get(s, ()):
            table.setdefault(label, [0, 0, 0.5, False, s])
        for label in [x for x, (h, m, c, *_) in table.items() if c < 0.4 and h + m > 10]:
            lives.append((label, table.pop(label)[4], s))
        for label, correct in feedback.get(s, ()):
            if label in table:
                row = table[label]
                row[0 if correct else 1] += 1
                row[2] = row[0] / (row[0] + row[1])
                row[3] = row[3] or (row[0] >= 20 and row[2] > 0.75)
        if s % every == 0:
            shots.append((s, len(table), sum(r[3] for r in table.values()), sum(r[2] for r in table.values()) / len(table) if table else 0.0))
    return found, shots, lives


def case(seed, labels=6, last=400):
    rng = random.Random(seed)
    names = [f"p{k}" for k in range(labels)]
    rate = {x: rng.choice([0.2, 0.35, 0.45, 0.95]) for x in names}
    start = [("p0", 48, 2, 0.96, True), ("p1", 3, 12, 0.2, False)]
    sightings, feedback, probes = {}, {}, {}
    for s in range(last + 1):
        sightings[s] = [x for x in names if rng.random() < 0.1]
        feedback[s] = [(x, rng.random() < rate[x]) for x in names for _ in range(rng.choice([0, 0, 1, 3]))]
        probes[s] = [x for x in names if rng.random() < 0.2]
    return start, sightings, feedback, probes, last


def tables(spark, start, sightings, feedback, probes):
    flat = [(x, s, k, ok) for s, row in feedback.items() for k, (x, ok) in enumerate(row)]
    return (spark.createDataFrame(start, TABLE), spark.createDataFrame([(x, s) for s, row in sightings.items() for x in row], "label string, seq long"),
            spark.createDataFrame(flat, "label string, seq long, pos long, correct boolean"),
            spark.createDataFrame([(x, s) for s, row in probes.items() for x in row], "label string, seq long"))


@pytest.mark.parametrize(("seed", "chunk"), [(1, LC.CHUNK), (2, 90)])
def test_replay_equals_sentence_by_sentence(spark, seed, chunk):
    start, sightings, feedback, probes, last = case(seed)
    found, shots, lives = sentence_by_sentence(start, sightings, feedback, probes, last, 50)
    pats, seen, told, asked = tables(spark, start, sightings, feedback, probes)
    trace = LC.replay(pats, seen, told, asked, 0, last, chunk).collect()
    got = {(r.label, r.seq): (r.confidence, r.promoted, r.since) if r.alive else None for r in trace if r.kind == LC.PROBE}
    assert got == found
    assert sorted((r.label, r.since, r.seq) for r in trace if r.kind == LC.PRUNE) == sorted(lives) and len(lives) > 10
    assert sum(r.d_total for r in trace) == shots[-1][1] - len(start)
    grown = LC.growth(pats, seen, told, 50, 0, last).orderBy("step").collect()
    assert [tuple(r)[:3] for r in grown] == [x[:3] for x in shots]
    assert all(abs(r.avg_conf - x[3]) < 1e-9 for r, x in zip(grown, shots, strict=True))
    totals = [x[1] for x in shots]
    assert any(a < b for a, b in zip(totals, totals[1:])) and any(a > b for a, b in zip(totals, totals[1:]))


def test_a_bad_pattern_serves_one_more_sentence(spark):
    seen = spark.createDataFrame([("a", 0), ("a", 12), ("a", 13)], "label string, seq long")
    told = spark.createDataFrame([("a", s, False) for s in range(11)] + [(None, 3, True), ("unknown", 4, True)], "label string, seq long, correct boolean")
    asked = spark.createDataFrame([("a", s) for s in range(16)], "label string, seq long")
    trace = LC.replay(spark.createDataFrame([], TABLE), seen, told, asked)
    alive = {r.seq: r.alive for r in trace.filter(F.col("kind") == LC.PROBE).collect()}
    # in from sentence 0, seen by 1 to 11; bad after 10, pruned by 11; sighted again by 12, seen by 13
    assert [s for s in range(16) if alive[s]] == [*range(1, 12), 13, 14, 15]


def test_no_events_and_empty_tables(spark):
    none = spark.createDataFrame([], "label string, seq long, correct boolean")
    pats = spark.createDataFrame([("a", 1, 0, 1.0, False)], TABLE)
    assert LC.replay(pats, none.select("label", "seq"), none).count() == 0
    assert LC.growth(pats, none.select("label", "seq"), none).count() == 0
    assert [tuple(r) for r in LC.growth(pats, none.select("label", "seq"), none, last=60).orderBy("step").collect()] == [(0, 1, 0, 1.0), (50, 1, 0, 1.0)]


def test_a_sample_before_a_promotion_does_not_see_it(spark):
    docs = samples(spark, [(k, f"badge Q{k % 10}-7 and 55{k % 10}-11-2222", []) for k in range(30)])
    learned = spark.createDataFrame([("BADGE", 0, r"\bQ\d-\d\b", "BADGE", None, 0, 0, 0.5, False, None)], PATTERNS)
    seen = spark.createDataFrame([("BADGE", 3)], "label string, seq long")
    told = spark.createDataFrame([("BADGE", s, True) for s in range(5, 30)] + [("SSN_standard", 20, False)] * 20,
                                 "label string, seq long, correct boolean").withColumn("pos", F.monotonically_increasing_id())
    hits = {r.doc_id: r.hits for r in EV.warm_hits(docs, PS.seed_patterns(spark), learned, seen, told, 0.75).collect()}
    labels = {k: [h.label for h in v] for k, v in hits.items()}
    # inserted by 3 at confidence 0.5, right once by 5: at the threshold from 6 on; promoted by its 20th hit, in 24, so from 25 on before the seeds
    assert all("BADGE" not in labels[k] for k in range(6)) and all(labels[k][-1] == "BADGE" for k in range(6, 25))
    assert all(not h.promoted for k in range(6, 25) for h in hits[k] if h.label == "BADGE")
    assert all(labels[k][0] == "BADGE" and hits[k][0].promoted for k in range(25, 30))
    # 48 of 70 after sentence 20: below the threshold from 21 on
    assert all("SSN_standard" in labels[k] for k in range(21)) and all("SSN_standard" not in labels[k] for k in range(21, 30))


def test_detector_spans_and_misses_in_the_pipeline(spark, secret):
    from cloakline.plans import mask_job as MJ
    from cloakline.sources.patterns import seed_inline
    docs = samples(spark, [(1, "Ann Lee called 555-123-4567", [("Ann Lee", "PERSON")]), (2, "no reply here 555-123-4567", [])])
    raw = '[{"span": "Ann Lee", "phi_type": "person", "confidence": 0.9}, {"span": "555-123-4567", "phi_type": "phone", "confidence": 0.9}]'
    told = spark.createDataFrame([(1, "detect", raw)], "doc_id long, kind string, raw string")
    out = EV.systems_wide(MJ.attach_detections(docs, told), secret, ("cold", "regex"), seed_inline(None), detector=True)
    got = {(r.system, r.doc_id): ([p.span for p in r.pred], r.cache_hits, r.cache_misses) for r in out.collect()}
    assert got["cold", 1] == (["555-123-4567", "Ann Lee"], 1, 1) and got["cold", 2] == (["555-123-4567"], 1, 0)
    assert got["regex", 1] == (["555-123-4567"], 0, 0)
