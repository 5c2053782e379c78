"""Pattern memory along the sentences: the state of every pattern as each sentence found it.

Sentence ``seq`` matches with the patterns as they are, then learns (a sighting
inserts its pattern if it is absent, at the starting confidence), then prunes
(FLT-6), and then its feedback arrives.  So a pattern that feedback on sentence t
makes bad is matched once more by sentence t + 1 and pruned there; from t + 2 on
a sighting inserts it again, with new counters.  Promotion is tested at every
feedback row and holds until the pattern is pruned.

``replay`` folds each label's events in order.  The events of a label are cut
into chunks of ``chunk`` rows: one round of the job folds one chunk of every
label side by side and hands each label's state to the next round, so that no
task holds more than a chunk of a label, however many events it has.  Labels
with fewer events (all of them, as a rule) are done in the first round.

Defined cases: rows without a label or ``seq`` are no events; feedback for a
label that is not alive is ignored; sentences are numbered without gaps; the
capacity rule (SO-3) is left to the end of a batch (``memory.cap``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakline import constants as C
from cloakline.operators.running import running_sums
from cloakline.session import cut_lineage

#: what happens to a pattern within one sentence, in this order
PROBE, SIGHTING, PRUNE, FEEDBACK = 0, 1, 2, 3
EVENT = "label string, seq long, kind int, pos long, correct boolean"
#: kind PROBE: the state a sentence found; other kinds: what changed in the table at ``seq``
TRACE = ("label string, seq long, kind int, alive boolean, since long, confidence double, promoted boolean, "
         "d_total long, d_promoted long, d_confidence double")
STATE = "label string, alive boolean, since long, hits long, misses long, confidence double, promoted boolean, doomed long"
CHUNK = 1 << 20
#: executors need pandas, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(C)


def bad(confidence, observations):
    """FLT-6 (columns or numbers)."""
    return (confidence < C.CONFIDENCE_PRUNE_BELOW) & (observations > C.PRUNE_MIN_OBSERVATIONS)


def fold(state: dict, events: Iterator[tuple]) -> Iterator[tuple]:
    """TRACE rows (without the label) of ordered events (seq, kind, correct) of one label; ``state`` is brought up to date."""
    s = state
    for seq, kind, correct in events:
        if s["doomed"] is not None and (seq, kind) > (s["doomed"], PRUNE):
            yield s["doomed"], PRUNE, False, s["since"], s["confidence"], s["promoted"], -1, -int(s["promoted"]), -s["confidence"]
            s.update(alive=False, doomed=None)
        if kind == PROBE:
            yield seq, PROBE, s["alive"], s["since"], s["confidence"], s["promoted"], 0, 0, 0.0
        elif kind == SIGHTING and not s["alive"]:
            s.update(alive=True, since=seq, hits=0, misses=0, confidence=C.NEW_PATTERN_CONFIDENCE, promoted=False)
            yield seq, SIGHTING, True, seq, s["confidence"], False, 1, 0, s["confidence"]
        elif kind == PRUNE and s["alive"] and bad(s["confidence"], s["hits"] + s["misses"]):
            s["doomed"] = seq
        elif kind == FEEDBACK and s["alive"]:
            before, was = s["confidence"], s["promoted"]
            s["hits" if correct else "misses"] += 1
            n = s["hits"] + s["misses"]
            s["confidence"] = s["hits"] / n
            s["promoted"] = was or (s["hits"] >= C.HIT_PROMOTE_THRESHOLD and s["confidence"] > C.PROMOTE_CONFIDENCE_ABOVE)
            s["doomed"] = seq + 1 if bad(s["confidence"], n) else None
            yield seq, FEEDBACK, True, s["since"], s["confidence"], s["promoted"], 0, int(s["promoted"]) - int(was), s["confidence"] - before


def _folded(key: tuple, events: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
    """One chunk of one label: its trace, and its state as a last row of kind -1."""
    state = {"alive": False, "since": -1, "hits": 0, "misses": 0, "confidence": 0.0, "promoted": False, "doomed": None}
    for row in states.itertuples(index=False):
        state = {c: getattr(row, c) for c in state}
        state["doomed"] = None if pd.isna(state["doomed"]) else int(state["doomed"])
    ordered = events.sort_values(["seq", "kind", "pos"], kind="stable")
    rows = list(fold(state, zip(ordered["seq"].tolist(), ordered["kind"].tolist(), ordered["correct"].tolist(), strict=True)))
    out = pd.DataFrame(rows, columns=["seq", "kind", "alive", "since", "confidence", "promoted", "d_total", "d_promoted", "d_confidence"])
    out = out.assign(hits=0, misses=0, doomed=None)
    out.loc[len(out)] = {"seq": 0, "kind": -1, "d_total": 0, "d_promoted": 0, "d_confidence": 0.0, **state}
    return out.assign(label=key[0], doomed=out["doomed"].astype("Int64"))


def replay(patterns: DataFrame, sightings: DataFrame, feedback: DataFrame, probes: DataFrame | None = None,
           first: int = 0, last: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """TRACE of the events of all labels over the sentences ``first`` to ``last`` (default: of the last event).

    ``patterns``: the table before the first sentence.  ``sightings`` and ``probes``: (label, seq); ``feedback``:
    (label, seq, correct) and, where a sentence has several for a label, ``pos``.
    """
    def event(df: DataFrame, kind: int, correct=None, pos=None) -> DataFrame:
        return df.select(F.col("label"), F.col("seq").cast("long").alias("seq"), F.lit(kind).alias("kind"),
                         (F.lit(0) if pos is None else F.col(pos)).cast("long").alias("pos"),
                         (F.lit(None) if correct is None else F.col(correct)).cast("boolean").alias("correct"))

    told = event(feedback, FEEDBACK, "correct", "pos" if "pos" in feedback.columns else None)
    events = told.unionByName(event(sightings.select("label", "seq").distinct(), SIGHTING))
    if probes is not None:
        events = events.unionByName(event(probes.select("label", "seq").distinct(), PROBE))
    worn = patterns.filter(bad(F.col("confidence"), F.col("hits") + F.col("misses"))).withColumn("seq", F.lit(first))
    events = events.unionByName(event(worn, PRUNE)).filter("label IS NOT NULL AND seq IS NOT NULL")
    load = events.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))
    load = load.agg(F.max("n").alias("n"), F.max("last").alias("last")).first()
    if (load.n or 0) > chunk:  # number the events of a label by sentence, so that chunks end between sentences
        sizes = events.groupBy("label", "seq").agg(F.count(F.lit(1)).alias("n"))
        events = cut_lineage(events.join(running_sums(sizes, ["label"], "seq", ["n"]).select(
            "label", "seq", F.floor((F.col("run_n") - F.col("n")) / chunk).cast("long").alias("chunk")), ["label", "seq"]))
    else:
        events = events.withColumn("chunk", F.lit(0))
    chunks = -(-(load.n or 0) // chunk)
    # names of its own, since patterns and events may come from one table
    state = patterns.select(F.col("label").alias("label"), F.lit(True).alias("alive"), F.lit(-1).cast("long").alias("since"), "hits", "misses", "confidence",
                            "promoted", F.lit(None).cast("long").alias("doomed"))
    out = None
    both = TRACE + ", hits long, misses long, doomed long"
    for k in range(chunks):
        now = events.filter(F.col("chunk") == k)
        named = now.select("label").distinct()
        done = cut_lineage(now.groupBy("label").cogroup(state.join(named, "label", "left_semi").groupBy("label"))
                           .applyInPandas(_folded, both))
        new = done.filter("kind = -1").select(*[c.split()[0] for c in STATE.split(", ")])
        state = new if chunks == 1 else state.join(named, "label", "left_anti").unionByName(new)  # a label without events is never due
        trace = done.filter("kind >= 0").select(*[c.split()[0] for c in TRACE.split(", ")])
        out = trace if out is None else out.unionByName(trace)
    if out is None:
        return patterns.sparkSession.createDataFrame([], TRACE)
    # patterns still to be pruned, by a sentence that is there
    end = load.last if last is None else last
    due = state.filter(F.col("alive") & (F.col("doomed") <= F.lit(end).cast("long"))).select(
        "label", F.col("doomed").alias("seq"), F.lit(PRUNE).alias("kind"), F.lit(False).alias("alive"), "since", "confidence", "promoted",
        F.lit(-1).cast("long").alias("d_total"), (-F.col("promoted").cast("long")).alias("d_promoted"), (-F.col("confidence")).alias("d_confidence"))
    return out.unionByName(due)


def growth(patterns: DataFrame, sightings: DataFrame, feedback: DataFrame, every: int = C.SNAPSHOT_EVERY,
           first: int = 0, last: int | None = None) -> DataFrame:
    """WN-2: (step, total, promoted, avg_conf) after the sentences 0, every, 2 * every, ... up to ``last``.

    Every insert, prune, promotion and change of confidence is a signed event; a
    snapshot is the table at the start plus the sums of the buckets up to it.
    """
    ends = [feedback.agg(F.max("seq")).first()[0], sightings.agg(F.max("seq")).first()[0]] if last is None else [last]
    end = max((int(x) for x in ends if x is not None), default=-1)
    trace = replay(patterns, sightings, feedback, None, first, end)
    bucket = F.ceil(F.col("seq") / F.lit(every)).cast("long").alias("b")
    sums = trace.filter(F.col("kind") != PROBE).groupBy(bucket).agg(
        F.sum("d_total").alias("t"), F.sum("d_promoted").alias("p"), F.sum("d_confidence").alias("c"))
    base = patterns.agg(F.count(F.lit(1)).alias("t"), F.count_if("promoted").alias("p"), F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("c")).first()
    steps = patterns.sparkSession.range(end // every + 1 if end >= 0 else 0).select(F.col("id").alias("b"))
    g = steps.join(sums, "b", "left").na.fill({"t": 0, "p": 0, "c": 0.0})
    g = running_sums(g, [], "b", ["t", "p", "c"])
    total = F.col("run_t") + F.lit(base.t)
    return g.select((F.col("b") * every).alias("step"), total.alias("total"), (F.col("run_p") + F.lit(base.p)).alias("promoted"),
                    F.when(total > 0, (F.col("run_c") + F.lit(float(base.c))) / total).otherwise(F.lit(0.0)).alias("avg_conf"))


def as_of(hits: DataFrame, trace: DataFrame, min_confidence: float) -> DataFrame:
    """(doc_id, hits): the hits that each sentence's own version of the table makes, in that version's order.

    ``hits``: (doc_id, seq, hits) of all patterns that ever were; ``trace`` answers the probes of their labels
    (a label it says nothing of has one state, that of its hits).  FLT-3 and SO-1 by sentence: at or above the
    threshold, promoted ones first, then by confidence, then by when they were inserted.
    """
    states = trace.filter(F.col("kind") == PROBE).groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct(
        "label", F.struct("alive", "since", "confidence", "promoted").alias("s")))).alias("_states"))
    seen = F.coalesce("_states", F.create_map().cast("map<string,struct<alive:boolean,since:bigint,confidence:double,promoted:boolean>>"))
    j = hits.join(states, "seq", "left").withColumn("_s", seen)
    found = F.expr("""transform(hits, (h, i) -> named_struct('k', named_struct(
        'a', NOT coalesce(_s[h.label].promoted, h.promoted), 'b', -coalesce(_s[h.label].confidence, h.confidence),
        'c', coalesce(_s[h.label].since, -1), 'd', h.pattern_rank, 'e', i), 'h', named_struct(
        'pattern_rank', h.pattern_rank, 'label', h.label, 'span', h.span, 'phi_type', h.phi_type, 'abstraction_role', h.abstraction_role,
        'promoted', coalesce(_s[h.label].promoted, h.promoted), 'confidence', coalesce(_s[h.label].confidence, h.confidence)),
        'on', coalesce(_s[h.label].alive, true)))""")
    live = F.filter(found, lambda x: x["on"] & (x["h"]["confidence"] >= F.lit(float(min_confidence))))
    return j.select("doc_id", F.transform(F.array_sort(live), lambda x: x["h"]).alias("hits"))
