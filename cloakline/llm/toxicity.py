"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

``labels`` say which documents are toxic.  Their grades are ordered: 0 is not
toxic, 1 toxic, 2 toxic with more markers (features that are clearly more
frequent in toxic documents) than the median toxic document.  The model is P(grade > k) = sigmoid(w.x - theta_k) with one weight
vector shared by the ordered thresholds theta_1 < theta_2; x marks the words
that a text has, and the stems (proper beginnings of ``STEMS`` letters) of its
words, since languages that compound words insult by stem.  The output is the
expected severity, the sum of P(grade > k).

The classifier is fitted on a bounded sample: the ``SAMPLE`` labelled documents
with the smallest hash of their id, and of the features whose share differs
clearly (``LEAST_Z`` standard errors) between toxic and other documents the
``VOCABULARY`` clearest.  Every document of the table
is scored on its whole text, on its own, so no key can be hot.

Defined cases: a null, empty or blank text has no features and gets the
severity of the intercepts alone; repeated rows are scored one by one; a label
with a null id or grade is not used; several labels of one document count as
the most severe one; without labels, or with only one class, every severity is
the share of toxic labels (0 without any); an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.llm.common import documents, read_table, slices, written

SAMPLE = 20_000       # labelled documents to fit on
VOCABULARY = 4_000    # features with a weight
LEAST_DOCS = 5        # a feature must occur in so many labelled documents
LEAST_Z = 5.0
STEMS = range(4, 9)
GRADES = 2            # thresholds
PRIOR = 0.02          # precision of the weights' normal prior
STEPS, CONJUGATE = 50, 100
REJECT = 0.5          # expected severity from which a document goes
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_features(word: str) -> list[str]:
    return [word, *(word[:k] + "+" for k in STEMS if k < len(word))]


def features(text: pa.Array, known: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Distinct (row, feature number) pairs of all texts, and the features; only ``known`` ones if given."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(text, "")), _SPLIT)
    flat = pc.list_flatten(lists)
    full = pc.not_equal(flat, "")
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[full.to_numpy(zero_copy_only=False)]
    coded = flat.filter(full).dictionary_encode()
    numbers: dict[str, int] = {}
    if known is None:
        own = [[numbers.setdefault(f, len(numbers)) for f in word_features(w)] for w in coded.dictionary.to_pylist()]
    else:
        own = [[known[f] for f in word_features(w) if f in known] for w in coded.dictionary.to_pylist()]
    count = np.array([len(x) for x in own], np.int64)
    start = np.cumsum(count) - count
    each = np.array([f for x in own for f in x], np.int64)
    word = coded.indices.to_numpy(zero_copy_only=False)
    pair = np.unique(rows.astype(np.int64) << 32 | word)  # each word of a text once
    rows, word = pair >> 32, pair & 0xFFFFFFFF
    n = count[word] if len(count) else np.zeros(0, np.int64)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[word] if len(count) else n, n)
    pair = np.unique(np.repeat(rows, n) << 32 | each[at])
    return pair >> 32, pair & 0xFFFFFFFF, list(numbers)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def exceed(score: np.ndarray, thetas: np.ndarray) -> np.ndarray:
    """P(grade > k) for each k, one column each."""
    return sigmoid(score[:, None] - thetas[None, :])


def fit(rows: np.ndarray, words: np.ndarray, grades: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds of largest penalised likelihood, by Newton steps on all of them.

    ``rows[i]`` has the feature ``words[i]``.  A grade's likelihood is u - l with
    u = P(grade >= own) and l = P(grade > own); its logarithm is concave, and
    each step is solved by conjugate gradients.  The last parameters are the
    base score and each further threshold's distance from the first.
    """
    n, at = len(grades), np.arange(len(grades))
    share = np.array([np.clip((grades > k).mean(), 0.5 / n, 1 - 0.5 / n) for k in range(GRADES)])
    start = -np.log(share / (1 - share))
    v = np.concatenate([np.zeros(size), [-start[0]], np.maximum.accumulate(start[1:] - start[0] + 1e-2)])
    ridge = np.concatenate([np.full(size, PRIOR / n), np.full(GRADES, 1e-6)])
    upper, lower = grades > 0, grades < GRADES
    above, below = np.maximum(grades - 1, 0), np.minimum(grades, GRADES - 1)

    def scores(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores against the threshold below the own grade and the one above it."""
        x, gap = np.bincount(rows, weights=v[words], minlength=n) + v[size], np.append(0.0, v[size + 1:])
        return x - gap[above], x - gap[below]

    def back(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = a + b
        gap = np.bincount(above, weights=a, minlength=GRADES) + np.bincount(below, weights=b, minlength=GRADES)
        return np.concatenate([np.bincount(words, weights=both[rows], minlength=size), [both.sum()], -gap[1:]]) / n

    def shares(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = scores(v)
        return np.where(upper, sigmoid(a), 1.0), np.where(lower, sigmoid(b), 0.0)

    def loss(v: np.ndarray) -> float:
        if (np.diff(np.append(0.0, v[size + 1:])) <= 0).any():
            return np.inf
        u, l = shares(v)
        return -np.log(np.maximum(u - l, 1e-12)).mean() + 0.5 * (ridge * v * v).sum()

    now = loss(v)
    for _ in range(STEPS):
        u, l = shares(v)
        own, du, dl = np.maximum(u - l, 1e-12), u * (1 - u), l * (1 - l)
        aa = du * du / own**2 - du * (1 - 2 * u) / own
        bb = dl * dl / own**2 + dl * (1 - 2 * l) / own
        ab = -du * dl / own**2
        rest = back(du / own, -dl / own) - ridge * v
        step, towards, size2 = np.zeros_like(v), rest.copy(), rest @ rest
        for _ in range(CONJUGATE):
            if size2 < 1e-20:
                break
            a, b = scores(towards)
            bent = back(aa * a + ab * b, ab * a + bb * b) + ridge * towards
            far = size2 / (towards @ bent)
            step, rest = step + far * towards, rest - far * bent
            size2, before = rest @ rest, size2
            towards = rest + size2 / before * towards
        scale = 1.0
        while scale > 1e-6 and not loss(v + scale * step) < now:
            scale /= 2
        if scale <= 1e-6:
            break
        v = v + scale * step
        last, now = now, loss(v)
        if last - now < 1e-8:
            break
    return v[:size], np.append(0.0, v[size + 1:]) - v[size]


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of the sampled documents."""
    rated = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = written(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "rated")
    # ``chosen`` has at most ``sample`` rows of 12 bytes, so only its documents leave the scan
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> dict:
    """{"weights": {feature: weight}, "thetas": [...]} fitted on the bounded sample."""
    own = labelled(docs, labels, sample)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, number, names = features(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(np.bincount(number[toxic[rows]], minlength=len(names))),
                                   pa.array(np.bincount(number, minlength=len(names)))], names=["feature", "a", "n"])

    sizes = own.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("toxic") > 0, 1)).alias("a")).first()
    n1, n0 = sizes.a, sizes.n - sizes.a
    if not n0 or not n1:
        share = n1 / sizes.n if sizes.n else 0.0
        return {"weights": {}, "thetas": np.array([-math.inf if share else math.inf, math.inf])}
    both = own.mapInArrow(counts, "feature string, a long, n long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    share = F.col("n") / (n0 + n1)
    z = (F.col("a") / n1 - (F.col("n") - F.col("a")) / n0) / F.sqrt(share * (1 - share + 1e-6) * (1 / n1 + 1 / n0))
    top = both.where(F.col("n") >= LEAST_DOCS).select("feature", z.alias("z")).where(F.abs("z") >= LEAST_Z)
    signs = {r.feature: r.z > 0 for r in top.orderBy(F.abs("z").desc(), "feature").limit(vocabulary).collect()}  # <= vocabulary rows
    known = sorted(signs)
    number = {f: k for k, f in enumerate(known)}
    marker = np.array([signs[f] for f in known], bool)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, at, _ = features(batch.column("text"), number)
            cut = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            yield pa.record_batch([batch.column("toxic"), pa.array(
                [at[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                names=["toxic", "features"])

    rated = own.mapInArrow(found, "toxic int, features binary").toPandas()  # <= sample rows
    each = [np.frombuffer(f, np.int32) for f in rated["features"]]
    toxic = rated["toxic"].to_numpy(np.int64)
    markers = np.array([marker[e].sum() for e in each])
    shown = markers[(toxic > 0) & (markers > 0)]
    grades = toxic + ((toxic > 0) & (markers > (np.median(shown) if len(shown) else np.inf)))
    rows = np.repeat(np.arange(len(each)), [len(e) for e in each])
    w, thetas = fit(rows, np.concatenate(each), grades, len(known))
    return {"weights": {known[k]: float(w[k]) for k in np.flatnonzero(w)}, "thetas": thetas}


def graded(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` as ``_row`` with ``expected_severity`` and the P(grade > k)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    at = docs.columns.index("text")
    schema = rows.withColumns({"expected_severity": F.lit(0.0), "p_toxic": F.lit(0.0),
                                             "p_severe": F.lit(0.0)}).schema

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thetas = shared.value["weights"], shared.value["thetas"]
        known = {f: k for k, f in enumerate(weights)}
        value = np.array(list(weights.values()))
        texts = (pa.record_batch([b.column(0), b.column(0).field(at)], names=["_row", "_text"]) for b in batches)
        for batch in slices(texts, "_text"):
            rows, number, _ = features(batch.column("_text"), known)
            score = np.bincount(rows, weights=value[number], minlength=batch.num_rows)
            p = exceed(score, thetas)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(p.sum(axis=1)), pa.array(p[:, 0].copy()),
                                              pa.array(p[:, 1].copy())],
                                             names=["_row", "expected_severity", "p_toxic", "p_severe"])

    return rows.mapInArrow(grade, schema)


def clean(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` whose expected severity is below ``reject``, all columns kept as they are."""
    return graded(docs, train(docs, labels)).where(F.col("expected_severity") < reject).select("_row.*")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, expected_severity, p_toxic, p_severe, rejected."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = graded(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return out.select("_row.doc_id", "expected_severity", "p_toxic", "p_severe",
                      (F.col("expected_severity") >= REJECT).alias("rejected"))
