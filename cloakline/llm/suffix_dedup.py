"""Suffix-array dedup: distributed prefix doubling that ranks only what is still ambiguous.

Every 100-byte string that also starts earlier (smaller ``doc_id``, or same
document, earlier start) is removed.  Positions are ranked by names of their
prefixes at doubled lengths, 32, 64 and 100 bytes.  In each round (name,
position) pairs are dealt by their names and sorted, the first of equals stands
for all, and only positions whose name is neither unique nor settled go on to
the next length.

Two things keep the sorts small.  Neighbouring positions are ranked together
as a run when they share an anchor (``byte_names``): a run whose anchor occurs
once holds no repeated string, and of runs equal in all bytes each but the
first is repeated as a whole.  Runs with equal anchors and different
surroundings are the ambiguous ones; at 100 bytes a run is a single string, so
nothing is left open.  And copies within one slice of a task are settled
there, so that however often a passage occurs, few of its runs are shuffled.

A slice sends its runs as packed columns, one blob for each bucket of names.
There are as many buckets as it takes for each to be sorted in little memory,
so a round costs the same for each byte whatever the size of the table.  An
anchor with very many different runs in a slice (a common line) would fill its
bucket: such runs are dealt by all their bytes, their anchor's bucket gets a
mark, and the few first ones meet those of other slices in a step of their own.

A Bloom filter (bounded, see ``bloom``) tells which runs are still open when the
texts are read again; what it reports wrongly costs a row, never a result.

Defined cases: a null text is empty; a text under 100 bytes loses nothing; a
null ``doc_id`` sorts first; different texts of one ``doc_id`` are ordered by
their CRC-32, and rows that repeat both id and text have the same position:
they get the same result and do not remove each other; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakline.llm import bloom
from cloakline.llm.byte_names import THRESHOLD, runs
from cloakline.llm.common import documents, mix, slices, trimmed, written

LENGTHS = (32, 64, 100)   # of the names, doubling up to the threshold
SLICE = 8 << 20           # bytes in which copies are settled before anything is shuffled; of single strings, a quarter
BATCH = 2048              # rows of text or blobs that a task takes at a time
BUCKETS, BUCKET = 256, 1 << 18  # buckets of names at least; runs expected in one at most
MANY = 32                 # different runs with one anchor in a slice, from which they are dealt by all their bytes
#: Columns of a blob. at: start * 256 + number of strings; flags: of the id, of an anchor with MANY runs, of the mark for its bucket.
COLUMNS = {"name": np.uint64, "region": np.uint64, "doc_id": np.int64, "tie": np.uint32, "at": np.int64, "flags": np.uint8}
NULL_ID, DEALT, MARKED = np.uint8(1), np.uint8(2), np.uint8(4)
SETTLED, OPEN, PENDING = 0, 1, 2
#: runs: a blob; spans: several ``at`` of one text, settled
SENT = "bucket int, runs binary, doc_id long, tie long, spans binary"
FOUND = "doc_id long, tie long, at long, spans binary, name long, region long, id long, state byte"


def _bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each starts and the last ends."""
    held = pc.fill_null(text, "").cast(pa.large_binary())
    ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset:held.offset + len(held) + 1]
    raw = held.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _number(ids: pa.Array) -> np.ndarray:
    """Ids as longs; null is as small as can be."""
    return pc.fill_null(ids, -(1 << 63)).to_numpy(zero_copy_only=False)


def _identity(name: np.ndarray, region: np.ndarray, doc: np.ndarray, tie: np.ndarray, at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(name ^ mix(region + mix(doc.view(np.uint64) + mix(tie.view(np.uint64) + mix(at.view(np.uint64))))))


def _texts(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """One hash for each text."""
    with np.errstate(over="ignore"):
        return mix(doc.view(np.uint64) + mix(tie.view(np.uint64)))


def ranked(batch: pa.RecordBatch, opened: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """Runs of a slice at length LENGTHS[len(opened)], among the strings still open after the rounds before.

    ``opened`` has a filter of the open runs and one of the texts that hold any, for each round before; a text
    that the last one does not know is not looked at.  ``settled`` are runs that an earlier equal run of the slice
    settles, ``on`` the first ones, in the order of their names.
    """
    data, ends = _bytes(batch.column("text"))
    doc_id, tie = _number(batch.column("doc_id")), batch.column("tie").to_numpy(zero_copy_only=False)
    at, count = ends[:-1], np.maximum(np.diff(ends) - THRESHOLD + 1, 0)
    if opened:
        count = np.where(bloom.reported(_texts(doc_id, tie), opened[-1][1]), count, 0)
    for level in range(len(opened) + 1):
        name, region, place, n = runs(data, at[count > 0], count[count > 0], LENGTHS[level])
        doc = np.searchsorted(ends, place, "right") - 1
        start = place - ends[doc]
        packed = start * 256 + n
        if level < len(opened):
            on = bloom.reported(_identity(name, region, doc_id[doc], tie[doc], packed), opened[level][0])
            at, count = place[on], n[on]
    order, head, later = _groups(name, region, doc_id[doc], tie[doc], packed)
    return {"name": name, "region": region, "doc": doc, "at": packed, "settled": order[later], "on": order[head], "doc_id": doc_id, "tie": tie}


def _groups(name: np.ndarray, region: np.ndarray, *position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by name, region and position; in it, which are the first of equal runs and which equal an earlier one elsewhere."""
    order = np.argsort(name)
    same = name[order[1:]] == name[order[:-1]]
    again = np.flatnonzero(np.append(same, False) | np.append(False, same)[:len(order)])  # names that occur once need no more
    pick = order[again]
    pick = order[again] = pick[np.lexsort((*(x[pick] for x in position[::-1]), region[pick], name[pick]))]
    head = np.ones(len(pick), bool)
    head[1:] = (name[pick[1:]] != name[pick[:-1]]) | (region[pick[1:]] != region[pick[:-1]])
    first = pick[np.maximum.accumulate(np.where(head, np.arange(len(pick)), 0))]
    heads, later = np.ones(len(order), bool), np.zeros(len(order), bool)
    heads[again] = head
    for x in position:  # a row that repeats id and text is neither
        later[again] |= x[pick] != x[first]
    return order, heads, later


def _spread(hashes: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((mix(hashes) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _packed(r: dict, null: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """The first runs of a slice as one blob for each bucket."""
    on, doc = r["on"], r["doc"][r["on"]]
    columns = {"name": r["name"][on], "region": r["region"][on], "doc_id": r["doc_id"][doc], "tie": r["tie"][doc], "at": r["at"][on],
               "flags": null[doc] * NULL_ID}
    bucket = _spread(columns["name"], buckets)
    new = np.append(True, columns["name"][1:] != columns["name"][:-1])[:len(on)]
    size = np.diff(np.append(np.flatnonzero(new), len(on)))
    many = np.repeat(size >= MANY, size)
    if many.any():
        columns["flags"][many] |= DEALT
        marks = many & new
        bucket = np.append(bucket, bucket[marks])
        with np.errstate(over="ignore"):
            bucket[:len(on)][many] = _spread(columns["name"][many] + mix(columns["region"][many]), buckets)
        columns = {k: np.append(v, v[marks]) for k, v in columns.items()}
        columns["flags"][len(on):] = MARKED
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    held = [columns[k][order].astype(kind) for k, kind in COLUMNS.items()]
    blobs = [b"".join([c[a:z].tobytes() for c in held]) for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=False)]
    return bucket[order][cut], blobs


def _unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(kind).itemsize for kind in COLUMNS.values())
    sizes, base, out = [len(b) // width for b in blobs], 0, {}
    for k, kind in COLUMNS.items():
        out[k] = np.concatenate([np.frombuffer(b, kind, n, base * n) for b, n in zip(blobs, sizes, strict=True)])
        base += np.dtype(kind).itemsize
    return out


def _pairs(docs: DataFrame, opened: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """Rows of SENT: the runs of each slice, and per document what the slice settled."""
    shared = docs.sparkSession.sparkContext.broadcast(opened)
    kinds = pa.schema([("bucket", pa.int32()), ("runs", pa.binary()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("spans", pa.binary())])
    most = SLICE if len(opened) + 1 < len(LENGTHS) else SLICE // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = shared.value
        for batch in slices(batches, most=most):
            r = ranked(batch, opened)
            bucket, blobs = _packed(r, pc.is_null(batch.column("doc_id")).to_numpy(zero_copy_only=False), buckets)
            none = pa.nulls(len(blobs), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(blobs, pa.binary()), none, none, pa.nulls(len(blobs), pa.binary())],
                                             schema=kinds)
            done = r["settled"]
            if len(done):
                done = done[np.argsort(r["doc"][done], kind="stable")]
                cut = np.flatnonzero(np.diff(r["doc"][done])) + 1
                own = r["doc"][done][np.concatenate([[0], cut])]
                doc = pa.array(own)
                yield pa.RecordBatch.from_arrays([
                    pa.array(_spread(r["doc_id"][own].view(np.uint64), buckets)), pa.nulls(len(own), pa.binary()),
                    batch.column("doc_id").take(doc), batch.column("tie").take(doc),
                    pa.array([x.tobytes() for x in np.split(r["at"][done], cut)], pa.binary())], schema=kinds)

    return docs.mapInArrow(run, SENT)


def sorted_bucket(r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which runs of a bucket are settled, open or pending (dealt by all their bytes, or with an anchor that has such runs), and their state."""
    marked = r["flags"] & MARKED > 0
    marks = np.unique(r["name"][marked])
    if len(marks):
        r.update({k: v[~marked] for k, v in r.items()})
    order, head, later = _groups(r["name"], r["region"], r["doc_id"], r["tie"], r["at"])
    name = r["name"][order]
    pending = r["flags"][order] & DEALT > 0
    if len(marks):
        pending |= np.isin(name, marks)
    state = np.full(len(order), -1, np.int8)
    state[later] = SETTLED
    lead = np.flatnonzero(head)
    same = name[lead[1:]] == name[lead[:-1]]
    state[lead[np.append(same, False) | np.append(False, same)[:len(lead)]]] = OPEN  # anchors with different surroundings
    state[head & pending] = PENDING
    keep = state >= 0
    return order[keep], state[keep]


def _marks(pairs: DataFrame) -> DataFrame:
    """Sort the pairs of each bucket: the first of equal runs stands for them, the others are settled."""
    kinds = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("at", pa.int64()), ("spans", pa.binary()), ("name", pa.int64()),
                       ("region", pa.int64()), ("id", pa.int64()), ("state", pa.int8())])

    def whole(blobs: list[bytes]) -> pa.RecordBatch:
        r = _unpacked(blobs)
        at, state = sorted_bucket(r)
        r = {k: v[at] for k, v in r.items()}
        same = _identity(r["name"], r["region"], r["doc_id"], r["tie"].astype(np.int64), r["at"])
        wait, done = state != PENDING, state == SETTLED
        return pa.RecordBatch.from_arrays([
            pa.array(r["doc_id"], mask=r["flags"] & NULL_ID > 0), pa.array(r["tie"].astype(np.int64)), pa.array(r["at"]),
            pa.nulls(len(at), pa.binary()), pa.array(r["name"].view(np.int64), mask=wait), pa.array(r["region"].view(np.int64), mask=wait),
            pa.array(same.view(np.int64), mask=done), pa.array(state)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None
        for batch in batches:
            local = pc.is_valid(batch.column("spans"))
            done = batch.filter(local)
            if len(done):
                none = pa.nulls(len(done), pa.int64())
                yield pa.RecordBatch.from_arrays([done.column("doc_id"), done.column("tie"), none, done.column("spans"), none, none, none,
                                                  pa.array(np.full(len(done), SETTLED, np.int8))], schema=kinds)
                batch = batch.filter(pc.invert(local))
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                if bucket != own and held:
                    yield whole(held)
                    held = []
                own = bucket
                held.append(blob)
        if held:
            yield whole(held)
        trimmed()

    return pairs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND)


def _met(pending: DataFrame) -> DataFrame:
    """Pending runs, one or two of each kind: the first is open, the other one settled."""
    where = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("doc_id"), "tie", "at")
    rows = pending.withColumn("_at", where).withColumn("_first", F.min("_at").over(Window.partitionBy("name", "region")))
    return rows.withColumn("state", F.when(F.col("_at") == F.col("_first"), F.lit(OPEN)).otherwise(F.lit(SETTLED)).cast("byte")).select(*pending.columns)


def _stored(df: DataFrame, what: str) -> DataFrame:
    """``written``; what the round shuffled goes from the disks as soon as it is written, not when the driver collects its garbage."""
    spark, clean = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        return written(df, what, BATCH)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)


def settled(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, at, spans): the strings that also start earlier, found round by round."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.crc32(F.col("text").cast("binary")))
    strings = rows.agg(F.sum(F.greatest(F.octet_length("text") - THRESHOLD + 1, F.lit(0)).cast("long"))).first()[0] or 0
    opened: list[tuple[np.ndarray, np.ndarray]] = []
    parts = []
    for gram in LENGTHS:
        expected = 2 * strings // (THRESHOLD - gram + 2)
        marks = _stored(_marks(_pairs(rows, list(opened), max(BUCKETS, -(-expected // BUCKET)))), "marks")
        parts.append(marks.where(F.col("state") == SETTLED))
        if gram == LENGTHS[-1]:
            break
        left = marks.where(F.col("state") == OPEN)
        if marks.where(F.col("state") == PENDING).limit(1).count():
            met = _stored(_met(marks.where(F.col("state") == PENDING)), "met")
            parts.append(met.where(F.col("state") == SETTLED))
            left = left.unionByName(met.where(F.col("state") == OPEN))
        size = left.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("at") % 256).alias("strings")).first()
        strings = size.strings or 0
        if not strings:
            break
        runs_open = bloom.counted(left.select("id"), 4 * size.n, 1, store=True)  # every run is asked for, so few wrong reports
        texts = left.select("doc_id", "tie").distinct()
        texts_open = bloom.counted(texts, texts.count(), 1, lambda batch: _texts(
            _number(batch.column("doc_id")), batch.column("tie").to_numpy(zero_copy_only=False)), store=True)
        opened.append((runs_open, texts_open))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select("doc_id", "tie", "at", "spans")


def removed(docs: DataFrame, kept: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the text that is left, as bytes."""
    marks = settled(docs).groupBy("doc_id", "tie").agg(F.collect_list("at").alias("_at"), F.collect_list("spans").alias("_spans"))
    marks = marks.withColumnsRenamed({"doc_id": "_id", "tie": "_tie"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.crc32(F.col("text").cast("binary")))
    rows = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * kept]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            data, ends = _bytes(batch.column("text"))
            several = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(batch.column("_at")), 0).to_numpy(zero_copy_only=False)))
            ats = pc.list_flatten(batch.column("_at")).to_numpy(zero_copy_only=False)
            for k, spans in enumerate(batch.column("_spans").to_pylist()):
                own = data[ends[k]:ends[k + 1]]
                at = np.concatenate([ats[several[k]:several[k + 1]], *(np.frombuffer(s, np.int64) for s in spans or [])])
                if not len(at):
                    out.append((len(own), 0, 0, hashlib.sha256(own).hexdigest(), *[own.tobytes()] * kept))
                    continue
                at = np.sort(at)
                lo, hi = at // 256, np.maximum.accumulate(at // 256 + at % 256 - 1 + THRESHOLD)
                apart = lo[1:] > hi[:-1]
                lo, hi = lo[np.append(True, apart)], hi[np.append(apart, True)]
                left = b"".join([own[a:z] for a, z in zip([0, *hi.tolist()], [*lo.tolist(), len(own)], strict=True)])
                out.append((len(own), int((hi - lo).sum()), len(lo), hashlib.sha256(left).hexdigest(), *[left] * kept))
            columns = zip(zip(*out, strict=True), [*[pa.int64()] * 3, pa.string(), *[pa.binary()] * kept], strict=True)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in columns)], names=names)

    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.select("doc_id", "text", "_at", "_spans").mapInArrow(cut, kinds + ", kept binary" * kept)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir), kept=False)


#: Every 100-byte string written out and numbered in order (fit for the small table only).
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS i,
        unnest(list_transform(range(0, length(h) // 2 - 99), lambda i: substr(h, 2 * i + 1, 200))) AS s FROM d),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM f),
k AS (SELECT *, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM k GROUP BY doc_id, k),
parts AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
gone AS (
  SELECT doc_id, sum(b - a) AS n, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
