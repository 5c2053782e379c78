"""MinHash near-dedup with circulant permutations, banding and exact Jaccard verification.

A document's set holds the hashes of its word shingles.  Signatures come from
two permutations: the first sends a shingle to a slot of [0, SLOTS), the second
is a table that coordinate k reads shifted by k places, so all coordinates of a
shingle are one contiguous stretch of the table and the signature is the
element-wise minimum of such stretches.

Stages, all linear in the documents unless said otherwise:

1.  Equal sets are one class, whatever their number; classes carry on.
2.  A Bloom filter over all band hashes drops bands that no other class has.
    Each band bucket links its members to its first one (a star, never all
    pairs); connected stars are candidate groups, outside of which no two
    classes share a band.
3.  Groups are verified on full sets, in blocks of bounded shingles and rows.  A group of
    one block is compared at once.  In a larger one, members are first compared
    with their bucket's first member; what that does not join to the largest
    cluster is compared, block by block, with everything outside its own
    cluster.  Blocks return links that connect, never all pairs.
4.  Components of the verified links give the classes' components.

A link of similarity 0.8 shares a band with probability 1 - 3e-6, higher ones
more surely; verification is exact.  Step 3 is quadratic (over the block size)
only in those members of one group that are not near its bulk.

Defined cases: words are A-Z lower-cased runs of ``[^\\x20\\x09-\\x0D]``; with
fewer words than a shingle has the whole sequence is one; null, empty or blank
texts have an empty set and are linked with nothing; a null ``doc_id`` is never
the smallest unless its component has no other; rows repeating a ``doc_id``
are nodes of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.llm import bloom
from cloakline.llm.common import attach, documents, mix, shingle_sets, slices, written
from cloakline.llm.components import components

BANDS, ROWS = 42, 6           # 252 coordinates
SLOTS = 1 << 21
SEED = 20
BLOCK = 150_000               # shingles in a block
BATCH = 1000                  # rows with texts or sets that reach a task's Python at a time
NEAR = 80                     # percent: intersection against union
MEMBERS = 5000                # rows in a block
STRIPE, TILE = 512, 2048      # rows compared at once with how many others
COLUMNS = 1 << 12             # shingles compared at once


# ------------------------------------------------------------------ signatures
def circulant(seed: int = SEED, slots: int = SLOTS, size: int = BANDS * ROWS) -> np.ndarray:
    """Row s holds the second permutation read from place s on (a view, not a copy)."""
    table = np.random.default_rng(seed).permutation(slots).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:size]]), size)


def signature(shingles: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.full(table.shape[1], np.iinfo(np.uint32).max, np.uint32)
    slots = (shingles >> np.uint64(16)) % np.uint64(SLOTS)  # the first permutation: shingles are hashed already
    for at in range(0, len(slots), 4096):
        np.minimum(out, table[slots[at:at + 4096]].min(axis=0), out=out)
    return out


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit hash per row and band."""
    with np.errstate(over="ignore"):
        out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signatures), 1))
        for r in range(ROWS):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + signatures[:, r::ROWS].astype(np.uint64))
    return out


def text_mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_mark")


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, n_shingles, set_hash (null for an empty set), bands, and the hash ``text_mark`` of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        table = circulant()
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), width)
            bands = band_hashes(np.array([signature(s, table) for s in sets]))
            yield pa.record_batch([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([b.tobytes() for b in bands], pa.binary()), batch.column("text_mark")],
                names=["doc_id", "n_shingles", "set_hash", "bands", "text_mark"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_mark()).mapInArrow(
        run, "doc_id long, n_shingles long, set_hash binary, bands binary, text_mark long")


# ------------------------------------------------------------------ candidates
def _bands(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.uint64)


def bucket_rows(classes: DataFrame, total: int) -> DataFrame:
    """(band, node) for the bands that the filter says another class may have."""
    bits = bloom.counted(classes.select("bands"), total * BANDS, 2, _bands)
    shared = classes.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _bands(batch)
            may = bloom.reported(h, shared.value)
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), BANDS)
            yield pa.record_batch([pa.array(h[may].view(np.int64)), pa.array(node[may])], names=["band", "node"])

    return classes.select("node", "bands").mapInArrow(run, "band long, node long")


def stars(classes: DataFrame, total: int) -> DataFrame:
    """Distinct (node, leader): the first member of each band bucket against its other members."""
    rows = written(bucket_rows(classes, total), "bands")
    buckets = rows.groupBy("band").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("leader")).where("_n > 1")
    met = attach(rows, written(buckets, "buckets"), "band", "_n", total)
    return met.where("leader IS NOT NULL AND leader <> node").select("node", "leader").distinct()


# ------------------------------------------------------------------ verification
def _links(rows: list[dict]) -> list[tuple[int, int]]:
    """Connecting links of at least NEAR percent between rows of different ``cluster``.

    Rows of ``side`` 0 are compared with those of side 1, or with each other
    if there is no side 1: a stripe of rows with a tile of rows at a time, so
    the matrices are bounded whatever the rows and their shingles.
    """
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = count[inverse] > 1  # shingles of one row alone are in no intersection
    owner, column = owner[both], inverse[both]
    ends = np.searchsorted(owner, np.arange(len(sets) + 1))  # entries of row k: ends[k] to ends[k + 1]
    side = np.array([r["side"] for r in rows])
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side)) if side.any() else (np.arange(len(rows)),) * 2
    label = np.unique(np.array([r["cluster"] for r in rows]), return_inverse=True)[1]
    local = np.full(len(values), -1)

    def entries(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``chosen`` and shared shingles of its rows."""
        n = ends[chosen + 1] - ends[chosen]
        place = np.repeat(np.arange(len(chosen)), n)
        return place, column[np.arange(len(place)) + np.repeat(ends[chosen] - (np.cumsum(n) - n), n)]

    def held(place: np.ndarray, at: np.ndarray, height: int, first: int, width: int) -> np.ndarray:
        out = np.zeros((height, width), np.float32)
        here = (at >= first) & (at < first + width)
        out[place[here], at[here] - first] = 1
        return out

    out = []
    for i in range(0, len(left), STRIPE):
        mine = left[i:i + STRIPE]
        my_place, my_columns = entries(mine)
        known = np.unique(my_columns)
        local[known] = np.arange(len(known))
        my_columns = local[my_columns]
        for j in range(0 if side.any() else i, len(right), TILE):
            other = right[j:j + TILE]
            place, at = entries(other)
            at = local[at]  # -1: in no row of the stripe
            inter = np.zeros((len(mine), len(other)))
            for first in range(0, len(known), COLUMNS):
                width = min(COLUMNS, len(known) - first)
                inter += held(my_place, my_columns, len(mine), first, width) @ held(place, at, len(other), first, width).T
            near = (100 + NEAR) * inter >= NEAR * (size[mine][:, None] + size[other][None, :])
            while True:  # each row and column with a near one of another label takes one link, so labels at least halve
                near &= label[mine][:, None] != label[other][None, :]
                by_row, by_column = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                if not len(by_row):
                    break
                a = mine[np.concatenate([by_row, near[:, by_column].argmax(0)])]
                b = other[np.concatenate([near[by_row].argmax(1), by_column])]
                parent = {}

                def find(x: int) -> int:
                    while parent.setdefault(x, x) != x:
                        parent[x] = x = parent[parent[x]]
                    return x

                for x, y, p, q in zip(a.tolist(), b.tolist(), label[a].tolist(), label[b].tolist(), strict=True):
                    p, q = find(p), find(q)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        out.append((rows[x]["node"], rows[y]["node"]))
                renamed = np.arange(label.max() + 1)
                renamed[list(parent)] = [find(x) for x in list(parent)]
                label = renamed[label]
        local[known] = -1
    return out


def verified(blocks: DataFrame) -> DataFrame:
    """Links (a, b) found in each block of rows (key, side, node, cluster, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in slices(batches, "shingles") for row in batch.to_pylist())
        for _, block in groupby(rows, key=lambda r: r["key"]):
            if links := _links(list(block)):
                a, b = zip(*links, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.select("key", "side", "node", "cluster", "shingles").repartition("key").sortWithinPartitions("key").mapInArrow(
        run, "a long, b long")


def _pieces(shingles: Column, rows: Column) -> Column:
    """Number of blocks for so many shingles in so many rows; none for no rows."""
    return F.greatest(F.ceil(shingles / BLOCK), F.ceil(rows / MEMBERS)).cast("int")


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(SEED)), F.col(blocks)).cast("int")


def member_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``members`` (node, root, doc_id, set_hash, ...) with their ``shingles``, made anew from the texts.

    A bounded filter of the members' ids spares the other documents the work.
    """
    total = members.count()
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1).cast("long")))
    bits = bloom.counted(members.select(key), total, 1)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            may = bloom.reported(batch.column("_key").to_numpy(zero_copy_only=False).view(np.uint64), shared.value)
            batch = batch.filter(pa.array(may))
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"), width)]
            yield pa.record_batch([batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()),
                                   pa.array(sets, pa.binary())], names=["_id", "_hash", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_key", key)
    found = rows.mapInArrow(run, "_id long, _hash binary, shingles binary")
    return members.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("set_hash") == F.col("_hash"))).drop("_id", "_hash")


def links(docs: DataFrame, classes: DataFrame, total: int, width: int) -> DataFrame:
    """Connecting links (a, b) between classes whose sets are near."""
    star = written(stars(classes, total), "stars")
    grouped = components(star.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    grouped = grouped.unionByName(grouped.select(F.col("root").alias("node"), "root").distinct())
    members = grouped.join(classes.select("node", "doc_id", "set_hash", "n_shingles"), "node")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_all"))
    members = written(attach(members, written(sizes, "groups"), "root", "_n", total), "members")
    sets = written(member_sets(docs, members.withColumn("blocks", _pieces(F.col("_all"), F.col("_n"))).drop("_n", "_all"), width), "sets", BATCH)

    one = sets.where("blocks = 1").select(F.struct("root", F.lit("one").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j")).alias("key"),
                                          F.lit(0).alias("side"), "node", F.col("node").alias("cluster"), "shingles")
    small = written(verified(one), "near", BATCH)
    large = sets.where("blocks > 1")
    if large.isEmpty():
        return small

    # each member against the first leader it met; leaders go to all blocks of their members
    led = large.join(star.groupBy("node").agg(F.min("leader").alias("leader")), "node")
    heads = written(led.groupBy("leader").agg(F.sum("n_shingles").alias("_led"), F.count(F.lit(1)).alias("_m")), "heads")
    key = lambda who, i: F.struct(F.col(who).alias("root"), F.lit("led").alias("kind"), i.alias("i"), F.lit(0).alias("j")).alias("key")
    follow = attach(led, heads, "leader", "_m", total).withColumn("_b", _pieces(F.col("_led"), F.col("_m")))
    first = large.join(heads, F.col("node") == F.col("leader")).withColumn("_i", F.explode(F.sequence(F.lit(0), _pieces(F.col("_led"), F.col("_m")) - 1)))
    plain = ["node", F.col("node").alias("cluster"), "shingles"]
    to_leader = follow.select(key("leader", _block("_b")), F.lit(1).alias("side"), *plain).unionByName(
        first.select(key("node", F.col("_i")), F.lit(0).alias("side"), *plain))
    near = written(verified(to_leader), "near", BATCH)

    # what is outside the largest cluster of its group, against all that is outside its own cluster
    clustered = components(near).withColumnRenamed("root", "cluster")
    large = large.join(clustered, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    bulk = large.groupBy("root", "cluster").agg(F.count(F.lit(1)).alias("_c"), F.sum("n_shingles").alias("_s"))
    bulk = bulk.groupBy("root").agg(F.max_by("cluster", F.struct("_c", "cluster")).alias("_bulk"), F.sum("_c").alias("_n"),
                                    F.max(F.struct("_c", "cluster", "_s")).alias("_in"), F.sum("_s").alias("_all"))
    bulk = bulk.select("root", "_n", "_bulk", _pieces(F.col("_in._s"), F.col("_in._c")).alias("_ins"),
                       _pieces(F.col("_all") - F.col("_in._s"), F.col("_n") - F.col("_in._c")).alias("_outs"))
    large = attach(large, written(bulk, "bulk"), "root", "_n", total)
    inside = F.col("cluster") == F.col("_bulk")
    at = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    numbers = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    mine_in, mine_out = _block("_ins"), F.when(F.col("_outs") > 0, F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("_outs"))).cast("int")
    places = F.when(inside, F.transform(numbers("_outs"), lambda o: at("cross", o, mine_in, F.lit(1)))).otherwise(F.concat(
        F.transform(numbers("_ins"), lambda i: at("cross", mine_out, i, F.lit(0))),
        F.transform(numbers("_outs"), lambda o: at("outside", F.least(o, mine_out), F.greatest(o, mine_out),
                                                   F.when(mine_out <= o, 0).otherwise(1)))))
    rest = large.withColumn("_p", F.explode(places)).select(
        F.struct("root", "_p.kind", "_p.i", "_p.j").alias("key"), F.col("_p.side").alias("side"), "node", "cluster", "shingles")
    return small.unionByName(near).unionByName(verified(rest))


def near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept, text_mark."""
    rows = written(sketched(docs, width), "sketches", BATCH)
    total = rows.count()
    classes = rows.where("set_hash IS NOT NULL").groupBy("set_hash").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("_copies"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    joined = components(links(docs, classes, total, width))
    part = classes.select("node", "set_hash", "doc_id", "_copies").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = written(part.groupBy("root").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("component_id")).where("_n > 1"), "components")
    part = attach(part, least, "root", "_n", total)
    part = part.select("set_hash", "_copies", F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = attach(rows.drop("bands"), written(part, "labels"), "set_hash", "_copies", total)
    component = F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "text_mark")


def deduplicated(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, all columns kept as they are.

    Dropped rows are named by id and text; their table is written first, so it
    is broadcast if it is small and shuffled if not.
    """
    gone = near_duplicates(docs, width).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_mark").alias("_mark"))
    gone = written(gone.distinct(), "dropped")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (text_mark() == F.col("_mark"))
    return docs.join(gone, same, "left_anti")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("text_mark")


#: All pairs that share a shingle, then what each document reaches over links (fit for the small table only).
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle
  FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.size + y.size - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT r.a AS doc_id, coalesce(any_value(n.size), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, min(r.b) = r.a AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
