"""Helpers shared by the operators of this folder: tables, written cuts, hot keys, words.

Row conventions used by every operator here (each operator states its own
additions): a null text counts as the empty text; a null ``doc_id`` is an
ordinary id that sorts first; columns an operator does not name are ignored,
so extra columns and clashing names do no harm; an empty table gives an empty
result with the same columns.
"""

from __future__ import annotations

import contextlib
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.session import checkpoint_dir, read_table

#: Rows of text handed to numpy at once inside a task, in bytes.
SLICE_BYTES = 1 << 20
#: A key with at least 1/HOT_SHARE of all rows is hot, so at most HOT_SHARE keys are.
HOT_SHARE = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, batch: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A lost executor loses nothing of it, and the planner knows its size, so a
    small one is broadcast in a later join and a large one is shuffled.  With
    ``batch``, at most so many rows at a time reach Python while it is written.
    """
    spark, path, rows = df.sparkSession, shared_path(df.sparkSession, what), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, str(min(int(before), batch or int(before)) if int(before) > 0 else batch or before))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(rows, before)
    return spark.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join ``rows`` to the one-row-per-key table ``groups``, with no hot task.

    Keys holding over ``total / HOT_SHARE`` rows (at most HOT_SHARE of them, a
    proven bound) are broadcast; their rows go to the shuffle under keys of their own.
    ``size`` is the column of ``groups`` with the number of rows of the key.
    """
    least = max(total // HOT_SHARE, 1)
    value = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > least).select(F.col(key).alias("_hk"), F.struct(*value).alias("_hot"))
    cold = groups.where(F.col(size) <= least).select(F.col(key).alias("_ck"), F.struct(*value).alias("_cold"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    own = F.when(F.col("_hk").isNull(), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id())
    out = out.withColumn("_j", F.struct(F.when(F.col("_hk").isNull(), F.col(key)).alias("key"), own.alias("own")))
    out = out.join(cold.withColumn("_c", F.struct(F.col("_ck").alias("key"), F.lit(-1).cast("long").alias("own"))),
                   F.col("_j") == F.col("_c"), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in value])


# ------------------------------------------------------------------ text inside tasks
def worker_store() -> dict:
    """A dict that outlives the task in its Python worker.

    Functions travel by value, so the globals of their module do not last from task to task.
    """
    name = "_cloakline_worker"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy pieces of the batches with about ``most`` bytes of ``text`` each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    del batches
    trimmed()


def trimmed() -> None:
    """Give a worker's free memory back to the machine: workers wait for their next task beside the JVM."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (public murmur3 constants): a bijection with well spread bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_lists(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of each text (A-Z lower-cased, split at ``[\\x20\\x09-\\x0D]``): row offsets and the flat words."""
    lowered = pc.ascii_lower(pc.fill_null(text, ""))
    lists = pc.ascii_split_whitespace(lowered)  # runs of exactly these six characters
    flat = pc.list_flatten(lists)
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.not_equal(flat, "")
    keep = full.to_numpy(zero_copy_only=False)
    counts = np.bincount(rows[keep], minlength=len(text))
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), flat.filter(full)


def word_hashes(flat: pa.Array) -> np.ndarray:
    """64-bit hash of each word; equal words hash once per call."""
    import xxhash

    if not len(flat):
        return np.zeros(0, np.uint64)
    coded = flat.dictionary_encode()
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()),
                        np.uint64, len(coded.dictionary))
    return names[coded.indices.to_numpy(zero_copy_only=False)]


def shingle_sets(text: pa.Array, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its ``width``-word shingles.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    offsets, flat = word_lists(text)
    hashes = word_hashes(flat)
    out = []
    with np.errstate(over="ignore"):
        rolled = np.full(max(len(hashes) - width + 1, 0), width, np.uint64)
        for k in range(width):
            rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k:len(rolled) + k])
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(rolled[a:b - width + 1]))
            else:  # the whole sequence, if any
                few = np.full(min(b - a, 1), b - a, np.uint64)
                for h in hashes[a:b]:
                    few = mix(few * np.uint64(0x9E3779B97F4A7C15) + h)
                out.append(few)
    return out
