"""Two-pass counting Bloom filter over 64-bit hashes, built by Spark.

Pass one sets each hash's positions in a filter that counts 0, 1, "2 or more"
per position; shards of the filter are merged in the shuffle.  Pass two asks
the filter: a hash that occurs twice has "2 or more" at all of its positions,
so no repeated hash is missed; a hash that occurs once is wrongly reported
with a chance set by ``BITS`` and ``PROBES``.

The merged filter (one bit per position) is broadcast.  Its size is bounded by
``MAX_BYTES``; a larger table only raises the share of wrong reports, never
the result, because everything reported is compared exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from cloakline.llm.common import mix, written

BITS = 16          # positions per expected hash
PROBES = 2         # positions per hash
SHARD = 1 << 18    # positions per shard (32 KiB as bits)
MAX_BYTES = 64 << 20


def positions(hashes: np.ndarray, size: int) -> np.ndarray:
    """PROBES positions in [0, size) per hash, as one flat array (probe after probe)."""
    with np.errstate(over="ignore"):
        return np.concatenate([mix(hashes + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)
                               for k in range(PROBES)])


def filter_size(n: int) -> int:
    """Number of positions for ``n`` hashes: whole shards, at most MAX_BYTES as bits."""
    return SHARD * min(max(1, -(-n * BITS // SHARD)), MAX_BYTES * 8 // SHARD)


def first_column(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def counted(rows: DataFrame, n: int, least: int, hashes: Callable[[pa.RecordBatch], np.ndarray] = first_column,
            store: bool = False) -> np.ndarray:
    """The merged filter of about ``n`` hashes in ``rows``: bits of positions counted at least ``least`` (1 or 2) times.

    With ``store`` the shards are written before the driver takes them, so they are merged side by side; without, one partition after the other.
    """
    size = filter_size(n)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, count = np.unique(positions(hashes(batch), size), return_counts=True)
            if not len(at):
                continue
            code = ((at % np.uint64(SHARD)).astype(np.uint32) << np.uint32(1)) | (count > 1).astype(np.uint32)
            shard = (at // np.uint64(SHARD)).astype(np.int32)
            cut = np.flatnonzero(np.diff(shard)) + 1
            yield pa.record_batch([pa.array(shard[np.concatenate([[0], cut])]),
                                   pa.array([c.tobytes() for c in np.split(code, cut)], pa.binary())],
                                  names=["shard", "codes"])

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seen, twice = np.zeros(SHARD, bool), np.zeros(SHARD, bool)
        for codes in rows["codes"]:
            code = np.frombuffer(codes, np.uint32)
            at = code >> np.uint32(1)
            twice[at[(code & np.uint32(1)).astype(bool) | seen[at]]] = True
            seen[at] = True
        return pd.DataFrame({"shard": [key[0]], "bits": [np.packbits(twice if least > 1 else seen).tobytes()]})

    shards = (rows.mapInArrow(local, "shard int, codes binary")
              .groupBy("shard").applyInPandas(merged, "shard int, bits binary"))
    bits = np.zeros(size // 8, np.uint8)  # at most MAX_BYTES
    for row in (written(shards, "filter") if store else shards).toLocalIterator():
        bits[row.shard * SHARD // 8:(row.shard + 1) * SHARD // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def reported(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """True where all positions of the hash are set: it may occur as often as was asked for."""
    at = positions(hashes, len(bits) * 8)
    hit = (bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & np.uint8(1)
    return hit.reshape(PROBES, -1).all(axis=0)
