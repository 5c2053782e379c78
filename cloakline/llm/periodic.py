"""Periodic runs of words: recursive frequency splitting, then a lag scan of what survives.

A run is a stretch of consecutive words with smallest period q and at least
``max(LEAST, TIMES * q)`` words that no neighbouring word extends.  Every word
of a run occurs at least TIMES times in it.  So a word that occurs fewer times
within its segment belongs to no run: it splits the segment.  The parts are
counted again, by themselves, until no part changes; parts under LEAST words go.

The lag scan looks at dyadic bands of lags.  For a run of period q in
(g/2, g], with g a power of two, take the strings of g words.  Such a string
fits within the run at its place and again q words on (TIMES * q >= q + g), and
not at a smaller distance, since a string of at least q words that recurs
sooner would give the run a smaller period.  So the run is a maximal stretch of
places whose string recurs next exactly q words on, and each such stretch of
enough words is a run: one scan per band finds all of its lags.  Strings are
named by doubling, from pairs of names, so names are equal exactly where words
are.  Documents are split in tasks, some of them together in one slice; one
document costs memory in proportion to its text.

Defined cases: a null or blank text has no words and no runs, its collapsed
text is empty; a null ``doc_id`` has no decimal form, so ``edited`` leaves its
words alone; rows that repeat an id are handled one by one; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.llm.common import documents, slices

TIMES, LEAST = 3, 24
RUNS = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def words_of(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: row offsets and the flat words."""
    lists = pc.ascii_split_whitespace(pc.cast(pc.fill_null(text, ""), pa.large_string()))
    flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.not_equal(flat, "")
    counts = np.bincount(rows[full.to_numpy(zero_copy_only=False)], minlength=len(text))
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), flat.filter(full)


def edited(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each of the n places: some documents repeat a part of their end."""
    at = np.arange(n, dtype=np.int64)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (TIMES + g % 8)
    at[a:] = a + (at[a:] - a) % p
    return at


def survivors(words: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places left by frequency splitting and the segment of each, in order."""
    place = np.arange(len(words))
    done_place, done_segment, fresh = [], [], 0
    while len(place):
        # count words within segments; only segments that changed come back
        _, code, count = np.unique(segment * (int(words.max()) + 1) + words[place], return_inverse=True, return_counts=True)
        often = count[code] >= TIMES
        edge = np.flatnonzero(np.diff(segment)) + 1
        first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(place)]])
        calm = np.repeat(np.logical_and.reduceat(often, first) & (last - first >= LEAST), last - first)
        done_place.append(place[calm])
        done_segment.append(np.cumsum(np.concatenate([[1], np.diff(segment[calm]) != 0]))[:calm.sum()] + fresh)
        fresh = int(done_segment[-1][-1]) if calm.any() else fresh
        left = often & ~calm
        place, segment = place[left], segment[left]
        if not len(place):
            break
        segment = np.cumsum(np.concatenate([[0], (np.diff(place) != 1) | (np.diff(segment) != 0)]))
        long_enough = np.bincount(segment)[segment] >= LEAST
        place = place[long_enough]
        segment = np.unique(segment[long_enough], return_inverse=True)[1]
    place, segment = np.concatenate([np.zeros(0, int), *done_place]), np.concatenate([np.zeros(0, int), *done_segment])
    order = np.argsort(place, kind="stable")
    return place[order], segment[order]


def scanned(words: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs inside the segments, places counted in the given arrays."""
    if not len(words):
        return np.zeros((0, 3), np.int64)
    # a word of its own after each segment: no string reaches over it and recurs
    cut = np.flatnonzero(np.diff(segment)) + 1
    stop = np.concatenate([cut, [len(words)]])
    here = np.arange(len(words)) + np.searchsorted(cut, np.arange(len(words)), "right")
    name = np.full(len(words) + len(stop), -1, np.int64)
    name[here] = words
    name[name < 0] = words.max() + 1 + np.arange(len(stop))
    back = np.zeros(len(name), np.int64)
    back[here] = np.arange(len(words))
    most = int(np.diff(np.concatenate([[0], stop])).max())
    found, g = [], 1
    while TIMES * (g // 2 + 1) <= most:
        order = np.argsort(name, kind="stable")
        gap = np.zeros(len(name), np.int64)
        gap[order[:-1]] = np.where(name[order[1:]] == name[order[:-1]], order[1:] - order[:-1], 0)
        gap[(gap <= g // 2) | (gap > g)] = 0
        edge = np.flatnonzero(np.diff(gap)) + 1
        first = np.concatenate([[0], edge])
        size = np.concatenate([edge, [len(gap)]]) - first
        q = gap[first]
        length = size - 1 + q + g
        keep = (q > 0) & (length >= np.maximum(LEAST, TIMES * q))
        found.append(np.stack([back[first[keep]], length[keep], q[keep]], axis=1))
        if len(name) <= g:
            break
        # names of twice as many words, from pairs of names
        name = np.unique(name[:-g] * (int(name.max()) + 1) + name[g:], return_inverse=True)[1].astype(np.int64)
        g *= 2
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def runs_of(offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of many documents laid end to end: the document of each, and (start, length, period) in it, by start, then period."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place, segment = survivors(words, doc)
    runs = scanned(words[place], segment)
    start = place[runs[:, 0]] if len(runs) else runs[:, 0]
    own = doc[start]
    runs = np.stack([start - offsets[own], runs[:, 1], runs[:, 2]], axis=1)
    order = np.lexsort((runs[:, 2], runs[:, 0], own))
    return own[order], runs[order]


def periodic_runs(docs: DataFrame, edit: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) the columns RUNS; ``edit`` looks at the words as ``edited`` changes them.

    ``runs`` lists all runs; start, length, period and exponent_milli are of the
    one with the greatest length / period (ties: smallest start, then period).
    ``collapsed`` drops every word that some run holds after its first period.
    """
    kinds = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli")],
                       ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
                       ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            offsets, flat = words_of(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            if edit:
                at = [edited(i, n) + a for i, a, n in zip(ids, offsets[:-1].tolist(), np.diff(offsets).tolist(), strict=True)]
                flat = flat.take(pa.array(np.concatenate([np.zeros(0, np.int64), *at])))
            words = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            own, runs = runs_of(offsets, words)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, offsets[own] + runs[:, 0] + runs[:, 2], 1)
            np.add.at(edge, offsets[own] + runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(edge)[:-1] == 0
            ends = np.concatenate([[0], np.cumsum(kept)])[offsets]
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), flat.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))
            bounds, rows = np.searchsorted(own, np.arange(len(ids) + 1)).tolist(), runs.tolist()
            out = []
            for k, (i, text) in enumerate(zip(ids, joined.to_pylist(), strict=True)):
                mine = rows[bounds[k]:bounds[k + 1]]
                best = max(mine, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if mine else [None] * 3
                told = "".join(f"{s},{n},{q}\n" for s, n, q in mine)
                out.append((i, int(offsets[k + 1] - offsets[k]), len(mine), *best, 1000 * best[1] // best[2] if mine else None,
                            hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(),
                            [dict(zip(("start", "length", "period"), r, strict=True)) for r in mine], text))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RUNS)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(documents(spark, sf_dir), edit=True).drop("n_words", "runs", "collapsed")
