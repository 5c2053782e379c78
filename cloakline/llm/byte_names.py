"""Names (hashes) of byte strings of any length, and runs of strings that share an anchor.

The name of ``data[i:i + n]`` comes from prefix sums in constant time for any
n and is only worked out where it is asked for.  The anchor of a 100-byte
string is its part of ``gram`` bytes with the smallest rank, the first of
equals, so equal strings have equal anchors at equal places, and neighbouring
strings mostly share one: they form a run.  Ranks are short hashes by prefix
doubling; they only choose the anchor, two parts of equal rank do no harm.
"""

from __future__ import annotations

import numpy as np

from cloakline.llm.common import mix, worker_store

THRESHOLD = 100             # bytes in a repeated string
SEGMENT = 1 << 16           # bytes that numpy looks at together, few enough for the CPU's cache; places in it fit PLACE bits
PLACE = 17
APART = 256                 # bytes between two stretches that are looked at rather than left out
BASE = 0x9E3779B97F4A7C15   # odd, so it has an inverse modulo 2**64
TABLES = np.random.default_rng(3).integers(0, 1 << 62, (2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; a worker keeps them."""
    kept = worker_store()
    if len(kept.get(base, ())) < n:
        out, done = np.ones(n, np.uint64), 1
        while done < n:
            more = min(done, n - done)
            out[done:done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        kept[base] = out
    return kept[base][:n]


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` neighbours, by doubling."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:len(x) - (n - width)], x[n - width:]) if n > width else x


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - start, count)


def ranks(data: np.ndarray, gram: int) -> np.ndarray:
    """A short hash of the ``gram`` (4 or more) bytes from each place, above PLACE bits that have the place."""
    x = np.ndarray((len(data) - 3,), "<u4", np.ascontiguousarray(data), strides=(1,)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE3D)
    x ^= x >> np.uint32(13)
    width = 4
    while width < gram:
        more = min(width, gram - width)  # the last halves may overlap
        y = x[:-more] * np.uint32(0x85EBCA77)
        y += x[more:]
        x, width = y, width + more
    x &= np.uint32(-1 << PLACE & 0xFFFFFFFF)
    x |= np.arange(len(x), dtype=np.uint32)
    return x


def _runs(data: np.ndarray, at: np.ndarray, count: np.ndarray, gram: int) -> tuple[np.ndarray, ...]:
    up, down = powers(BASE, len(data) + 1), powers(pow(BASE, -1, 1 << 64), len(data) + 1)
    sums = []
    for table in TABLES:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(np.take(table, data, mode="clip") * down[:-1], out=total[1:])
        sums.append(total)
    if gram < THRESHOLD:
        key = sliding_min(ranks(data, gram), THRESHOLD - gram + 1)
        edge = np.ones(len(key) + 1, bool)
        edge[1:-1] = key[1:] != key[:-1]
        edge[at] = edge[at + count] = True
        edge = np.flatnonzero(edge)
        lo, hi = edge[:-1], edge[1:] - 1
        segment = np.searchsorted(at, lo, "right") - 1
        asked = (segment >= 0) & (lo < (at + count)[segment])
        lo, hi, segment = lo[asked], hi[asked], segment[asked]
        own = (key[lo] & np.uint32((1 << PLACE) - 1)).astype(np.int64)
    else:
        lo, segment = ranges(at, count), np.repeat(np.arange(len(at)), count)
        hi = own = lo
    name = mix((sums[0][own + gram] - sums[0][own]) * up[own])
    region = mix((sums[1][hi + THRESHOLD] - sums[1][lo]) * up[lo]) ^ mix(((hi - lo) * 1024 + own - lo + 1).astype(np.uint64))
    return name, region, lo, hi - lo + 1, segment


def runs(data: np.ndarray, at: np.ndarray, count: np.ndarray, gram: int) -> tuple[np.ndarray, ...]:
    """Runs among the strings that start at ``at[k]``, ``at[k] + 1``, ... (``count[k]`` of them; in order, each string once).

    Returns their anchor's name, the name of all bytes that the run's strings
    cover, the first string's place in ``data`` and the number of strings.
    """
    # stretches of bounded size, whatever the text; a run that is cut is two runs
    most = SEGMENT // 2
    parts = -(-count // most)
    again = ranges(np.zeros(len(at), np.int64), parts) * most
    at, count = np.repeat(at, parts) + again, np.minimum(np.repeat(count, parts) - again, most)
    end = at + count + THRESHOLD - 1
    apart = at[1:] > end[:-1] + APART  # what lies between is left out
    place = np.concatenate([[0], np.cumsum(np.where(apart, end[:-1], at[1:]) - at[:-1])])
    last, found, k = place[:len(at)] + end - at, [], 0
    with np.errstate(over="ignore"):
        while k < len(at):
            to = max(k + 1, int(np.searchsorted(last, place[k] + SEGMENT, "right")))
            lo, hi = at[k:to][np.append(True, apart[k:to - 1])], end[k:to][np.append(apart[k:to - 1], True)]
            part = data[lo[0]:hi[0]] if len(lo) == 1 else data[ranges(lo, hi - lo)]
            own = place[k:to] - place[k]
            name, region, lo, n, segment = _runs(part, own, count[k:to], gram)
            found.append((name, region, lo - own[segment] + at[k:to][segment], n))
            k = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*found, strict=True)))
