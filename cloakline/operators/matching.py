"""JN-6 for documents of any number of spans: the greedy one-to-one match through an index of tokens.

Each true span, in order, takes the first free prediction that shares a token
with it, holds its text or is held by it.  Per row, an index from token to
predictions gives the first free one that shares a token, an index of their
texts the first one inside the true text, and only a text that occurs in some
prediction makes the free ones before that be looked at.  Rows travel in Arrow
batches; rows with few spans never leave the JVM.
"""

from __future__ import annotations

import bisect
import itertools
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

FEW = 256  # at most so many (truth, prediction) pairs of a row are tried one by one

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need pyarrow, not this package


def greedy(truth: list[tuple[str, list]], predicted: list[tuple[str, list]]) -> list[int]:
    """Places of the predictions taken, in the order of the true spans that take them; spans are (text, tokens)."""
    texts = [text for text, _ in predicted]
    index: dict[str, list[int]] = {}    # predictions by token
    whole: dict[str, list[int]] = {}    # and by text
    for j in range(len(predicted) - 1, -1, -1):  # the first prediction is the last of its list
        for token in predicted[j][1] or ():
            index.setdefault(token, []).append(j)
        if texts[j] is not None:
            whole.setdefault(texts[j], []).append(j)
    lengths, all_texts = sorted({len(t) for t in whole}), "\0".join(whole)
    after = list(range(1, len(predicted) + 1))  # the next free place, by path compression
    first, used, taken = 0, [False] * len(predicted), []

    def free(j: int) -> int:
        path = []
        while j < len(used) and used[j]:
            path.append(j)
            j = after[j]
        for k in path:
            after[k] = j
        return j

    def earliest(held: list[int] | None, best: int) -> int:
        while held and used[held[-1]]:
            held.pop()
        return min(best, held[-1]) if held else best

    for text, tokens in truth:
        best = len(predicted)
        for token in tokens or ():
            best = earliest(index.get(token), best)
        if text is not None:
            first = free(first)
            parts = (len(text) + 1) * len(lengths) < best - first  # fewer than the predictions to look at
            if parts:  # predictions inside the text
                for n in lengths[:bisect.bisect_right(lengths, len(text))]:
                    for at in range(len(text) - n + 1):
                        best = earliest(whole.get(text[at:at + n]), best)
            if not parts or text in all_texts:  # predictions around it
                j = first
                while j < best:
                    other = texts[j]
                    if other is not None and (text in other or other in text):
                        best = j
                        break
                    j = free(j + 1)
        if best < len(predicted):
            used[best] = True
            taken.append(best)
    return taken


def _spans(column: pa.Array) -> list[list[tuple[str, list]] | None]:
    """Lists of (text, tokens) of a column of array<struct<t: string, k: array<string>>>."""
    flat = pa.compute.list_flatten(column)
    pairs = list(zip(flat.field("t").to_pylist(), flat.field("k").to_pylist(), strict=True))
    ends = pa.compute.list_value_length(column).to_pylist()
    out, at = [], 0
    for n in ends:
        out.append(None if n is None else pairs[at:at + n])
        at += n or 0
    return out


def matched(truth: Column | str, predicted: Column | str) -> Column:
    """Number of pairs of the match, of two columns made by ``metrics.with_tokens``; a null text matches nothing.

    Every row goes through the index; ``matched_each`` keeps rows with few spans in the JVM.
    """

    def count(truth: pa.Array, predicted: pa.Array) -> pa.Array:
        import pyarrow.compute  # noqa: F401

        return pa.array([len(greedy(g, p)) if g and p else 0 for g, p in zip(_spans(truth), _spans(predicted), strict=True)], pa.int32())

    return F.arrow_udf(count, "int")(truth, predicted)


def _fold(truth: str, predicted: str) -> str:
    """The same match as a fold in the row: per true span the place (from 1) of what it takes, 0 where it takes nothing."""
    ok = (f"transform({predicted}, (x, j) -> NOT array_contains(used, CAST(j + 1 AS BIGINT)) AND (contains(gt.t, x.t) "
          f"OR contains(x.t, gt.t) OR coalesce(arrays_overlap(x.k, gt.k), false)))")
    fold = (f"aggregate({truth}, CAST(array() AS array<bigint>), (used, gt) -> array_append(used, array_position({ok}, true)))")
    return f"CASE WHEN size({truth}) = 0 OR size({predicted}) = 0 THEN 0 ELSE size(array_remove({fold}, 0)) END"


def matched_few(pairs: str) -> Column:
    """Number of pairs of each match, of a column array<struct<g, p>> of lists made by ``metrics.with_tokens``, or null.

    The first pair holds all spans of the row, the others parts of it; a null text matches nothing.  Rows with
    few spans, nearly all as a rule, are folded in the JVM; the others are null here and go through the index.
    """
    few = F.expr(f"CAST(size({pairs}[0].g) AS BIGINT) * size({pairs}[0].p) <= {FEW}")
    return F.when(few, F.expr(f"transform({pairs}, x -> {_fold('x.g', 'x.p')})"))


def matched_many(pairs: str) -> Column:
    """The same through the index, for rows of any number of spans; none for a null list of pairs."""

    def count(pairs: pa.Array) -> pa.Array:
        import pyarrow.compute  # noqa: F401

        flat = pa.compute.list_flatten(pairs)
        done = pa.array([len(greedy(g, p)) if g and p else 0 for g, p in zip(_spans(flat.field("g")), _spans(flat.field("p")), strict=True)], pa.int32())
        n = pa.compute.fill_null(pa.compute.list_value_length(pairs), 0).to_pylist()
        return pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(n)], pa.int32()), done)

    return F.arrow_udf(count, "array<int>")(F.col(pairs))
