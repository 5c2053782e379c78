"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Spark tokenises every document and cuts only those longer than the window;
each task numbers its pieces per length.  Best-fit decreasing depends on the
piece lengths alone, so the plan is made from the exact histogram of lengths
(at most ``window`` rows): a segment tree over remaining capacities finds the
tightest open bin in logarithmic time, and equal documents are placed as one
run.  The plan is exactly what placing the documents one by one would give.
Spark then looks up each piece's sequence and offset from its length and its
rank among pieces of that length; no group of pieces meets in one task.

Defined cases: a null or empty text is one piece holding only the separator; a
null ``doc_id`` and repeated rows are packed like any other row; ``<|endoftext|>``
inside a text is the tokenizer's added token; pieces of
equal length are interchangeable, so which of them shares a sequence with
which is not defined; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakline.llm.common import documents, slices, worker_store, written

WINDOW = 2048           # tokens in a sequence
SEPARATOR = 0           # id after each document
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _task long, _nth long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------ tokens
# Fixed value: how byte-level tokenizers cut a text before merging bytes.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Function from a text to its ids (unsigned 32-bit) by the tokenizer file, without added special tokens.

    A plain byte-level BPE file whose ids are in the order of its merges means
    the same to tiktoken, which is several times as fast; any other file goes to
    ``tokenizers``.  A worker keeps the encoder from task to task.
    """
    import json

    kept = worker_store().setdefault("tokenizers", {})
    if path not in kept:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocabulary, model = told["model"].get("vocab", {}), told["model"]
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
        order = [vocabulary.get(m, -1) for m in merges]
        cut = told.get("pre_tokenizer") or {}
        plain = (model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
                 and told.get("normalizer") is None and order == sorted(set(order)) and len(vocabulary) - len(added.keys() & vocabulary) == len(merges) + 256
                 and not any(model.get(c) for c in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
                 and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in told["added_tokens"]))
        if plain:
            import tiktoken

            names = byte_names()
            ranks = {bytes(names[c] for c in token): k for token, k in vocabulary.items() if token not in added}
            coder = tiktoken.Encoding(path, pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=added)
            kept[path] = lambda text: coder.encode_to_numpy(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            kept[path] = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    return kept[path]


def pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of at most ``window`` tokens; ``_nth`` counts a task's pieces of the same length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        end = np.array([SEPARATOR], "<u4")
        for batch in slices(batches):
            out = []
            for doc, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                ids = np.concatenate([encode(text or ""), end]).astype("<u4", copy=False)
                first = (len(ids) - 1) % window + 1  # only the first piece may be shorter
                at = 0
                for k in range(-(-len(ids) // window)):
                    to = first + k * window
                    out.append((doc, k, at, to - at, zlib.crc32(ids[at:to]), task, int(seen[to - at])))
                    seen[to - at] += 1
                    at = to
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


# ------------------------------------------------------------------ plan
class CapacityTree:
    """Segment tree over remaining capacities 0..window; a leaf holds runs (sequence, bins) of open bins."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.open = [False] * (2 * self.base)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _mark(self, capacity: int) -> None:
        at = self.base + capacity
        self.open[at] = bool(self.runs[capacity])
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def put(self, capacity: int, sequence: int, bins: int) -> None:
        if bins:
            self.runs[capacity].append((sequence, bins))
            self._mark(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        self._mark(capacity)
        return run

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` with an open bin."""
        at = self.base + length
        if self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.base
            at //= 2
        return None


def best_fit(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[length]`` pieces.

    Returns runs (length, first rank, pieces in each sequence, first sequence,
    offset): ranks of the run fill its sequences one after the other.
    """
    tree, plan, sequences = CapacityTree(window), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, sequence = window, sequences
                bins = -(-left // (window // length))
                sequences += bins
            else:
                sequence, bins = tree.take(capacity)
            each = capacity // length
            full = min(bins, left // each)
            if full:
                plan.append((length, rank, each, sequence, window - capacity))
                tree.put(capacity - each * length, sequence, full)
                rank, left = rank + full * each, left - full * each
            if full < bins and left:
                plan.append((length, rank, left, sequence + full, window - capacity))
                tree.put(capacity - left * length, sequence + full, 1)
                rank, left, full = rank + left, 0, full + 1
            tree.put(capacity, sequence + full, bins - full)
    return plan


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    found = written(pieces(docs, path or tokenizer_path(), window), "pieces")  # tokenised once
    per_task = written(found.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # <= window rows
    plan = np.array(best_fit(counts, window), np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        keys = (plan[:, 0] << 48) | plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            _, first, each, sequence, offset = plan[np.searchsorted(keys, (length << 48) | rank, "right") - 1].T
            nth = rank - first
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*columns, pa.array(sequence + nth // each), pa.array(offset + nth % each * length)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = found.join(bases, ["length", "_task"]).withColumn("_rank", F.col("_base") + F.col("_nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
