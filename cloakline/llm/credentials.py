"""Secret scans by grammar inference.

Base spans come from fixed patterns.  Their values, labelled by the kind that
found them, train one probabilistic automaton per kind: a prefix tree of the
values is folded by merging states whose continuation frequencies are
statistically compatible (Hoeffding bound), and the counts become
probabilities.  Another automaton is inferred from ordinary runs in the same way.
Every run of value characters in the corpus that is as long as the shortest value
may be, words, numbers and dotted runs included, is then scored under all of them.
Added as spans of kind ``format`` are the runs outside the base spans whose mean log
likelihood under some kind is that of its held-out credentials and whose likelihood
ratio against ordinary runs outweighs the prior odds (``PRIOR``).

Training reads bounded samples: the ``TRAIN`` values of each kind and the ``WORDS``
ordinary runs with the smallest hash among the distinct ones of the whole corpus
(of at most ``LONGEST`` characters).  Everything else reads every text whole, and
all work is per document, so no key can be hot.

Defined cases: a null or empty text has no spans; repeated rows are scanned one
by one; without any credential in the corpus there is no automaton of a kind and
only base spans are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.llm.common import documents, slices, written

#: The base patterns and the least length of what each must match.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "format"]
LEAST = {"assign": 6, "access": 20, "hex": 24}
SHORTEST = min(LEAST.values())

TRAIN = 600          # labelled values of each kind to train on
WORDS = 20_000       # ordinary runs to train on
LONGEST = 256        # characters of a training value, at most
HELD_OUT = 5         # every so many of the values set the threshold instead
ALPHA = 0.05         # confidence of the state merging test
TAIL = 0.02          # share of held-out credentials that may score below the threshold
PRIOR = 1e-4         # assumed share of credentials among the runs without a name before them
SEEN, UNSEEN = 0.05, 0.5  # smoothing of a kind's moves, and of ordinary ones, which have far more formats
QUANTILE_STEPS = 10_000
SIGN = 1 << 63       # Spark's xxhash64 (seed 42) is signed
#: What may be a credential without a name before it: runs of value characters, no dot at either end.
RUN = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")

_assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_access = re.compile(ACCESS)
_hex = re.compile("[0-9a-f]{%d,}" % LEAST["hex"])  # maximal runs, so the same as dropping short ones


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the value), sorted."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end(), m.start()) for m in _access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end(), m.start()) for m in _hex.finditer(text)]
    return sorted(out)


def may_match(texts: pa.Array) -> list[bool]:
    """False where no base pattern can match (a linear-time screen of the same patterns)."""
    hit = pc.match_substring_regex(texts, "(?i:%s)" % ASSIGN)
    for pattern in (ACCESS, _hex.pattern):
        hit = pc.or_(hit, pc.match_substring_regex(texts, pattern))
    return hit.to_pylist()


# ------------------------------------------------------------------ automata
_CLASSES = [("d", "0123456789"), ("a", "abcdef"), ("z", "ghijklmnopqrstuvwxyz"), ("A", "ABCDEF"), ("Z", "GHIJKLMNOPQRSTUVWXYZ")]
CHARS = dict(_CLASSES)
SYMBOL = {c: (name, math.log(len(chars))) for name, chars in _CLASSES for c in chars}


def symbols(value: str) -> list[str]:
    return [SYMBOL.get(c, (c, 0.0))[0] for c in value]


class Automaton:
    """Probabilistic automaton folded from the prefix tree of the training values.

    A state is [arrivals, ends, {symbol: (next state, count)}].
    """

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.states: list[list] = [[0, 0, {}]]
        for value in values:
            at = 0
            for s in symbols(value):
                self.states[at][0] += 1
                nxt, n = self.states[at][2].get(s, (len(self.states), 0))
                if not n:
                    self.states.append([0, 0, {}])
                self.states[at][2][s] = (nxt, n + 1)
                at = nxt
            self.states[at][0] += 1
            self.states[at][1] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, kept: int, other: int) -> bool:
        todo = [(kept, other)]
        while todo:
            p, q = todo.pop()
            (n1, e1, to1), (n2, e2, to2) = self.states[p], self.states[q]
            if self._differ(e1, n1, e2, n2):
                return False
            for s in to1.keys() | to2.keys():
                a, b = to1.get(s), to2.get(s)
                if self._differ(a[1] if a else 0, n1, b[1] if b else 0, n2):
                    return False
                if a and b:
                    todo.append((a[0], b[0]))
        return True

    def _fold(self, kept: int, tree: int) -> None:
        """Add the counts of the subtree ``tree`` to ``kept`` and what follows it."""
        todo = [(kept, tree)]
        while todo:
            p, q = todo.pop()
            mine, its = self.states[p], self.states[q]
            mine[0] += its[0]
            mine[1] += its[1]
            for s, (nxt, n) in its[2].items():
                if s in mine[2]:
                    to, m = mine[2][s]
                    mine[2][s] = (to, m + n)
                    todo.append((to, nxt))
                else:
                    mine[2][s] = (nxt, n)

    def _infer(self) -> None:
        red = [0]
        while True:
            known = set(red)
            edge = next(((p, s) for p in red for s in sorted(self.states[p][2]) if self.states[p][2][s][0] not in known), None)
            if edge is None:
                return
            source, symbol = edge
            blue, n = self.states[source][2][symbol]
            for kept in red:
                if self._compatible(kept, blue):
                    self.states[source][2][symbol] = (kept, n)
                    self._fold(kept, blue)
                    break
            else:
                red.append(blue)


def moves(states: list, smoothing: float = SEEN) -> list:
    """The states that can be reached, as (log of ending, log of an unseen move, {character: (next state, log)}), start first.

    Unseen moves lead to the start and are rarer than any seen one.
    """
    number, todo, out = {0: 0}, [0], []
    for at in todo:  # grows while it is walked
        n, ends, to = states[at]
        log = lambda m: math.log((m + smoothing) / (n + 20 * smoothing))  # noqa: B023, E731
        own = {}
        for name, (nxt, m) in to.items():
            if nxt not in number:
                number[nxt] = len(todo)
                todo.append(nxt)
            chars = CHARS.get(name, name)
            own.update({c: (number[nxt], log(m) - math.log(len(chars))) for c in chars})
        out.append((log(ends), log(0), own))
    return out


def likelihood(moves: list, value: str) -> float:
    """Log likelihood of a whole value, its end included."""
    at, total = moves[0], 0.0
    for c in value:
        move = at[2].get(c)
        if move is None:
            total += at[1] - SYMBOL.get(c, (c, 0.0))[1]
            at = moves[0]
        else:
            total += move[1]
            at = moves[move[0]]
    return total + at[0]


def score(moves: list, value: str) -> float:
    """Mean log likelihood per move (each character, and the end)."""
    return likelihood(moves, value) / (len(value) + 1)


def train(values: dict[str, list[str]], words: list[str]) -> dict:
    """Automata and thresholds of the kinds, and the automaton of ordinary runs, from bounded samples."""
    automata = {}
    for kind, own in values.items():
        held = own[::HELD_OUT]
        rest = [v for k, v in enumerate(own) if k % HELD_OUT] or own
        if not rest:
            continue
        own_moves = moves(Automaton(rest).states)
        scores = sorted(score(own_moves, v) for v in held)
        automata[kind] = (own_moves, scores[int(TAIL * len(scores))])
    return {"automata": automata, "ordinary": moves(Automaton(words).states, UNSEEN), "odds": math.log((1 - PRIOR) / PRIOR)}


def is_credential(run: str, model: dict) -> bool:
    """Whether some automaton finds the run as likely as its held-out credentials, and a credential likelier than a word."""
    if not model["automata"]:
        return False
    least = likelihood(model["ordinary"], run) + model["odds"]
    return any((s := likelihood(own, run)) > least and s >= bound * (len(run) + 1)
               for own, bound in model["automata"].values())


# ------------------------------------------------------------------ jobs
def labelled(docs: DataFrame, size: int = TRAIN) -> tuple[dict[str, list[str]], list[str]]:
    """The bounded training samples: per kind ``size`` distinct values, and ``WORDS`` distinct runs of the texts without any."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda rows: pa.record_batch([pa.array(c, pa.string()) for c in (list(zip(*rows, strict=True)) or [(), ()])],
                                            names=["kind", "value"])
        words: dict[str, int] = {}  # the runs of smallest hash of this task: those of the corpus are among them
        bound = 1 << 64
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "")
            found = set()
            for text, may in zip(texts.to_pylist(), may_match(texts), strict=True):
                spans = base_spans(text) if may else []
                found |= {(KINDS[k], text[at:to]) for _, k, to, at in spans if to - at <= LONGEST}
                if not spans:
                    for run in {r for r in RUN.findall(text) if SHORTEST <= len(r) <= LONGEST}:
                        if (h := xxhash.xxh64_intdigest(run, 42) ^ SIGN) <= bound:
                            words[run] = h
                    if len(words) > 2 * WORDS:
                        words = dict(heapq.nsmallest(WORDS, words.items(), key=lambda w: (w[1], w[0])))
                        bound = max(words.values())
            yield told(sorted(found))
        words = dict(heapq.nsmallest(WORDS, words.items(), key=lambda w: (w[1], w[0])))
        yield told([("word", run) for run in sorted(words)])

    every = written(docs.select("text").mapInArrow(values, "kind string, value string").distinct(), "secrets")

    def first(kind: str, n: int) -> list[str]:
        """The ``n`` values of smallest hash; a quantile of the hashes keeps back nearly all others, so few rows travel."""
        own, digits = every.where(F.col("kind") == kind), F.shiftright(F.xxhash64("value"), 32)
        share = min(1.0, n / max(own.count(), 1) + 2 / QUANTILE_STEPS)  # two steps more than asked for: the quantile is off by one at most
        least = own.agg(F.percentile_approx(digits, share, QUANTILE_STEPS)).first()[0]
        rows = own.where(digits <= F.lit(least).cast("long")).orderBy(F.xxhash64("value"), "value").limit(n)
        return [r.value for r in rows.collect()]

    return {k: first(k, size) for k in KINDS[:3]}, first("word", WORDS)


def scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    model = model or train(*labelled(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TRAIN

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        judged = lru_cache(1 << 16)(lambda run: is_credential(run, model))  # short runs come again and again
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "")
            out = []
            for text, may in zip(texts.to_pylist(), may_match(texts), strict=True):
                base = [(a, k, b) for a, k, b, _ in (base_spans(text) if may else [])]
                starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
                more = []
                for m in RUN.finditer(text):
                    a, b = m.span()
                    if b - a >= SHORTEST and (judged(m[0]) if b - a <= LONGEST else is_credential(m[0], model)):
                        before = bisect_left(starts, b)  # base spans that start before the run ends
                        if not before or reach[before - 1] <= a:
                            more.append((a, 3, b))
                told = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
                out.append((*(sum(s[1] == k for s in base) for k in range(3)),
                            hashlib.sha256(told(base).encode()).hexdigest(), told(base + more)))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                  names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
