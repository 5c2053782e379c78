"""Extension points (UDF-1, UDF-3) on Arrow-batched ``mapInPandas``.

UDF-1: any batch callable that turns documents into model replies
``(doc_id, kind, raw)``; no model ships with the engine.

UDF-3: a scanner for patterns that need Python ``re`` features Java
regexes lack (rows marked ``engine = 'py'``).  It runs per partition on
Arrow batches and returns the same hit structs as the JVM scan, with
code-point offsets.  Patterns are shipped inside the function closure
(bounded by the pattern-table cap).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from cloakline.sources.patterns import InlinePattern

PY_HIT_SCHEMA = ("doc_id long, hit_pos int, pattern_rank int, label string, span string, phi_type string, "
                 "start int, end int")


ERROR_CHARS = 500  # of a failure's message that are kept


def _halved(call: Callable, part) -> Iterator[tuple]:
    """(rows, what ``call`` makes of them, failure): a part that raises is halved until the rows that fail stand alone.

    A row that fails costs about 2 log2(rows) more calls; rows of the good parts are scored again only along that path.
    """
    todo = [part]
    while todo:
        part = todo.pop()
        try:
            made = call(part)
        except Exception as failure:  # noqa: BLE001 (whatever a scorer raises belongs to its row)
            if len(part) > 1:
                half = len(part) // 2
                todo += [part.iloc[half:], part.iloc[:half]]
            else:
                yield part, None, f"{type(failure).__name__}: {failure}"[:ERROR_CHARS]
        else:
            yield part, made, None


def _replies(raw: pd.Series) -> pd.Series:
    return raw.astype(object).map(lambda r: None if pd.isna(r) else str(r))


def _scored(scorer: Callable[[pd.DataFrame], pd.DataFrame], pdf: pd.DataFrame, kind: str) -> Iterator[pd.DataFrame]:
    for part, out, failure in _halved(lambda p: scorer(p[["doc_id", "text"]]), pdf):
        rows = part["doc_id"] if out is None else out["doc_id"]
        yield pd.DataFrame({"doc_id": rows.astype("int64"), "kind": kind,
                            "raw": None if out is None else _replies(out["raw"]), "error": failure})


def model_replies(docs: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], kind: str,
                  errors: bool = False) -> DataFrame:
    """UDF-1: ``scorer(pdf[doc_id, text]) -> pdf[doc_id, raw]``; output is an SRC-5 table.

    With ``errors`` (PRJ-5) a scorer that raises loses only the rows it raises on:
    they come with a null ``raw`` and the failure in a further column ``error``
    (null elsewhere).  A scorer must then be free to see a row more than once.
    Without, the first failure ends the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if errors:
                yield from _scored(scorer, pdf, kind)
                continue
            out = scorer(pdf[["doc_id", "text"]])
            yield pd.DataFrame({"doc_id": out["doc_id"].astype("int64"), "kind": kind, "raw": out["raw"].astype(str)})

    schema = "doc_id long, kind string, raw string" + (", error string" if errors else "")
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def python_scan(docs: DataFrame, patterns: list[InlinePattern], ascii_classes: bool = True) -> DataFrame:
    """UDF-3: long hits table from Python ``re`` (rank order, then match order).

    ``ascii_classes`` keeps ``\\d \\w \\s \\b`` ASCII, the dialect of the JVM
    scan and of RE2.
    """
    flags = re.ASCII if ascii_classes else 0
    compiled = [(p, re.compile(p.regex, flags)) for p in patterns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                if text is None:
                    continue
                k = 0
                for p, rx in compiled:
                    for m in rx.finditer(text):
                        rows.append((doc_id, k, p.rank, p.label, m.group(), p.phi_type, m.start(), m.end()))
                        k += 1
            yield pd.DataFrame(rows, columns=["doc_id", "hit_pos", "pattern_rank", "label", "span", "phi_type",
                                              "start", "end"])

    return docs.select("doc_id", "text").mapInPandas(run, PY_HIT_SCHEMA)


def reply_column(scorer: Callable[[pd.Series], pd.Series], errors: bool = False):
    """UDF-1 as a column: an Arrow-batched ``pandas_udf`` turning the text
    column into raw replies on the same row.  Replies born next to their
    document need no join, hence no shuffle of the text.  With ``errors`` it is a
    struct of ``raw`` and ``error``, as in ``model_replies``."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def _reply(text: pd.Series) -> pd.Series:
        return scorer(text).astype(str)

    @pandas_udf("raw string, error string")
    def _reply_or_error(text: pd.Series) -> pd.DataFrame:
        parts = [pd.DataFrame({"raw": None if out is None else _replies(out).to_numpy(), "error": failure}, index=part.index)
                 for part, out, failure in _halved(scorer, text)]
        return pd.concat(parts).sort_index() if parts else pd.DataFrame({"raw": [], "error": []}, dtype=object)

    return _reply_or_error if errors else _reply
