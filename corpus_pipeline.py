"""Corpus pipeline: toxicity, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of their input, whatever these are.  ``run`` writes
each stage's result to the shared checkpoint folder and reads it back as the
next stage's documents, so a lost executor repeats a stage's tasks and never
the stages before.

Defined cases are those of the operators.  In addition: near-dedup compares
five-word shingles; the mixture reads each leaf at most once, so no document
comes back that dedup has dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakline.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from cloakline.llm.common import documents, written
from cloakline.session import read_table

#: Share of the tokens left that the mixture takes, each document once.
MIX = mixing.Mix(percent=80, epochs=1)


#: Whole rows go through Python in some stages; so many at a time, to bound a worker's memory.
ARROW_ROWS = 1000


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return toxicity.clean(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return near_dedup.deduplicated(docs, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.chosen(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The toxicity model, the tokenizer and best-fit packing have no SQL form; tests/llm checks the rows instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
