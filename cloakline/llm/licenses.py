"""License scans by diagonal voting.

Rolling word 2-gram hashes of every document are joined to the 2-gram
positions of the templates.  A hit at word ``pos`` of the document and ``t`` of
the template votes for the diagonal ``pos - t``.  A diagonal that gets a vote
from every 2-gram of a base phrase is a place of that phrase.  For the longer
notices, neighbouring diagonals (a few words inserted or dropped) are merged
and the merged span must cover most of the notice.  Hits are checked word by
word, so a hash collision never votes.

The template table is fixed in size (the notices below) and is the only thing
broadcast.  A document is its own group, whatever its phrases, so a phrase
that a third of all documents carry makes no hot key.

Defined cases: a null or blank text has no words, no places and empty labels;
repeated rows are scanned one by one; documents without a hit are returned
with zero counts; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakline.llm.common import documents

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 2            # words in a rolling gram
GAP = 3             # diagonals at most this far apart are one span
COVERAGE = 0.8      # share of a notice's words that a span must cover
STRETCH = 1.5       # a span is at most so many times as long as the notice

#: Phrases whose every place is counted.
PHRASES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
#: Opening words of well-known public license notices, found with small changes too.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
]


def words(text: Column) -> Column:
    """Words of ``text``, A-Z lower-cased (letters beyond ASCII stay inside words either way)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def template_grams(spark: SparkSession, phrases=None, notices=None) -> DataFrame:
    """One row per 2-gram of each template, and the row that every document hits once."""
    rows = []
    for base, table in ((True, PHRASES if phrases is None else phrases), (False, NOTICES if notices is None else notices)):
        for label, text in table:
            w = re.findall(WORD, text)
            rows += [(label, base, t, len(w), w[t], w[t + 1]) for t in range(len(w) - GRAM + 1)]
    table = spark.createDataFrame(rows, "label string, base boolean, t int, size int, w1 string, w2 string")
    table = table.withColumn("gram", F.xxhash64("w1", "w2"))
    every = spark.range(1).select(F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"),
                                  F.lit(-1).alias("t"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("w1"),
                                  F.lit(None).cast("string").alias("w2"), F.lit(0).cast("long").alias("gram"))
    return table.unionByName(every)


def scan(docs: DataFrame, phrases=None, notices=None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"),
                       words(F.col("text")).alias("_w"))
    own = F.array(F.lit(0).cast("long"))  # at place 0: hits the table's row for every document
    grams = F.when(F.size("_w") >= GRAM, F.concat(own, F.transform(
        F.sequence(F.lit(0), F.size("_w") - GRAM),
        lambda i: F.xxhash64(F.get(F.col("_w"), i), F.get(F.col("_w"), i + 1))))).otherwise(own)
    placed = rows.select("_row", "doc_id", "_w", grams.alias("_g")).select(
        "_row", "doc_id", "_w", F.posexplode("_g").alias("_p", "gram"))
    hits = placed.join(F.broadcast(template_grams(docs.sparkSession, phrases, notices)), "gram")
    pos = F.col("_p") - 1
    same = F.when(F.col("t") < 0, F.col("_p") == 0).otherwise(
        (F.col("_p") > 0) & (F.get("_w", pos) == F.col("w1")) & (F.get("_w", pos + 1) == F.col("w2")))
    hits = hits.where(same).select("_row", "doc_id", F.when(F.col("t") < 0, F.size("_w")).alias("n_words"),
                                   "label", "base", "t", "size", pos.alias("pos"), (pos - F.col("t")).alias("diagonal")).repartition("_row")

    group = ["_row", "label", "base", "size"]
    by_diagonal = Window.partitionBy(*group).orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by_diagonal)) > F.when(F.col("base"), 0).otherwise(GAP)
    votes = hits.select("*", F.when(apart, 1).otherwise(0).alias("_new"))
    votes = votes.select("*", F.sum("_new").over(by_diagonal.rangeBetween(Window.unboundedPreceding, 0)).alias("_span"))
    spans = votes.groupBy(*group, "_span").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.min("pos").alias("start"), (F.max("pos") + GRAM).alias("end"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.array(F.col("t"), F.col("t") + 1))))).alias("covered"))
    cover = F.col("covered") / F.greatest("size", F.lit(1))
    found = F.when(F.col("label").isNull(), False).when(F.col("base"), F.col("covered") == F.col("size")).otherwise(
        (cover >= COVERAGE) & (F.col("end") - F.col("start") <= STRETCH * F.col("size")))
    base = found & F.col("base")
    span = F.struct("start", "end", "label")
    out = spans.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(found, cover)), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(found, span))).alias("spans"))
    return out.drop("_row")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("spans")
