"""Model-response tables (SRC-5), recogniser results (SRC-6) and phrases.

No model ships with the engine: replies arrive as a table
``(doc_id, kind, raw STRING)``.  For tests and registered queries the
replies are composed from the notes corpus with ``concat`` only, with the
irregularities a chat model produces (fences, control characters, broken
JSON, spans absent from the text, missing fields).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.sources.corpus import note_parts

def _lit(s: str) -> Column:
    return F.lit(s)


def _k() -> Column:
    return F.col("doc_id")


def _val_by_variant(k: Column) -> tuple[Column, Column]:
    p = note_parts(k)
    v = k % 4
    val = F.when(v == 0, p["ssn"]).when(v == 1, p["email"]).when(v == 2, F.lit("wife")).otherwise(p["zip"])
    typ = F.when(v == 0, F.lit("ssn")).when(v == 1, F.lit("email")).when(v == 2, F.lit("relationship")) \
        .otherwise(F.lit("location"))
    return val, typ


def detect_raw(notes: DataFrame) -> DataFrame:
    """kind='detect' replies: one JSON array per note."""
    k = _k()
    name = F.element_at(F.col("phi_spans"), 1)["span"]
    val, typ = _val_by_variant(k)
    hp = F.when(k % 3 == 0, _lit("true")).otherwise(_lit("false"))
    items = F.concat(
        _lit('[{"span": "'), name, _lit('", "phi_type": "person", "confidence": 0.9, "has_pattern": '), hp, _lit("}, "),
        _lit('{"span": "'), val, _lit('", "phi_type": "'), typ, _lit('", "confidence": 0.8}, '),
        _lit('{"span": "Nobody Here", "phi_type": "PERSON", "confidence": 0.95}, '),
        _lit('{"span": "Customer", "phi_type": "org", "confidence": 0.3}, '),
        _lit('{"span": "Customer", "phi_type": "org"}, '),
        _lit('{"span": "'), name, _lit('", "confidence": 0.99}]'),
    )
    w = k % 5
    raw = (F.when(w == 0, F.concat(_lit("```json\n"), items, _lit("\n```")))
           .when(w == 1, F.concat(_lit("["), F.expr("chr(1)"), F.substr(items, F.lit(2))))
           .when(w == 2, F.substring(items, F.lit(1), F.length(items) - 1))
           .otherwise(items))
    return notes.select("doc_id", _lit("detect").alias("kind"), raw.alias("raw"))


def critic_raw(notes: DataFrame) -> DataFrame:
    """kind in (leakage, fluency, overencryption) replies per note."""
    k = _k()
    name = F.element_at(F.col("phi_spans"), 1)["span"]
    second = F.element_at(F.col("phi_spans"), 2)["span"]
    w = k % 5
    leak = (F.when(w == 0, _lit('{"leaked_spans": [], "is_clean": true, "confidence": 0.9}'))
            .when(w == 1, F.concat(_lit('{"leaked_spans": ["'), name, _lit('"], "is_clean": false, "confidence": 0.8}')))
            .when(w == 2, F.concat(_lit('```json\n{"leaked_spans": ["'), name, _lit('", "Nobody"], "is_clean": false}\n```')))
            .when(w == 3, _lit("not json at all"))
            .otherwise(F.concat(_lit('{"leaked_spans": [], "is_clean": true, "confidence": 0.7, "note": "C:\\data'),
                                F.expr("chr(10)"), _lit('x"}'))))
    f = k % 3
    flu = (F.when(f == 0, _lit('{"is_fluent": true, "fluency_score": 0.9, "reason": "ok"}'))
           .when(f == 1, _lit('{"is_fluent": false, "fluency_score": 0.3, "reason": "odd"}'))
           .otherwise(_lit("")))
    over = F.when(k % 6 == 0, F.concat(_lit('{"over_encrypted": ["'), second, _lit('"], "is_accurate": false}'))) \
        .otherwise(_lit('{"over_encrypted": [], "is_accurate": true}'))
    base = notes.select("doc_id", leak.alias("leakage"), flu.alias("fluency"), over.alias("overencryption"))
    return base.select("doc_id", F.explode(F.array(
        F.struct(_lit("leakage").alias("kind"), F.col("leakage").alias("raw")),
        F.struct(_lit("fluency").alias("kind"), F.col("fluency").alias("raw")),
        F.struct(_lit("overencryption").alias("kind"), F.col("overencryption").alias("raw")),
    )).alias("r")).select("doc_id", "r.kind", "r.raw")


def phrases(notes: DataFrame) -> DataFrame:
    """Abstraction phrases ``(doc_id, span, phrase)`` for the person name of every third note."""
    name = F.element_at(F.col("phi_spans"), 1)["span"]
    return notes.filter(_k() % 3 == 0).select(
        "doc_id", name.alias("span"), _lit("  the  patient on record in this file ").alias("phrase"))


def entities(notes: DataFrame) -> DataFrame:
    """SRC-6 recogniser results ``(system, doc_id, start, end, entity_type)``."""
    k = _k()
    p = note_parts(k)
    v = k % 4
    name = F.element_at(F.col("phi_spans"), 1)["span"]
    age = (10 + k % 90).cast("string")
    pos = lambda s: F.instr(F.col("text"), s) - 1
    second = (F.when(v == 0, F.struct(pos(p["date_slash"]).alias("start"), (pos(p["date_slash"]) + F.length(p["date_slash"])).alias("end"), _lit("DATE").alias("t")))
              .when(v == 1, F.struct(pos(p["age_old"]).alias("start"), (pos(p["age_old"]) + F.length(age)).alias("end"), _lit("CARDINAL").alias("t")))
              .when(v == 2, F.struct(pos(_lit("wife")).alias("start"), (pos(_lit("wife")) + 4).alias("end"), _lit("NORP").alias("t")))
              .otherwise(F.struct(pos(p["zip"]).alias("start"), (pos(p["zip"]) + 5).alias("end"), _lit("GPE").alias("t"))))
    # every third document has an entity that overlaps the name and is longer, every other third a shorter one
    third = (F.when(k % 3 == 0, F.struct(F.lit(2).alias("start"), (F.length(name) + 3).alias("end"), _lit("ORG").alias("t")))
             .when(k % 3 == 1, F.struct(F.lit(1).alias("start"), (F.length(name) - 1).alias("end"), _lit("ORG").alias("t"))))
    rows = notes.filter(k % 11 != 5).select("doc_id", F.array(  # some documents have none
        F.struct(F.lit(0).alias("start"), F.length(name).alias("end"), _lit("PERSON").alias("t")), second, third).alias("e"))
    found = rows.select("doc_id", F.explode(F.filter("e", lambda x: x.isNotNull())).alias("x")).select(
        "doc_id", F.explode(F.array(_lit("ner"), _lit("pii"))).alias("system"), "x")
    return found.select(
        "system", "doc_id", F.col("x.start").cast("int").alias("start"), F.col("x.end").cast("int").alias("end"),
        F.col("x.t").alias("entity_type"))


GUESS_VALUE = r"[0-9][0-9.()/-]*[0-9]|[A-Za-z0-9.]+@[A-Za-z0-9.]+"


def guess_raw_column(masked: Column) -> Column:
    """An adversary's reply listing the values still visible in ``masked``,
    wrapped in prose so that the first-array extraction is exercised."""
    vals = F.regexp_extract_all(masked, F.lit(GUESS_VALUE), 0)
    arr = F.when(F.size(vals) == 0, _lit("[]")).otherwise(
        F.concat(_lit('["'), F.array_join(vals, '", "'), _lit('"]')))
    return F.concat(_lit("Here is my list: "), arr, _lit(" and more [x]"))


def duplicates(table: DataFrame) -> DataFrame:
    """SRC-5: the replies that the jobs pass over, for a rejects table: of several
    replies of one kind to a document only the largest raw text is used."""
    used = table.groupBy("doc_id", "kind").agg(F.max("raw").alias("_used"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    extra = table.join(used, ["doc_id", "kind"])
    same = extra.groupBy("doc_id", "kind", "raw", "_used").agg(F.count(F.lit(1)).alias("_n"))
    times = F.col("_n") - F.when(F.col("raw").eqNullSafe(F.col("_used")), 1).otherwise(0)
    return same.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), times))).filter("_k > 0").select("doc_id", "kind", "raw")
