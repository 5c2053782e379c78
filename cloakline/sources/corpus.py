"""Corpus sources: annotated scan (SRC-1), plain scan (SRC-2), and the
derived notes corpus built from ``customer`` (truth spans known by design).

The notes corpus composes one sentence per customer with integer arithmetic
and ``concat``/``lpad`` only, so that any SQL engine rebuilds identical text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.functions.text import strip

# --- FIXED VALUES: month names used when composing dates ---
MONTHS = ["January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December"]


def _lp(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _s(x: Column) -> Column:
    return x.cast("string")


def note_parts(k: Column) -> dict[str, Column]:
    """The personal values composed for customer key ``k``."""
    area, exch, line = _lp(200 + k % 800, 3), _lp(100 + k % 900, 3), _lp(k % 10000, 4)
    mon, day, year = 1 + k % 12, 1 + k % 28, 1940 + k % 80
    age = 10 + k % 90
    card_sp = F.concat(F.lit("4"), _lp(k % 1000, 3), F.lit(" "), _lp(k % 10000, 4), F.lit(" "),
                       _lp((k * 7) % 10000, 4), F.lit(" "), _lp((k * 13) % 10000, 4))
    return {
        "ssn": F.concat(_lp(k % 1000, 3), F.lit("-"), _lp(k % 97, 2), F.lit("-"), _lp(k % 10000, 4)),
        "phone_dash": F.concat(area, F.lit("-"), exch, F.lit("-"), line),
        "phone_dot": F.concat(area, F.lit("."), exch, F.lit("."), line),
        "phone_par": F.concat(F.lit("("), area, F.lit(") "), exch, F.lit("-"), line),
        "email": F.concat(F.lit("user"), _s(k), F.lit("@example.com")),
        "date_slash": F.concat(_s(mon), F.lit("/"), _s(day), F.lit("/"), _s(year)),
        "date_dash": F.concat(_s(mon), F.lit("-"), _s(day), F.lit("-"), _s(year)),
        "date_name": F.concat(F.element_at(F.array(*[F.lit(m) for m in MONTHS]), mon.cast("int")),
                              F.lit(" "), _s(day), F.lit(", "), _s(year)),
        "age_old": F.concat(_s(age), F.lit("-year-old")),
        "age_years": F.concat(_s(age), F.lit(" years of age")),
        "mrn": F.concat(F.lit("MRN "), _lp(k % 100000, 5)),
        "pid": F.concat(F.lit("Patient ID "), _lp(k, 7)),
        "card_sp": card_sp,
        "card_plain": F.replace(card_sp, F.lit(" "), F.lit("")),
        "zip": _lp(k % 100000, 5),
        "qty": _lp(10000 + k % 90000, 5),
    }


def _span(x: Column, t: str) -> Column:
    return F.struct(x.alias("span"), F.lit(t).alias("phi_type"))


def notes(customer: DataFrame) -> DataFrame:
    """Samples ``(doc_id, seq, dataset, text, phi_spans)``, one per customer."""
    k = F.col("c_custkey")
    p = note_parts(k)
    name = F.col("c_name")
    v = k % 4
    text = (
        F.when(v == 0, F.concat(name, F.lit(" (SSN "), p["ssn"], F.lit(") was seen on "), p["date_slash"],
                                F.lit("; call "), p["phone_dash"], F.lit(" or "), p["phone_dash"], F.lit(" again.")))
        .when(v == 1, F.concat(name, F.lit(", a "), p["age_old"], F.lit(", email "), p["email"], F.lit(", phone "),
                               p["phone_dot"], F.lit(", "), p["mrn"], F.lit(", ordered "), p["qty"], F.lit(" units.")))
        .when(v == 2, F.concat(name, F.lit(" and his wife visited on "), p["date_name"], F.lit("; "), p["pid"],
                               F.lit("; card "), p["card_sp"], F.lit("; phone "), p["phone_par"], F.lit(".")))
        .otherwise(F.concat(name, F.lit(", "), p["age_years"], F.lit(", her son born "), p["date_dash"],
                            F.lit(", ZIP "), p["zip"], F.lit(", card "), p["card_plain"], F.lit(".")))
    )
    truth = (
        F.when(v == 0, F.array(_span(name, "PERSON"), _span(p["ssn"], "SSN"), _span(p["date_slash"], "DATE"),
                               _span(p["phone_dash"], "PHONE")))
        .when(v == 1, F.array(_span(name, "PERSON"), _span(p["age_old"], "AGE"), _span(p["email"], "EMAIL"),
                              _span(p["phone_dot"], "PHONE"), _span(p["mrn"], "ID_NUMBER")))
        .when(v == 2, F.array(_span(name, "PERSON"), _span(F.lit("wife"), "RELATIONSHIP"),
                              _span(p["date_name"], "DATE"), _span(p["pid"], "ID_NUMBER"),
                              _span(p["card_sp"], "CREDIT_CARD"), _span(p["phone_par"], "PHONE")))
        .otherwise(F.array(_span(name, "PERSON"), _span(p["age_years"], "AGE"), _span(F.lit("son"), "RELATIONSHIP"),
                           _span(p["date_dash"], "DATE"), _span(p["zip"], "LOCATION"),
                           _span(p["card_plain"], "CREDIT_CARD")))
    )
    return customer.select(
        k.alias("doc_id"), k.alias("seq"), F.lit("notes").alias("dataset"),
        text.alias("text"), truth.alias("phi_spans"),
    )


def documents_as_samples(documents: DataFrame, dataset: str = "documents") -> DataFrame:
    """SRC-2 over the ``documents`` table: stripped text, blanks skipped, no truth."""
    t = strip(F.col("text"))
    return (
        documents.select(F.col("doc_id"), F.col("doc_id").alias("seq"), F.lit(dataset).alias("dataset"), t.alias("text"))
        .filter(F.col("text") != "")
        .withColumn("phi_spans", F.array().cast("array<struct<span:string,phi_type:string>>"))
    )


def raw_annotated(customer: DataFrame) -> DataFrame:
    """A raw annotated corpus in the external layout, derived from notes.

    ``(row_id, source_text, text, privacy_mask ARRAY<STRUCT<value, text, span, label>>)``
    with the layout's irregularities: text in either column, blank rows,
    annotation value in one of three fields, values absent from the text,
    missing labels.
    """
    n = notes(customer)
    k = F.col("doc_id")
    v = k % 5
    masks = F.transform(
        F.col("phi_spans"),
        lambda s, i: F.struct(
            F.when((i % 3) == 0, s["span"]).alias("value"),
            F.when((i % 3) == 1, s["span"]).otherwise(F.when(i == 2, F.lit("")) ).alias("text"),
            F.when((i % 3) == 2, s["span"]).alias("span"),
            F.when((k + i) % 7 != 0, s["phi_type"]).alias("label"),
        ),
    )
    masks = F.concat(masks, F.array(F.struct(F.lit("not in text").alias("value"), F.lit(None).cast("string").alias("text"),
                                             F.lit(None).cast("string").alias("span"), F.lit("PERSON").alias("label"))))
    source_text = F.when(v == 0, F.lit(None).cast("string")).when(v == 1, F.lit("")).when(v == 2, F.lit("   ")).otherwise(F.col("text"))
    text = F.when(v == 2, F.lit(None).cast("string")).when(v == 3, F.lit("ignored")).otherwise(F.col("text"))
    return n.select(k.alias("row_id"), source_text.alias("source_text"), text.alias("text"), masks.alias("privacy_mask"))


def load_annotated(raw: DataFrame, dataset: str = "annotated") -> DataFrame:
    """SRC-1: text from ``source_text`` then ``text`` (empty falls through),
    blank rows skipped, annotation value from value/text/span, kept only when
    contained in the text, label defaulting to ``UNKNOWN``."""
    text = F.coalesce(F.nullif(F.col("source_text"), F.lit("")), F.nullif(F.col("text"), F.lit("")), F.lit(""))
    rows = raw.select(F.col("row_id"), text.alias("text"), F.col("privacy_mask"))
    rows = rows.filter(strip(F.col("text")) != "")
    val = lambda m: F.coalesce(F.nullif(m["value"], F.lit("")), F.nullif(m["text"], F.lit("")),
                               F.coalesce(m["span"], F.lit("")))
    spans = F.transform(
        F.filter(F.coalesce(F.col("privacy_mask"), F.array()), lambda m: (val(m) != "") & F.contains(F.col("text"), val(m))),
        lambda m: F.struct(val(m).alias("span"), F.coalesce(m["label"], F.lit("UNKNOWN")).alias("phi_type")),
    )
    return rows.select(
        F.col("row_id").alias("doc_id"), F.col("row_id").alias("seq"), F.lit(dataset).alias("dataset"),
        F.col("text"), spans.alias("phi_spans"),
    )


def first_n(samples: DataFrame, n: int) -> DataFrame:
    """SO-5: the first ``n`` samples in corpus order (a top-n, the feature itself)."""
    return samples.orderBy("seq").limit(n)
