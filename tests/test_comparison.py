"""Registered systems over several datasets: a fifth system, a failing one, unknown names, the written tables."""

import tempfile

import pytest
from pyspark.sql import functions as F

from cloakline.plans import evaluate as EV
from cloakline.sources import sinks
from cloakline.sources.patterns import seed_inline
from mask_samples import samples


def shouting(df, names):
    """A system of one's own: words in capitals are names."""
    pred = F.transform(F.regexp_extract_all("text", F.lit(r"\b([A-Z]{2,})\b"), 1), lambda x: F.struct(x.alias("span"), F.lit("PERSON").alias("phi_type")))
    return df.filter("doc_id <> 2").select(F.lit(names[0]).alias("system"), "doc_id", F.regexp_replace("text", r"\b[A-Z]{2,}\b", "X").alias("masked"),
                                           pred.cast(EV.PRED_T).alias("pred"), F.lit(0).alias("cache_hits"), F.lit(0).alias("cache_misses"))


def failing(df, names):
    return df.select("no such column")


@pytest.fixture()
def datasets(spark):
    return {"a": samples(spark, [(1, "ANN 555-123-4567", [("ANN", "PERSON"), ("555-123-4567", "PHONE")]), (2, "BOB", [("BOB", "PERSON")])]),
            "b": samples(spark, [(1, "nothing here", [])])}


@pytest.fixture()
def compared(secret):
    wide = lambda df, names: EV.systems_wide(df, secret, names, seed_inline(None))
    return EV.Comparison().register(("cold", "regex", "full_encryption"), wide).register(("shouting",), shouting).register(("failing",), failing)


def test_every_sample_has_a_row_of_every_system(datasets, compared):
    with pytest.warns(UserWarning, match="failing on a"):
        out = compared.outputs(datasets, ("a", "unknown", "b", "a"))
    rows = {(r.dataset, r.system, r.doc_id): r for r in out.collect()}
    assert set(rows) == {(d, s, k) for d, k in (("a", 1), ("a", 2), ("b", 1)) for s in compared.systems}
    assert {k for k, r in rows.items() if r.fallback} == {("a", "shouting", 2), *((d, "failing", k) for d, k in (("a", 1), ("a", 2), ("b", 1)))}
    assert rows["a", "shouting", 1].masked == "X 555-123-4567" and rows["a", "shouting", 2].masked == "BOB"
    assert [p.span for p in rows["a", "cold", 1].pred] == ["555-123-4567"]


def test_chosen_systems_and_names(datasets, compared):
    out = compared.outputs(datasets, ("b",), ("regex", "shouting", "nobody"))
    assert {r.system for r in out.collect()} == {"regex", "shouting"}
    with pytest.raises(ValueError, match="no such dataset"):
        compared.outputs(datasets, ("unknown",))
    with pytest.raises(ValueError, match="registered already"):
        compared.register(("cold",), shouting)


def test_tables_are_written_by_dataset(spark, datasets, compared):
    out = compared.outputs(datasets, ("a", "b"), ("cold", "shouting"))
    latency = spark.createDataFrame([(1, 4.0), (2, 8.0)], "doc_id long, latency_ms double")
    tables = EV.benchmark_tables(out, latency)
    root = tempfile.mkdtemp(prefix="cloakline-bench-")
    assert sinks.write_benchmark(tables, root) == ["detection", "latency", "security", "per_type"]
    back = {(r.dataset, r.system): r for r in spark.read.option("header", True).csv(f"{root}/benchmark_detection").collect()}
    assert set(back) == {(d, s) for d in "ab" for s in ("cold", "shouting")} and back["a", "shouting"].n_fallback == "1"
    timed = {(r.dataset, r.system): (r.mean_ms, r.median_ms, r.min_ms) for r in tables["latency"].collect()}
    assert timed["a", "cold"] == (6.0, 6.0, 4.0) and timed["b", "cold"] == (4.0, 4.0, 4.0)
    types = {(r.dataset, r.system, r.phi_type): (r.tp, r.fp, r.fn) for r in tables["per_type"].collect()}
    assert types["a", "shouting", "PERSON"] == (1, 0, 1) and types["a", "cold", "PHONE"] == (1, 0, 0)
