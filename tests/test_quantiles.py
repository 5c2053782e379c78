"""Radix selection against sorted lists; focus lists without a clean validation against a fold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cloakline.operators import control as CT
from cloakline.operators import metrics as MT
from cloakline.operators.quantiles import quantiles

P = [0.0, 0.1, 0.5, 0.95, 1.0]


def interpolated(values, p):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    at = p * (len(v) - 1)
    lo, hi = v[math.floor(at)], v[min(math.floor(at) + 1, len(v) - 1)]
    return lo if at == math.floor(at) or lo == hi else lo + (hi - lo) * (at - math.floor(at))


@pytest.mark.parametrize(("bins", "few"), [(1 << 12, 1 << 12), (64, 3), (256, 0)])
def test_quantiles_equal_sorted_lists(spark, bins, few):
    rng = random.Random(bins)
    groups = {"one": [5.0], "two": [1.0, 2.0], "same": [7.5] * 40, None: [rng.gauss(0, 1) for _ in range(101)],
              "wide": [rng.choice([-1, 1]) * 2.0 ** rng.randint(-900, 900) for _ in range(60)], "few": [rng.choice([1.0, 1.0 + 2 ** -52, 3.0]) for _ in range(90)],
              "tiny": [0.0, 5e-324, 1.5e-323, 2e-323] * 5, "whole range": [-1.7e308, 1.7e308, 0.0] * 4,
            "ends": [-math.inf, math.inf, math.inf, 1.5, -2.0, math.nan]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("empty", None), ("two", None)]
    rng.shuffle(rows)
    got = quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ("g",), "x", P, bins, few).collect()
    assert {r.g for r in got} == set(groups)
    for r in got:
        for k, p in enumerate(P):
            want, have = interpolated(groups[r.g], p), r[f"q{k}"]
            assert (math.isnan(want) and math.isnan(have)) or have == pytest.approx(want, rel=1e-12), (r.g, p)


def test_quantiles_without_groups_and_of_nothing(spark):
    df = spark.range(1001).select((F.col("id") % 97).cast("double").alias("x"))
    assert tuple(quantiles(df, (), "x", [0.5], 8, 8).first()) == (interpolated([float(k % 97) for k in range(1001)], 0.5),)
    assert quantiles(df.filter("x < 0"), (), "x", [0.5]).count() == 0
    assert MT.latency_stats(df.filter("x < 0").withColumns({"cache_hits": F.lit(0), "cache_misses": F.lit(0)}), "x").first().median_ms is None


def test_quantiles_of_one_group_of_ten_million_rows(spark):
    n = 10_000_000
    df = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("x"))
    assert tuple(quantiles(df, ("g",), "x", [0.5, 0.95]).first()) == ("g", (n - 1) / 2, pytest.approx(0.95 * (n - 1)))


@pytest.mark.parametrize("clean", [0.0, 0.02, 0.5])
def test_focus_list_equals_a_fold(spark, clean):
    rng = random.Random(3)
    types = ["NAME", "DATE", "PHONE", "ZIP", "", None]
    rows, spans, want, focus = [], [], {}, []
    for s in range(1500):
        own = [(p, f"v{p}", rng.choice(types)) for p in range(rng.randint(0, 3))]
        ok, leaked = rng.random() < clean, [f"v{p}" for p in range(4) if rng.random() < 0.2]
        rows.append((s, s + 50, ok, leaked))
        spans += [(s + 50, *x) for x in own]
        focus = [] if ok else focus + [t for t in dict.fromkeys(t for _, v, t in own if v in leaked and t) if t not in focus]
        want[s] = list(focus)
    v = spark.createDataFrame(rows, "seq long, doc_id long, is_clean boolean, leaked_spans array<string>")
    sp = spark.createDataFrame(spans, "doc_id long, pos int, span string, phi_type string")
    assert {r.seq: r.phi_types_focus for r in CT.focus_trace(v, sp).collect()} == want


def test_rows_of_a_large_group_are_spread(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") < 15_000, 0).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("_n")).withColumn("v", F.col("k") * 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = CT.attach_lists(rows, groups, "k", "v")
        per = [r.n for r in out.repartition(8, "id").groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()]
        tasks = out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(per) == 20_000 and max(r.n for r in tasks) < 9_000
