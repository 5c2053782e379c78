"""Exact quantiles of groups of any size by radix selection.

Each round counts the values of every interval in BINS bins (equal in magnitude
while its ends are far apart, then equal in width) and goes on with the bins that hold the wanted ranks, narrowed to the least and the greatest
value in them.  An interval's ends fall into different bins, so every round
gets closer; after a few the bins that are left hold few rows, and those
alone are sorted.  Rows are combined before each shuffle, and no group, however
large, meets in one task or in one aggregate's state.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakline.session import cut_lineage

BINS = 1 << 12
FEW = 1 << 12   # rows of an interval that are sorted at the end


def _magnitude(x: Column) -> Column:
    """Rises with x, about one for each power of two."""
    size = 1076 + F.log2(F.abs(x))  # at least 2
    return F.when(x > 0, size).when(x < 0, -size).otherwise(0.0)


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Place of x among ``bins`` bins from lo to hi, equal in magnitude if they are far apart; infinities and NaN (the
    greatest) have bins of their own."""
    powers, width = _magnitude(hi) - _magnitude(lo), hi - lo
    even = F.when(width < F.lit(math.inf), (x - lo) / width).otherwise((x / 2 - lo / 2) / (hi / 2 - lo / 2))
    share = F.when(powers > 2, (_magnitude(x) - _magnitude(lo)) / powers).otherwise(even)
    inside = F.greatest(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0))
    return (F.when(F.isnan(x), bins + 1).when(x == F.lit(math.inf), bins).when(x == F.lit(-math.inf), -1)
            .when(lo < hi, inside).otherwise(0).cast("int"))


def _held(x: Column, lo: Column, hi: Column) -> Column:
    return (x >= lo) & (x <= hi)


def quantiles(df: DataFrame, group: tuple[str, ...], value: str, probabilities: list[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(*group, q0, q1, ...): the quantiles of ``value``, linear between neighbours; nulls are no values.

    A group whose values are all null has no row.  ``df`` is read a few times.
    """
    rows = df.select(F.struct(F.lit(0).alias("_"), *[F.col(c) for c in group]).alias("g"), F.col(value).cast("double").alias("x")).filter("x IS NOT NULL")
    finite = ~F.isnan("x") & (F.abs("x") < F.lit(math.inf))
    spans = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(F.when(finite, F.col("x"))), F.lit(0.0)).alias("lo"),
                                  F.coalesce(F.max(F.when(finite, F.col("x"))), F.lit(0.0)).alias("hi"))
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(up).alias("up"), F.least(F.floor(place(p)) + up, F.col("n") - 1).alias("r"))
                       for k, p in enumerate(probabilities) for up in (0, 1)])
    open_ = spans.select("g", "n", "lo", "hi", F.lit(0).cast("long").alias("below"), F.explode(wanted).alias("w")).select(
        "g", "n", "lo", "hi", "below", "w.*")
    done = None
    while True:
        ranges = open_.select(F.col("g").alias("_g"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).distinct()
        met = rows.join(ranges, F.col("g").eqNullSafe(F.col("_g")))
        if done is not None:
            met = met.filter(_held(F.col("x"), F.col("_lo"), F.col("_hi")))
        counted = met.groupBy("_g", "_lo", "_hi", _bin(F.col("x"), F.col("_lo"), F.col("_hi"), bins).alias("bin")).agg(
            F.count(F.lit(1)).alias("c"), F.min("x").alias("a"), F.max("x").alias("b"))
        order = Window.partitionBy("_g", "_lo", "_hi").orderBy("bin")  # of at most bins + 3 rows
        counted = counted.withColumn("before", F.sum("c").over(order) - F.col("c"))
        hit = open_.join(counted, F.col("g").eqNullSafe(F.col("_g")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")))
        rank = F.col("r") - F.col("below") - F.col("before")
        found = cut_lineage(hit.filter((rank >= 0) & (rank < F.col("c"))).select(
            "g", "k", "up", "r", F.col("c").alias("n"), F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("below") + F.col("before")).alias("below")))
        settled = found.filter(~(F.col("lo") < F.col("hi"))).select("g", "k", "up", F.col("lo").alias("v"))
        done = settled if done is None else done.unionByName(settled)
        open_ = found.filter("lo < hi")
        if (open_.agg(F.max("n")).first()[0] or 0) <= few:
            break
    last = open_.select(F.col("g").alias("_g"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).distinct()
    few_rows = rows.join(last, F.col("g").eqNullSafe(F.col("_g"))).filter(_held(F.col("x"), F.col("_lo"), F.col("_hi"))).groupBy(
        "_g", "_lo", "_hi").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    picked = open_.join(few_rows, F.col("g").eqNullSafe(F.col("_g")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi"))).select(
        "g", "k", "up", F.get("xs", (F.col("r") - F.col("below")).cast("int")).alias("v"))
    values = done.unionByName(picked).groupBy("g").agg(*[
        F.max(F.when((F.col("k") == k) & (F.col("up") == up), F.col("v"))).alias(f"v{k}_{up}") for k in range(len(probabilities)) for up in (0, 1)])
    out = values.join(spans.select(F.col("g").alias("_g"), "n"), F.col("g").eqNullSafe(F.col("_g")))
    between = []
    for k, p in enumerate(probabilities):
        part, lower, upper = place(p) - F.floor(place(p)), F.col(f"v{k}_0"), F.col(f"v{k}_1")
        between.append(F.when((part == 0) | (lower == upper), lower).otherwise(lower + (upper - lower) * part).alias(f"q{k}"))
    return out.select(*[F.col("g")[c].alias(c) for c in group], *between)


def with_quantiles(summary: DataFrame, found: DataFrame, group: tuple[str, ...], names: list[str]) -> DataFrame:
    """``summary`` (one row per group) with the quantile columns under ``names``; null where a group has none."""
    named = found.select(*[F.col(c).alias(f"_{c}") for c in group], *[F.col(f"q{k}").alias(n) for k, n in enumerate(names)])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group], F.lit(True))
    return summary.join(named, same, "left").drop(*[f"_{c}" for c in group])
