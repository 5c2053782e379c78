"""Skew-safe ordered scans.

``running_sums``: per-key running sums over an order column without one
window partition per key: rows are cut into blocks of the order column,
block totals are prefix-summed (a much smaller table), and each row adds
its block offset to an in-block running sum.  A key holding a third of
all rows is spread over many blocks instead of one task.

``prefix_clamp``: the ordered fold ``x -> min(hi, max(lo, x + a))`` of
WN-5.  Such steps compose into a step of the same shape, so the fold is a
tree scan: compose within blocks of ``fanout`` rows (bounded groups), scan
the block results recursively, then replay inside each block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIG = 10**12  # stands for +/- infinity in integer step bounds


def running_sums(df: DataFrame, keys: list[str], order: str, values: list[str], block: int = 1 << 16,
                 prefix: str = "run_") -> DataFrame:
    """Inclusive running sums of ``values`` per ``keys`` ordered by ``order`` (unique per key)."""
    blk = F.floor(F.col(order) / F.lit(block)).cast("long")
    d = df.withColumn("_blk", blk)
    totals = d.groupBy(*keys, "_blk").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    wb = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1) if keys else \
        Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_blk", *[F.coalesce(F.sum(f"_t_{v}").over(wb), F.lit(0)).alias(f"_o_{v}")
                                              for v in values])
    wr = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = d.select("*", *[F.sum(v).over(wr).alias(f"_r_{v}") for v in values])
    out = inner.join(offsets, [*keys, "_blk"], "inner")
    return out.select(*[c for c in df.columns],
                      *[(F.col(f"_r_{v}") + F.col(f"_o_{v}")).alias(f"{prefix}{v}") for v in values])


# ------------------------------------------------------------------ clamp steps
def compose(f: Column, g: Column) -> Column:
    """g after f for steps struct<a, lo, hi> (x -> min(hi, max(lo, x + a)))."""
    a2, l2, h2 = g["a"], g["lo"], g["hi"]
    return F.struct(
        (f["a"] + a2).alias("a"),
        F.least(h2, F.greatest(l2, f["lo"] + a2)).alias("lo"),
        F.least(h2, F.greatest(l2, f["hi"] + a2)).alias("hi"),
    )


def _identity() -> Column:
    return F.struct(F.lit(0).cast("long").alias("a"), F.lit(-BIG).cast("long").alias("lo"),
                    F.lit(BIG).cast("long").alias("hi"))
STEP_T = "struct<a:bigint,lo:bigint,hi:bigint>"


def apply_step(step: Column, x: Column) -> Column:
    return F.least(step["hi"], F.greatest(step["lo"], x + step["a"]))


def step(a, lo=None, hi=None) -> Column:
    return F.struct(F.lit(a).cast("long").alias("a"),
                    F.lit(-BIG if lo is None else lo).cast("long").alias("lo"),
                    F.lit(BIG if hi is None else hi).cast("long").alias("hi"))


def _each(names: list[str], fn) -> Column:
    return F.struct(*[fn(n).alias(n) for n in names])


def _local_prefix(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows (gid, id, t) with a struct ``t`` of steps; per group (<= fanout rows): the
    group's ``total`` and the exclusive prefix of each row (``out``)."""
    kind = "struct<" + ",".join(f"{n}:{STEP_T}" for n in names) + ">"
    g = df.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("id", "t"))).alias("xs"))
    start = _each(names, lambda n: _identity())
    init = F.struct(start.alias("acc"), F.array().cast(f"array<struct<id:bigint,ex:{kind}>>").alias("out"))
    folded = F.aggregate(
        F.col("xs"), init,
        lambda st, x: F.struct(_each(names, lambda n: compose(st["acc"][n], x["t"][n])).alias("acc"),
                               F.array_append(st["out"], F.struct(x["id"].alias("id"), st["acc"].alias("ex"))).alias("out")))
    return g.select("gid", folded.alias("f")).select("gid", F.col("f.acc").alias("total"), F.col("f.out").alias("out"))


def prefix_clamp(df: DataFrame, order: str, steps: str | list[str], fanout: int = 256) -> DataFrame:
    """Adds ``prefix`` = composition of all steps with order <= this row's (inclusive); with
    several step columns, folded together, one ``prefix_<column>`` each.

    ``order`` must be a dense 0-based sequence (``seq``).  Depth of the tree
    is log_fanout(n); every group holds at most ``fanout`` elements.  A level's
    local prefixes serve the way up (totals) and the way down.
    """
    names = [steps] if isinstance(steps, str) else list(steps)
    n = df.agg(F.max(order)).first()[0]
    n = 0 if n is None else int(n) + 1
    levels = max(1, math.ceil(math.log(max(n, 2), fanout)))
    rows = df.select(F.col(order).cast("long").alias("id"), F.struct(*names).alias("t"))
    local = []
    for _ in range(levels):
        local.append(_local_prefix(rows.withColumn("gid", F.floor(F.col("id") / fanout).cast("long")), names))
        rows = local[-1].select(F.col("gid").alias("id"), F.col("total").alias("t"))
    # top: exclusive prefix of the single top-level group is identity
    excl = rows.select(F.col("id").alias("gid"), _each(names, lambda c: _identity()).alias("parent"))
    for loc in reversed(local):
        down = loc.join(excl, "gid").select("parent", F.explode("out").alias("e"))
        excl = down.select(F.col("e.id").alias("gid"), _each(
            names, lambda c: compose(F.col("parent")[c], F.col("e.ex")[c])).alias("parent"))
    out = df.join(excl.withColumnRenamed("gid", order).withColumnRenamed("parent", "_ex"), order)
    named = {c: "prefix" if isinstance(steps, str) else f"prefix_{c}" for c in names}
    return out.select(*df.columns, *[compose(F.col("_ex")[c], F.col(c)).alias(x) for c, x in named.items()])


def ordinal(df: DataFrame, order_cols: list[str], name: str = "_ordinal") -> DataFrame:
    """1-based position of each row in ``order_cols`` order (a total order), for any number of rows.

    The rows are range-partitioned once and written, with their partition
    number, to the shared ``spark.checkpoint.dir``; rows are numbered inside
    each partition, and the sizes of the partitions before (one row per
    partition) are added.  Both read the written rows, so they always agree.
    """
    from cloakline.session import cut_lineage

    ranged = cut_lineage(df.repartitionByRange(*order_cols).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(
        F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order_cols)))
    return numbered.join(before, "_part").select(*df.columns, (F.col("_before") + F.col("_nth")).cast("long").alias(name))
