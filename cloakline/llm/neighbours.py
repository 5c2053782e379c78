"""The next value of each value in ascending order, without one task seeing them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakline.llm.common import written


def previous(keys: DataFrame, key: str) -> DataFrame:
    """Distinct non-null ``key`` values with ``prev``: the next smaller one; the smallest has the largest (wrap).

    The values are range-partitioned and written with their partition number;
    the value before a partition's first is looked up among one row per partition.
    """
    ranged = written(keys.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "ranged")
    inner = Window.partitionBy("_part").orderBy(key)
    parts = ranged.groupBy("_part").agg(F.max(key).alias("_last"))  # one row per shuffle partition
    before = parts.select("_part", F.coalesce(
        F.lag("_last").over(Window.orderBy("_part")),
        F.max("_last").over(Window.partitionBy(F.lit(0)))).alias("_before"))
    return (ranged.select(key, "_part", F.lag(key).over(inner).alias("_in")).join(F.broadcast(before), "_part")
            .select(key, F.coalesce("_in", "_before").alias("prev")))
