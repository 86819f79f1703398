"""Running totals of very large groups without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(df: DataFrame, group: str, order: list[str], size: Column, buckets: int, name: str, ties: list[str] | None = None) -> DataFrame:
    """Add ``name``: the sum of ``size`` over the rows of the same ``group`` that come before, in a pseudorandom order.

    Rows are put in order by (hash bucket of ``order``, ``order``, ``ties``): rows that differ in ``ties`` only change places among themselves. A window runs only inside one bucket of one
    group; the bucket totals, ``buckets`` rows a group, are summed up apart and joined back. ``group`` must not be
    null. ``df`` is read twice and has to give the same rows each time.
    """
    cut = df.withColumn("_rt_bucket", F.pmod(F.xxhash64(*order, F.lit(17)), F.lit(buckets)).cast("int")).withColumn("_rt_size", size)
    inside = Window.partitionBy(group, "_rt_bucket").orderBy(*order, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(group).orderBy("_rt_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(group, "_rt_bucket").agg(F.sum("_rt_size").alias("_rt_all"))
    starts = totals.select(group, "_rt_bucket", F.coalesce(F.sum("_rt_all").over(over), F.lit(0)).alias("_rt_start"))
    return (
        cut.withColumn("_rt_before", F.coalesce(F.sum("_rt_size").over(inside), F.lit(0)))
        .join(starts, [group, "_rt_bucket"])
        .withColumn(name, (F.col("_rt_before") + F.col("_rt_start")).cast("long"))
        .drop("_rt_bucket", "_rt_size", "_rt_before", "_rt_start")
    )
