"""A total order over a table without a task that holds all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(rows: DataFrame, *order: str, ranges: int | None = None) -> DataFrame:
    """rows with `place`, from 0, in ascending order of numeric columns, nulls first.

    The first column's quantiles cut the table into ranges, each numbered by itself and moved up
    by the sizes of those before it. Rows that are equal in all columns are numbered in any order.
    """
    ranges = ranges or rows.sparkSession.sparkContext.defaultParallelism * 4
    cuts = sorted(set(rows.approxQuantile(order[0], [k / ranges for k in range(1, ranges)], 0.5 / ranges)))
    # as many literals as there are ranges
    bucket = F.when(F.col(order[0]).isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col(order[0]))))
    placed = rows.withColumn("_range", bucket)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy("_range").orderBy(*order)
    own = placed.withColumn("_own", F.row_number().over(inside) - 1)
    return own.join(F.broadcast(offsets), "_range").withColumn("place", (F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_own", "_before")
