"""Row numbers and running sums over ordered groups of any size.

A window puts a whole group into one task. Where a group has more than GROUP_ROWS rows, rows
are range-partitioned by group and order instead, so that large groups are split; numbers and
sums are taken within each part and moved by the totals of the parts before. Both ways give
the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import cut

GROUP_ROWS = 1_000_000


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """df with row_number (from 1) and, if a value is named, running_sum up to and with each row. The order must be total."""
    zero = F.lit(0).cast("long")
    v = F.coalesce(F.col(value).cast("long"), zero) if value else zero
    largest = df.groupBy(*by).count().agg(F.max("count").alias("n")).first()["n"] or 0
    if largest <= group_rows:
        w = Window.partitionBy(*by).orderBy(*order)
        out = df.withColumn("row_number", F.row_number().over(w).cast("long"))
        return out.withColumn("running_sum", F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0))) if value else out
    # The parts must stay as they are once made, so they are cut off from their making.
    parts = cut(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p", *by).orderBy(*order)
    local = parts.withColumn("_n", F.row_number().over(w).cast("long")).withColumn("_s", F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_p", *by).agg(F.count("*").alias("_c"), F.sum(v).alias("_t"))
    # A row for each part of each group: as many as groups and partitions together, at most.
    moved = totals.select("_p", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.coalesce(F.sum("_c").over(before), zero).alias("_on"), F.coalesce(F.sum("_t").over(before), zero).alias("_os"))
    same = [F.col("_p") == F.col("_q")] + [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    j = local.join(moved.withColumnRenamed("_p", "_q"), same)
    out = j.withColumn("row_number", F.col("_n") + F.col("_on"))
    if value:
        out = out.withColumn("running_sum", F.col("_s") + F.col("_os"))
    return out.select(*df.columns, "row_number", *(["running_sum"] if value else []))
