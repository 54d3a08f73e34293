"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import ship


def map_batches(df: DataFrame, f: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow whose function is made once for each task: f() gives the function of a batch."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = None
        for b in batches:
            if b.num_rows:
                g = g or f()
                yield g(b)

    return df.mapInArrow(run, schema)


def latest(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """One row for each key, the one with the latest time of delivery.

    A null time is the oldest; ties go to the larger row, so the result doesn't depend on order.
    A null key is no record. The texts travel once, in the partial aggregate of each partition.
    """
    order = F.struct(F.col(at), F.xxhash64(*columns), F.length(columns[0]))
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*columns), order).alias("_r"))
        .select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])
    )
