"""Differences of two keyed states of a collection, and what is measured on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CREATED, MODIFIED, DELETED, UNCHANGED, AFFECTED = "created", "modified", "deleted", "unchanged", "affected"
CHANGES = (CREATED, MODIFIED, DELETED)


def compare(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change_type, old_hash, new_hash, lines_before, lines_after, lines_delta), without unchanged rows.

    old and new have the keys, hash and lines, each key once. One full outer equi-join; an
    unreadable hash is "" and two of them are equal; null hashes count as "".
    """
    o = old.select(*keys, F.struct(F.coalesce("hash", F.lit("")).alias("h"), F.coalesce("lines", F.lit(0)).cast("long").alias("l")).alias("_o"))
    n = new.select(*keys, F.struct(F.coalesce("hash", F.lit("")).alias("h"), F.coalesce("lines", F.lit(0)).cast("long").alias("l")).alias("_n"))
    kind = F.when(F.col("_o").isNull(), CREATED).when(F.col("_n").isNull(), DELETED).when(F.col("_o.h") != F.col("_n.h"), MODIFIED)
    before, after = F.coalesce("_o.l", F.lit(0).cast("long")), F.coalesce("_n.l", F.lit(0).cast("long"))
    return o.join(n, list(keys), "full_outer").withColumn("change_type", kind).where("change_type is not null").select(
        *keys, "change_type", F.col("_o.h").alias("old_hash"), F.col("_n.h").alias("new_hash"), before.alias("lines_before"), after.alias("lines_after"), (after - before).alias("lines_delta")
    )


def magnitude() -> Column:
    """How large a change is, from 0 to 1: lines of a whole file by 200, a change's net lines by 100."""
    kind, one = F.col("change_type"), F.lit(1.0)
    return (
        F.when(kind == CREATED, F.least(one, F.col("lines_after") / 200.0))
        .when(kind == DELETED, F.least(one, F.col("lines_before") / 200.0))
        .when(kind == MODIFIED, F.least(one, F.abs("lines_delta") / 100.0))
        .otherwise(F.lit(0.0))
    )


def _added() -> Column:
    return F.when(F.col("change_type") == CREATED, F.col("lines_after")).when(F.col("change_type") == MODIFIED, F.greatest("lines_delta", F.lit(0))).otherwise(0)


def _removed() -> Column:
    return F.when(F.col("change_type") == DELETED, F.col("lines_before")).when(F.col("change_type") == MODIFIED, F.greatest(-F.col("lines_delta"), F.lit(0))).otherwise(0)


def totals(changes: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, files_created, files_modified, files_deleted, total_lines_added, total_lines_removed)."""
    return changes.groupBy(*by).agg(
        *[F.count_if(F.col("change_type") == k).alias(f"files_{k}") for k in CHANGES],
        F.sum(_added()).cast("long").alias("total_lines_added"),
        F.sum(_removed()).cast("long").alias("total_lines_removed"),
    )


def metrics(nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """The nine measures of changed and affected nodes, in one pass."""
    changed = F.col("change_type").isin(*CHANGES)
    return nodes.groupBy(*by).agg(
        F.count_if(changed).alias("files_changed"),
        F.count_if(F.col("change_type") == CREATED).alias("new_files_created"),
        F.count_if(F.col("change_type") == DELETED).alias("files_deleted"),
        F.sum(_added()).cast("long").alias("lines_added"),
        F.sum(_removed()).cast("long").alias("lines_removed"),
        F.sum(_added() - _removed()).cast("long").alias("net_lines"),
        F.count_if(F.col("change_type") == AFFECTED).alias("affected_nodes_count"),
        F.sum(magnitude()).alias("total_magnitude"),
        F.bool_or(F.col("change_type").isin(CREATED, DELETED)).alias("has_structural_changes"),
    )


def of_type(changes: DataFrame, *kinds: str) -> DataFrame:
    """The paths of changes of some kinds; all kinds if none is given."""
    return changes.where(F.col("change_type").isin(*(kinds or CHANGES)))


def total_changes(changes: DataFrame) -> int:
    return changes.where(F.col("change_type").isin(*CHANGES)).count()


def affected_paths(nodes: DataFrame) -> DataFrame:
    """The paths of a subgraph that changes reach without changing them; of_type() gives the changed ones."""
    return nodes.where(F.col("change_type") == AFFECTED)


def is_empty(changes: DataFrame) -> bool:
    return changes.isEmpty()
