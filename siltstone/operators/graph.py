"""The graph of files that import files: edges, reachability, the part that a change touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.diff import AFFECTED, CREATED, UNCHANGED
from siltstone.session import new_table, written

#: Where a module may lie, in the order in which it is looked for.
ROOTS = ("", "src/", "lib/")


def candidates(imports: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """(keys, src, module, ord, dst): the files that a module may be, best first."""
    base = F.replace("module", F.lit("."), F.lit("/"))
    places = [F.concat(F.lit(r), base, F.lit(e)) for r in ROOTS for e in (".py", "/__init__.py")]
    return imports.where(F.col("module").isNotNull() & (F.col("module") != "")).select(*keys, "src", "module", F.posexplode(F.array(*places)).alias("ord", "dst"))


def resolved(imports: DataFrame, files: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """(keys, src, module, dst): each import leads to the first candidate that exists and isn't the file itself."""
    known = files.select(*keys, F.col("path").alias("dst")).distinct()
    found = candidates(imports, keys).where("dst <> src").join(known, [*keys, "dst"])
    return found.groupBy(*keys, "src", "module").agg(F.min_by("dst", "ord").alias("dst"))


def resolve(imports: DataFrame, files: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """Edges (keys, src, dst) of resolved()."""
    return resolved(imports, files, keys).select(*keys, "src", "dst").distinct()


def reverse(edges: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    return edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))


def adjacency(edges: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """(keys, src, neighbours): sorted; for reports, since one node may have very many."""
    return edges.groupBy(*keys, "src").agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def degrees(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """(keys, path, imports, imported_by), 0 where a node has no edge."""
    out = edges.groupBy(*keys, F.col("src").alias("path")).agg(F.count("*").alias("imports"))
    into = edges.groupBy(*keys, F.col("dst").alias("path")).agg(F.count("*").alias("imported_by"))
    j = nodes.select(*keys, "path").join(out, [*keys, "path"], "left").join(into, [*keys, "path"], "left")
    return j.select(*keys, "path", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("imports", "imported_by")])


def affected(edges: DataFrame, changed: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """(keys, path): what reaches a changed node along edges, without the changed nodes; cycles do no harm.

    Frontier by frontier, until one is empty: one join and one anti-join a round, both on the key of the node, in one
    job. Each round writes its frontier only, as a partition of a table in the shared folder, and reads those before
    it; nodes reached in an earlier round aren't joined again.
    """
    spark, node = edges.sparkSession, [*keys, "path"]
    back = written(edges.select(*keys, F.col("dst").alias("path"), F.col("src").alias("to")).distinct(), "edges")
    table = new_table(spark, "reached")
    schema = T.StructType(changed.select(*node).schema.fields)
    changed.select(*node).distinct().write.parquet(f"{table}/0")
    n = 0
    while True:
        rounds = [f"{table}/{i}" for i in range(n + 1)]
        reached = Observation()
        step = spark.read.schema(schema).parquet(rounds[-1]).join(back, node).select(*keys, F.col("to").alias("path")).distinct()
        step = step.join(spark.read.schema(schema).parquet(*rounds), node, "left_anti")
        n += 1
        step.observe(reached, F.count(F.lit(1)).alias("n")).write.parquet(f"{table}/{n}")
        if not reached.get["n"]:
            break
    # The changed nodes themselves are those of round 0.
    return spark.read.schema(schema).parquet(*[f"{table}/{i}" for i in range(1, n + 1)])


def mark(nodes: DataFrame, changes: DataFrame, keys: Sequence[str] = ("project",), include_deleted: bool = False) -> DataFrame:
    """Nodes (keys, path, lines) with their change: known paths are updated, created ones added, others dropped.

    A deleted file is no node of the new state and so is dropped; include_deleted keeps it.
    """
    node = [*keys, "path"]
    cols = ["change_type", "lines_before", "lines_after", "lines_delta"]
    n = nodes.select(*node, F.col("lines").cast("long").alias("_l"), F.lit(True).alias("_known"))
    j = n.join(changes.select(*node, *cols), node, "full_outer")
    keep = F.col("_known") | (F.col("change_type") == CREATED) | F.lit(include_deleted)
    return j.where(keep).select(
        *node,
        F.coalesce("change_type", F.lit(UNCHANGED)).alias("change_type"),
        F.coalesce("lines_before", "_l").alias("lines_before"),
        F.coalesce("lines_after", "_l").alias("lines_after"),
        F.coalesce("lines_delta", F.lit(0)).cast("long").alias("lines_delta"),
    )


def subgraph(nodes: DataFrame, edges: DataFrame, changes: DataFrame, keys: Sequence[str] = ("project",), include_deleted: bool = False) -> DataFrame:
    """The changed nodes and those affected by them; affected paths that are no node aren't in it."""
    node = [*keys, "path"]
    marked = mark(nodes, changes, keys, include_deleted)
    reached = affected(edges, changes, keys).withColumn("_hit", F.lit(True))
    j = marked.join(reached, node, "left")
    kind = F.when((F.col("change_type") == UNCHANGED) & F.col("_hit"), AFFECTED).otherwise(F.col("change_type"))
    return j.withColumn("change_type", kind).drop("_hit").where(F.col("change_type") != UNCHANGED)
