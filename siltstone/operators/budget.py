"""Trimming a payload to a budget of tokens in stages; the first stage that fits is taken.

Stages: as it is; without sections of priority 3; without those of priority 2; without
documentation and globals; files from the end dropped until the rest fits. The length of the
JSON list of k >= 1 elements is the sum of the elements' sizes and 2k + 2, so the last stage
is a running sum, one pass for each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.running import GROUP_ROWS, running

SECTION_TOKENS = 50


def list_tokens(total: Column, n: Column) -> Column:
    """Tokens of the JSON list of n elements whose sizes sum up to total."""
    return F.floor(F.when(n > 0, total + 2 * n + 2).otherwise(2) / 4).cast("long")


def prefix(sized: DataFrame, by: Sequence[str], order: Sequence[str], size: str, budget: Column, sections: Column, group_rows: int = GROUP_ROWS) -> DataFrame:
    """sized with running_tokens and kept: the longest prefix that fits, sections' tokens included."""
    r = running(sized, by, order, size, group_rows)
    tokens = list_tokens(F.col("running_sum"), F.col("row_number")) + SECTION_TOKENS * sections
    return r.withColumn("running_tokens", tokens.cast("long")).withColumn("kept", F.col("running_tokens") <= budget).drop("row_number", "running_sum")


#: The least priority of the sections that each stage keeps.
PRIORITY = (3, 2, 1, 1, 1)


def trimmed(sized: DataFrame, by: Sequence[str], order: Sequence[str], sections: Sequence[tuple[str, int]], budget: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(by, order, payload, stage, sections_kept): the rows that each group keeps, by the first stage that fits.

    sized is that of compress.sized(); sections are (id, priority). From stage 3 on payloads are without documentation,
    at stage 4 a group keeps the longest prefix of its rows that fits, which may be none.
    """
    table = sized.sparkSession.createDataFrame([*sections] or [("", 0)], "id string, priority int").where("id <> ''")
    chosen = stages(sized, by, "json_size", "bare_size", table, F.lit(budget)).select(*by, "stage", "sections_kept")
    firsts = sum(p <= 1 for _, p in sections)
    chosen = chosen.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "stage", "sections_kept")
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    rows = prefix(sized, by, order, "bare_size", F.lit(budget), F.lit(firsts), group_rows).join(chosen, same)
    rows = rows.where("stage < 4 or kept").withColumn("payload", F.when(F.col("stage") < 3, F.to_json("payload")).otherwise(F.to_json("bare_payload")))
    return rows.select(*by, *order, "payload", "stage", "sections_kept")


def stages(sized: DataFrame, by: Sequence[str], size: str, bare_size: str, sections: DataFrame, budget: Column) -> DataFrame:
    """(by, n_files, tokens, bare_tokens, stage, sections_kept): the stage each group needs, from 0 to 4.

    sections (id, priority) is the small list of configured sections.
    """
    counts = sections.agg(*[F.count_if(F.col("priority") <= p).alias(f"s{p}") for p in (1, 2, 3)])
    n = F.count(F.lit(1))
    g = sized.groupBy(*by).agg(n.alias("n_files"), list_tokens(F.sum(size), n).alias("tokens"), list_tokens(F.sum(bare_size), n).alias("bare_tokens"))
    g = g.join(F.broadcast(counts))  # one row
    fits = [F.col(t) + SECTION_TOKENS * F.col(s) <= budget for t, s in (("tokens", "s3"), ("tokens", "s2"), ("tokens", "s1"), ("bare_tokens", "s1"))]
    stage = F.when(fits[0], 0).when(fits[1], 1).when(fits[2], 2).when(fits[3], 3).otherwise(4).cast("long")
    kept = F.when(fits[0], F.col("s3")).when(fits[1], F.col("s2")).otherwise(F.col("s1"))
    return g.select(*by, "n_files", "tokens", "bare_tokens", stage.alias("stage"), kept.cast("long").alias("sections_kept"))
