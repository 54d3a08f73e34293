"""Classes of change sets by ordered rules over their measures, and the budgets of each class."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Input and output tokens of each class, and the confidence of each rule.
BUDGETS = {"trivial": (0, 0), "minor": (500, 1500), "standard": (2000, 5000), "major": (4000, 8000), "refactor": (1500, 3000)}
CONFIDENCE = {"refactor": 0.85, "trivial": 0.90, "minor": 0.85, "standard": 0.85, "major": 0.80}


@dataclass(frozen=True)
class Limits:
    trivial_files: int = 2
    trivial_lines: int = 30
    minor_files: int = 5
    minor_lines: int = 150
    standard_files: int = 15
    standard_lines: int = 500
    refactor_files: int = 3
    refactor_net: int = 50


def classify(metrics: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """metrics with session_type, confidence, reason, both budgets and should_defer; the first rule that holds decides."""
    files, churn = F.col("files_changed"), F.col("lines_added") + F.col("lines_removed")
    text = F.format_string

    rules = [
        (
            "refactor",
            (F.col("files_deleted") > 0) & (F.col("new_files_created") > 0) & (F.abs("net_lines") < limits.refactor_net) & (files >= limits.refactor_files),
            text("%s deleted, %s created, %s net lines", "files_deleted", "new_files_created", "net_lines"),
        ),
        ("trivial", (files <= limits.trivial_files) & (churn <= limits.trivial_lines) & (F.col("new_files_created") == 0) & ~F.col("has_structural_changes"), None),
        ("minor", (files <= limits.minor_files) & (churn <= limits.minor_lines), None),
        ("standard", (files <= limits.standard_files) & (churn <= limits.standard_lines), None),
        ("major", F.lit(True), None),
    ]
    size = text("%s files, %s lines changed", files, churn)
    kind = conf = reason = None
    for name, holds, said in rules:
        said = F.concat(F.lit(f"{name}: "), size if said is None else said)
        if kind is None:
            kind, conf, reason = F.when(holds, name), F.when(holds, CONFIDENCE[name]), F.when(holds, said)
        else:
            kind, conf, reason = kind.when(holds, name), conf.when(holds, CONFIDENCE[name]), reason.when(holds, said)
    out = metrics.withColumns({"session_type": kind, "confidence": conf, "reason": reason})
    return with_budgets(out).withColumn("should_defer", F.col("session_type") == "trivial")


def classify_session(metrics: DataFrame, limits: Limits = Limits(), model: Callable[[DataFrame, Limits], DataFrame] | None = None) -> DataFrame:
    """The classes by a small model if one is given, which may itself end in the rules; else by the rules."""
    return (model or classify)(metrics, limits)


def with_budgets(df: DataFrame) -> DataFrame:
    """df with the budgets of its session_type; five rows, so the join is a broadcast."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(k, *v) for k, v in BUDGETS.items()], "session_type string, input_token_budget bigint, output_token_budget bigint")
    return df.join(F.broadcast(dim), "session_type", "left")


def or_standard(classified: DataFrame, keys: DataFrame, key: list[str], input_budget: int, output_budget: int) -> DataFrame:
    """One row for each key; those without changes are standard, with the configured budgets."""
    j = keys.select(*key).distinct().join(classified, key, "left")
    fill = {"session_type": "standard", "confidence": 1.0, "reason": "standard: first scan or forced", "input_token_budget": input_budget, "output_token_budget": output_budget, "should_defer": False}
    return j.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})
