"""Prompts and documents put together from rows; own wording throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone import __version__
from siltstone.config import Section

TEMPLATE_OF = {"trivial": "micro", "minor": "micro", "standard": "standard", "major": "standard", "refactor": "refactor"}
TEMPLATES = {
    "micro": "You keep the notes of a software project. The change is small: write short, exact notes on it and nothing else. Name files by their paths. Answer in markdown with one level-2 heading for each section.",
    "standard": "You document a software project from its compressed structure. Describe what is there, why it is so and how the parts work together. Name only files of the payload. Answer in markdown with one level-2 heading for each section.",
    "refactor": "You document a restructuring. Say what was moved, split, joined or removed, what replaces it and what stays compatible. Name old and new paths. Answer in markdown with one level-2 heading for each section.",
    "merge": "You join several states of a project's documentation into one document. Keep what still holds, prefer later states, and say what changed where it matters. Answer in markdown.",
}


def system_prompt(session_type: Column) -> Column:
    """The instructions of a class of session; standard for an unknown class."""
    out = None
    for k, t in TEMPLATE_OF.items():
        cond = session_type == k
        out = F.when(cond, TEMPLATES[t]) if out is None else out.when(cond, TEMPLATES[t])
    return out.otherwise(TEMPLATES["standard"])


def sections_directive(sections: Sequence[Section]) -> str:
    lines = [f"{i}. **{s.name}** (id: {s.id}, format: {s.format}{f', depth: {s.depth}' if s.depth else ''})" for i, s in enumerate(sections, 1)]
    return "\n".join(["Generate the following sections:", *lines])


def _list(title: str, intro: str, items: Column, mark: str, outro: str = "") -> Column:
    """A block of a list, null if the list is null or empty."""
    body = F.concat(F.lit(f"## {title}\n{intro}\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit(f"- {mark}"), x, F.lit(mark))), "\n"), F.lit(outro + "\n"))
    return F.when(F.size(items) > 0, body)


def generation_prompt(payloads: DataFrame, sections: Sequence[Section], project: Column, payload: Column, session_type: Column, highlights: Column | None = None, deferred: Column | None = None) -> DataFrame:
    """payloads with system_prompt and user_prompt; payload is JSON text, the lists may be null."""
    none = F.lit(None).cast("array<string>")
    parts = [
        F.concat(F.lit("# Project: "), project, F.lit("\n")),
        F.lit(sections_directive(sections) + "\n"),
        _list("Focus Areas", "Look at these files first:", none if highlights is None else highlights, "`"),
        _list("Previously Deferred Changes", "Small changes of earlier sessions:", none if deferred is None else deferred, "", "\nTake them into the notes."),
        F.concat(F.lit("## Project Structure\n```json\n"), payload, F.lit("\n```")),
    ]
    return payloads.withColumn("system_prompt", system_prompt(session_type)).withColumn("user_prompt", F.concat_ws("\n", *parts))


def payload_json(files: DataFrame, by: Sequence[str], order: Sequence[str], payload: str = "payload") -> DataFrame:
    """(by, n_files, payload): the payloads of each group, structs or JSON texts, as one JSON list, ordered.

    A prompt is one text, so a group must have been trimmed to its budget before.
    """
    text = F.col(payload) if files.schema[payload].dataType.typeName() == "string" else F.to_json(payload)
    item = F.struct(*order, text.alias("_j"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_j"]), ",\n")
    return files.groupBy(*by).agg(F.count("*").alias("n_files"), F.concat(F.lit("["), text, F.lit("]")).alias("payload"))


def merge_prompt(summaries: DataFrame, by: Sequence[str], order: Sequence[str], project: Column) -> DataFrame:
    """(by, system_prompt, user_prompt): one numbered block for each document; summaries has a JSON text summary."""
    item = F.struct(*order, F.col("summary").alias("_s"))
    blocks = F.transform(F.array_sort(F.collect_list(item)), lambda x, i: F.concat(F.lit("## Snapshot "), (i + 1).cast("string"), F.lit("\n```json\n"), x["_s"], F.lit("\n```\n")))
    g = summaries.groupBy(*by).agg(F.count("*").alias("_n"), F.array_join(blocks, "\n").alias("_b"))
    text = F.concat(F.lit("# Project: "), project, F.lit("\n\nMerge the following "), F.col("_n").cast("string"), F.lit(" documentation snapshots:\n\n"), F.col("_b"))
    return g.select(*by, F.lit(TEMPLATES["merge"]).alias("system_prompt"), text.alias("user_prompt"))


def formatted(sections: DataFrame, keys: Sequence[str], heads: DataFrame) -> DataFrame:
    """(keys, document): sections (keys, sec_ord, name, content) under a head and over a foot.

    heads has the keys, project, model, session_type, files_analyzed, input_tokens, output_tokens
    and saved_at; the clock is the caller's.
    """
    block = F.concat(F.lit("## "), F.col("name"), F.lit("\n\n"), F.col("content"), F.lit("\n"))
    body = sections.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sec_ord", block.alias("b")))), lambda x: x["b"]), "\n").alias("_body"))
    at = F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss")
    head = F.concat(
        F.lit("---\ngenerated: "), at, F.lit(" UTC\nsession_type: "), F.col("session_type"), F.lit("\nmodel: "), F.col("model"), F.lit("\nfiles_analyzed: "), F.col("files_analyzed").cast("string"),
        F.lit("\ntokens: "), F.col("input_tokens").cast("string"), F.lit("/"), F.col("output_tokens").cast("string"), F.lit("\n---\n\n# "), F.col("project"), F.lit("\n\n"),
    )
    return heads.join(body, list(keys)).select(*keys, F.concat(head, F.col("_body"), F.lit(f"\n---\n*siltstone {__version__}*\n")).alias("document"))


def formatted_merge(merged: DataFrame, keys: Sequence[str], model: str) -> DataFrame:
    """(keys, document) of merged (keys, project, content, n_docs, saved_at)."""
    head = F.concat(F.lit("---\nmerged: "), F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss"), F.lit(f" UTC\nmodel: {model}\ndocs_merged: "), F.col("n_docs").cast("string"), F.lit("\n---\n\n# "), F.col("project"), F.lit("\n\n"))
    return merged.select(*keys, F.concat(head, F.col("content"), F.lit("\n")).alias("document"))
