"""Small forms of parsed files, for a payload of bounded size; built-in expressions but for one.

Absent fields are null and don't appear in JSON. Only the estimate of tokens runs in Python,
because it counts the characters of one certain JSON text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TP

from siltstone.functions import text as T


def signature(f: Column) -> Column:
    """[async ]def name(p: ann, q)[ -> ret]."""
    params = F.transform(f["parameters"], lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), F.nullif(p["annotation"], F.lit(""))), F.lit(""))))
    back = F.coalesce(F.concat(F.lit(" -> "), F.nullif(f["return_annotation"], F.lit(""))), F.lit(""))
    return F.concat(F.when(f["is_async"], "async ").otherwise(""), F.lit("def "), f["name"], F.lit("("), F.array_join(params, ", "), F.lit(")"), back)


def all_functions() -> Column:
    """Top-level functions, then the methods of all classes."""
    return F.concat("functions", F.flatten(F.transform("classes", lambda c: c["methods"])))


def function_count() -> Column:
    return F.size(all_functions()).cast("long")


def is_trivial() -> Column:
    return (F.size("functions") == 0) & (F.size("classes") == 0) & (F.col("total_lines") < 20)


def method_names(c: Column) -> Column:
    return F.transform(c["methods"], lambda m: m["name"])


def public_methods(c: Column) -> Column:
    return F.filter(method_names(c), lambda n: ~n.startswith("_"))


def _filled(a: Column) -> Column:
    return F.when(F.size(a) > 0, a)


def function(f: Column, verbose: bool = False) -> Column:
    params = F.transform(f["parameters"], lambda p: F.when(F.length(p["annotation"]) > 0, F.concat(p["name"], F.lit(": "), p["annotation"])).otherwise(p["name"]))
    fields = [
        f["name"].alias("name"),
        _filled(params).alias("params"),
        F.nullif(f["return_annotation"], F.lit("")).alias("returns"),
        F.when(f["is_async"], F.lit(True)).alias("async"),
        _filled(F.transform(f["decorators"], lambda d: d["name"])).alias("decorators"),
    ]
    if verbose:
        fields.append(F.when(F.length(f["docstring"]) > 0, T.first_line(f["docstring"])).alias("doc"))
    return F.struct(*fields, F.when(f["complexity_hint"] > 5, f["complexity_hint"]).alias("complexity"))


def klass(c: Column, verbose: bool = False) -> Column:
    def keeps(m: Column) -> Column:
        special = m["name"].startswith("__") & m["name"].endswith("__") & (m["name"] != "__init__")
        return ~special

    methods = c["methods"] if verbose else F.filter(c["methods"], keeps)
    fields = [
        c["name"].alias("name"),
        _filled(c["bases"]).alias("bases"),
        _filled(F.transform(c["decorators"], lambda d: d["name"])).alias("decorators"),
        _filled(c["class_variables"]).alias("vars"),
        _filled(F.transform(methods, lambda m: function(m, verbose))).alias("methods"),
    ]
    if verbose:
        fields.append(F.when(F.length(c["docstring"]) > 0, T.first_line(c["docstring"])).alias("doc"))
    return F.struct(*fields)


def files(parsed: DataFrame, keep: tuple[str, ...] = ("project",), verbose: bool = False, skip_trivial: bool = True) -> DataFrame:
    """(keep, path, payload): payload is a struct whose absent fields are null."""
    modules = F.array_distinct(F.filter(F.transform("imports", lambda i: i["module"]), lambda m: F.length(m) > 0))
    fields = [
        F.col("path"),
        F.col("language").alias("lang"),
        F.col("total_lines").alias("lines"),
        F.when(F.col("has_entry_point"), F.lit(True)).alias("entry_point"),
        _filled(modules).alias("imports"),
        _filled(F.transform("classes", lambda c: klass(c, verbose))).alias("classes"),
        _filled(F.transform("functions", lambda f: function(f, verbose))).alias("functions"),
    ]
    if verbose:
        fields += [_filled(F.col("global_variables")).alias("globals"), F.when(F.length("module_docstring") > 0, T.first_line(F.col("module_docstring"))).alias("module_doc")]
    out = parsed.where(~is_trivial()) if skip_trivial else parsed
    return out.select(*keep, "path", F.struct(*fields).alias("payload"))


#: Fields of documentation, which a tight budget leaves out.
DOCS = ("doc", "module_doc", "globals")


def bare(payload: Column, kind: TP.DataType) -> Column:
    """A payload of this type without its fields of documentation, at any depth."""
    if isinstance(kind, TP.StructType):
        parts = [bare(payload[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name not in DOCS]
        return F.when(payload.isNotNull(), F.struct(*parts))
    if isinstance(kind, TP.ArrayType):
        return F.transform(payload, lambda x: bare(x, kind.elementType))
    return payload


def sized(payloads: DataFrame) -> DataFrame:
    """payloads with json_size, bare_payload and bare_size."""
    kind = payloads.schema["payload"].dataType
    both = json_sizes(payloads).withColumn("bare_payload", bare(F.col("payload"), kind))
    has_docs = any(f'"{d}"' in kind.json() for d in DOCS)
    return json_sizes(both, "bare_payload", "bare_size") if has_docs else both.withColumn("bare_size", F.col("json_size"))


def _without_nulls(x: object) -> object:
    if isinstance(x, dict):
        return {k: _without_nulls(v) for k, v in x.items() if v is not None}
    return [_without_nulls(v) for v in x] if isinstance(x, list) else x


def json_sizes(payloads: DataFrame, column: str = "payload", name: str = "json_size") -> DataFrame:
    """payloads with a column, the characters of the indented ASCII JSON of one element of a list, indented by two."""

    @F.pandas_udf("long")
    def size(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in s:
            yield x.map(lambda t: sum(len(y) + 3 for y in json.dumps(json.loads(t), indent=2).split("\n")) - 1)

    return payloads.withColumn(name, size(F.to_json(column)))


def estimate_tokens(size: Column) -> Column:
    """Four characters a token."""
    return F.floor(size / 4).cast("long")
