"""Checks of generated documents as rows of warnings: one plan for each rule, put together at the end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T

# Words of doubt, and endings of what is a path also without a slash.
HEDGING = ("might", "could", "possibly", "perhaps", "maybe", "unclear", "uncertain")
PATH_ENDINGS = (".py", ".js", ".ts", ".yaml", ".json")
LEAST_LENGTH, MOST_HEDGING = 50, 10


def _row(keys: Sequence[str], category: str, message: Column, severity: str = "warning") -> list:
    return [*keys, F.lit(category).alias("category"), message.alias("message"), F.lit(severity).alias("severity")]


def long_enough(text: Column) -> Column:
    return F.length(T.strip(F.coalesce(text, F.lit("")))) >= LEAST_LENGTH


def headings(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, heading): level-2 headings, lower-cased and stripped."""
    found = F.regexp_extract_all(F.col(text), F.lit(rf"(?md)^##{T.BLANK}+(.+)$"), F.lit(1))
    return docs.select(*keys, F.explode(found).alias("h")).select(*keys, F.lower(T.strip(F.col("h"))).alias("heading"))


def missing_sections(docs: DataFrame, keys: Sequence[str], expected: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, section): expected names that no heading contains and that contain no heading.

    The names are a short list of the configuration; each document is compared with it in one row.
    """
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(rf"(?md)^##{T.BLANK}+(.+)$"), F.lit(1)), lambda h: F.lower(T.strip(h)))
    names = F.array(*[F.lit(n) for n in expected])
    gone = F.filter(names, lambda n: ~F.exists(F.col("_h"), lambda h: h.contains(F.lower(F.trim(n))) | F.lower(F.trim(n)).contains(h)))
    return docs.select(*keys, F.coalesce(found, F.array().cast("array<string>")).alias("_h")).select(*keys, F.explode(gone).alias("section"))


def path_references(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, ord, ref, path, name): what stands in backticks, ends like a file and looks like a path.

    path has no leading dots and slashes, name is its last part.
    """
    refs = docs.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"`([^`]*\.[a-zA-Z]{1,4})`"), F.lit(1))).alias("ord", "ref"))
    ref = F.col("ref")
    is_path = ref.contains("/")
    for e in PATH_ENDINGS:
        is_path = is_path | ref.endswith(e)
    path = F.regexp_replace(ref, r"^[./]+", "")
    kept = refs.where(~ref.startswith("http") & ~ref.startswith("pip ") & ~ref.contains("=") & is_path)
    return kept.select(*keys, F.col("ord").cast("long").alias("ord"), "ref", path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("name"))


def unknown_paths(docs: DataFrame, keys: Sequence[str], known: DataFrame, scope: Sequence[str] = (), text: str = "text") -> DataFrame:
    """References to paths of no known file (scope, path), also not by the end of one.

    First the whole path by an anti-join. Then the last part: a known path that ends with it
    ends with it as a whole name or within its name, so all ends of known names are joined by
    equality, not compared.
    """
    refs = path_references(docs, [*keys, *[s for s in scope if s not in keys]], text)
    k = known.select(*scope, "path").distinct()
    left = refs.join(k, [*scope, "path"], "left_anti")
    base = F.element_at(F.split("path", "/"), -1)
    ends = k.select(*scope, base.alias("_n")).distinct().select(*scope, F.explode(F.transform(F.sequence(F.lit(1), F.length("_n")), lambda i: F.substring(F.col("_n"), i, F.length("_n")))).alias("name")).distinct()
    return left.join(ends, [*scope, "name"], "left_anti").where("name <> ''")


def warnings(docs: DataFrame, keys: Sequence[str], expected: Sequence[str], known: DataFrame | None = None, scope: Sequence[str] = (), text: str = "text", hedging: Sequence[str] = HEDGING) -> DataFrame:
    """(keys, category, message, severity): a text that is empty or too short gets one error and no other warning."""
    ok = long_enough(F.col(text))
    short = docs.where(~ok).select(*_row(keys, "format", F.lit("text is empty or too short"), "error"))
    full = docs.where(ok)
    out = short.unionByName(missing_sections(full, keys, expected, text).select(*_row(keys, "missing_section", F.concat(F.lit("no section "), F.col("section")))))
    if known is not None:
        out = out.unionByName(unknown_paths(full, keys, known, scope, text).select(*_row(keys, "hallucination", F.concat(F.lit("unknown path `"), F.col("ref"), F.lit("`")))))
    n = T.hedging_count(F.col(text), tuple(hedging))
    out = out.unionByName(full.where(n > MOST_HEDGING).select(*_row(keys, "hedging", F.concat(n.cast("string"), F.lit(" words of doubt")))))
    return out.unionByName(full.where(~F.col(text).rlike(r"(?md)^#")).select(*_row(keys, "format", F.lit("no heading"))))


def results(docs: DataFrame, keys: Sequence[str], warned: DataFrame) -> DataFrame:
    """(keys, is_valid, warnings, errors): a document is valid without errors."""
    w = warned.groupBy(*keys).agg(F.count("*").alias("warnings"), F.count_if(F.col("severity") == "error").alias("errors"))
    zero = F.lit(0).cast("long")
    j = docs.select(*keys).join(w, list(keys), "left").select(*keys, F.coalesce("warnings", zero).alias("warnings"), F.coalesce("errors", zero).alias("errors"))
    return j.withColumn("is_valid", F.col("errors") == 0)
