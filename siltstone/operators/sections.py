"""Sections of markdown documents, grouped over documents and joined by names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T

# Fixed values, in order: the first keyword that a heading contains gives its section.
KEYWORDS = (
    ("phase", "status"), ("execution", "status"), ("summary", "status"), ("architecture", "architecture"), ("structure", "architecture"), ("decision", "decisions"), ("rationale", "decisions"),
    ("component", "logic"), ("logic", "logic"), ("integration", "data_flow"), ("data flow", "data_flow"), ("flow", "data_flow"), ("edge case", "edge_cases"), ("error", "edge_cases"),
    ("interview", "interview"), ("learning", "interview"), ("debt", "debt"), ("technical debt", "debt"), ("reference", "commands"), ("quick reference", "commands"), ("command", "commands"),
)
#: A level-2 heading; its blanks may run over lines. (?d): only \n ends a line.
HEADING = rf"(?md)^##{T.BLANK}+.+$"
FRONT = r"(?sd)\A---\n.*?\n---\n"


def section_id(heading: Column) -> Column:
    low = F.lower(heading)
    out = F.when(low.contains(KEYWORDS[0][0]), KEYWORDS[0][1])
    for k, v in KEYWORDS[1:]:
        out = out.when(low.contains(k), v)
    return out


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, FRONT, "")


def _split(text: Column) -> Column:
    heads = F.regexp_extract_all(text, F.lit(f"({HEADING})"), F.lit(1))
    bodies = F.split(text, HEADING, -1)
    return F.arrays_zip(heads.alias("h"), F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))).alias("b"))


def _heading(h: Column) -> Column:
    return T.strip(F.regexp_replace(h, r"^[# ]+", ""))


def extract(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, sec_ord, heading, content, section_id): level-2 sections with a body, without what is above the first.

    sec_ord counts from 0 the headings of a document, also those without a body.
    """
    parts = docs.where(F.col(text).isNotNull()).select(*keys, F.posexplode(_split(without_front_matter(F.col(text)))).alias("sec_ord", "z"))
    out = parts.select(*keys, F.col("sec_ord").cast("long").alias("sec_ord"), _heading(F.col("z.h")).alias("heading"), T.strip(F.col("z.b")).alias("content"))
    return out.where(F.col("content") != "").withColumn("section_id", section_id(F.col("heading")))


def for_output(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, sec_ord, name, content): as extract(), but front matter and empty bodies stay; without any heading the text is one section."""
    one = F.array(F.struct(F.lit("Documentation").alias("h"), F.col(text).alias("b")))
    zipped = _split(F.col(text))
    parts = docs.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.when(F.size(zipped) > 0, zipped).when(T.strip(F.col(text)) != "", one)).alias("sec_ord", "z"))
    return parts.select(*keys, F.col("sec_ord").cast("long").alias("sec_ord"), _heading(F.col("z.h")).alias("name"), T.strip(F.col("z.b")).alias("content"))


def front_matter(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, session_type, generated): "standard" and "" where the front matter doesn't say."""
    front = F.regexp_extract(F.col(text), r"(?sd)\A---\n(.*?)\n---", 1)

    def value(name: str) -> Column:
        return T.strip(F.regexp_extract(front, rf"(?d){name}:\s*(.+)", 1))

    return docs.where(F.col(text).isNotNull()).select(*keys, F.coalesce(F.nullif(value("session_type"), F.lit("")), F.lit("standard")).alias("session_type"), value("generated").alias("generated"))


def group_key() -> Column:
    return F.coalesce("section_id", F.lower("heading"))


def groups(sections: DataFrame, by: Sequence[str] = ("project",)) -> DataFrame:
    """(by, group_key, n_versions, first_ord, latest_doc): groups in no order; first_ord orders them."""
    order = F.struct("doc_ord", "sec_ord")
    g = sections.withColumn("group_key", group_key()).groupBy(*by, "group_key")
    return g.agg(F.count("*").alias("n_versions"), F.min(order).alias("first_ord"), F.max_by("doc_id", order).alias("latest_doc"))


def summaries(sections: DataFrame, keys: Sequence[str] = ("doc_id",), limit: int = 500, words: int = 100) -> DataFrame:
    """(keys, heading, words, content): contents of more than 100 words cut to 500 characters."""
    n = T.word_count(F.col("content"))
    return sections.select(*keys, "sec_ord", "heading", n.alias("words"), F.when(n > words, F.substring("content", 1, limit)).otherwise(F.col("content")).alias("content"))


def get_section(sections: DataFrame, heading: str, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The first section of each document whose heading contains the words, or is contained in them."""
    low = heading.lower()
    hit = F.lower("heading").contains(low) | F.lit(low).contains(F.lower("heading"))
    return sections.where(hit).groupBy(*by).agg(F.min_by(F.struct("heading", "content", "sec_ord"), "sec_ord").alias("s")).select(*by, "s.*")
