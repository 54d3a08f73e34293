"""The queries of this subpackage, by name, with the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, defects, docpairs, handwritten, lookalike, neardup, packing, syntax, truncation
from siltstone.session import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_pairs(table(spark, sf_dir, "sections")).toDF("section_a", "section_b")


# Every pair of sections by the exact counts of its words.
SQL["p1_found"] = r"""WITH s AS (SELECT section_key AS k, lower(concat_ws(chr(10), heading, content)) AS t FROM (SELECT *, row_number() OVER (PARTITION BY section_key ORDER BY loaded_at DESC NULLS LAST) AS r FROM sections WHERE section_key IS NOT NULL) WHERE r = 1),
w AS (SELECT k, unnest(regexp_extract_all(t, '[\p{L}\p{N}]+')) AS w FROM s), c AS (SELECT k, w, count(*) AS n FROM w GROUP BY 1, 2), z AS (SELECT k, sum(n) AS n FROM c GROUP BY 1),
p AS (SELECT a.k AS a, b.k AS b, sum(least(a.n, b.n)) AS same FROM c a JOIN c b ON a.w = b.w AND a.k < b.k GROUP BY 1, 2)
SELECT a AS section_a, b AS section_b FROM p JOIN z x ON x.k = a JOIN z y ON y.k = b WHERE same >= 0.75 * (x.n + y.n - same)"""


@query
def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_members(table(spark, sf_dir, "sections"))


SQL["p1_members"] = f"""WITH pr AS ({SQL["p1_found"]}), l AS (SELECT k, count(*) AS links FROM (SELECT section_a AS k FROM pr UNION ALL SELECT section_b FROM pr) GROUP BY 1),
t AS (SELECT section_key AS k, array_to_string(list_sort(regexp_extract_all(lower(concat_ws(chr(10), heading, content)), '[\\p{{L}}\\p{{N}}]+')), ' ') AS t FROM (SELECT *, row_number() OVER (PARTITION BY section_key ORDER BY loaded_at DESC NULLS LAST) AS r FROM sections WHERE section_key IS NOT NULL) WHERE r = 1),
c AS (SELECT k, min(k) OVER (PARTITION BY t) AS class, count(*) OVER (PARTITION BY t) AS copies FROM t WHERE t <> '')
SELECT c.k AS section_key, class, copies, links FROM c JOIN l ON l.k = c.k"""


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, sf_dir, "files"))


@query
def p2_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.measures(table(spark, sf_dir, "files"))


@query
def p2_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.ways(table(spark, sf_dir, "files"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.truncated(table(spark, sf_dir, "responses"))


@query
def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = table(spark, sf_dir, "responses")
    return truncation.rates(defects.truncated_ways(responses, table(spark, sf_dir, "model_configs")), responses, "response_id", "model")


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.documented(table(spark, sf_dir, "files"))


@query
def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.pairs(table(spark, sf_dir, "files"))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid(table(spark, sf_dir, "files"))


@query
def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.rates(table(spark, sf_dir, "files"))


@query
def p6_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of p6_found that another parser can check."""
    files = table(spark, sf_dir, "files").where(F.lower("extension") == ".json")
    return syntax.invalid(files)


SQL["p6_json"] = """SELECT file_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC NULLS LAST) AS r FROM files WHERE lower(extension) = '.json' AND file_id IS NOT NULL) WHERE r = 1 AND content IS NOT NULL AND NOT json_valid(ltrim(decode(content), chr(65279)))"""


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.broken_pairs(table(spark, sf_dir, "responses"))


@query
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


@query
def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts there are, and of how many the ids give the bytes back."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


SQL["p8_round_trip"] = "SELECT count(*) AS documents, count(*) AS same FROM documents"


@query
def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


@query
def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every document with a token has one place, or its parts in a row, and no container is over its capacity."""
    return packing.invariants(packing.packed_documents(table(spark, sf_dir, "documents")))


SQL["p9_invariants"] = "SELECT count(*) AS documents, count(*) FILTER (length(text) > 0) AS placed, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS overfull FROM documents"


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.look_alike_pairs(table(spark, sf_dir, "documents"))


@query
def p10_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.look_alike_members(table(spark, sf_dir, "documents"))


SQL["p10_found"] = lookalike.pairs_sql()
SQL["p10_members"] = lookalike.pairs_sql().split("\nSELECT a.doc_id")[0] + """, n AS (SELECT doc_id, form, min(doc_id) OVER (PARTITION BY form) AS class, count(*) OVER (PARTITION BY form) AS docs, count(*) OVER (PARTITION BY form, text) AS copies FROM d),
s AS (SELECT form, count(DISTINCT text) AS spellings FROM d GROUP BY 1)
SELECT doc_id, class, spellings, docs - copies AS links FROM n JOIN s ON s.form = n.form WHERE spellings > 1"""
