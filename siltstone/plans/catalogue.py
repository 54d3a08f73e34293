"""The queries of the core, by name, with the SQL that gives the same rows.

The tables are those that the driver makes; where an operator needs something that they lack
(edges, imports), it is derived from them in the same way in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import config, model
from siltstone.functions import text as T
from siltstone.operators import budget, classify, compress, diff, graph, merge, merkle_diff, prompt, sections, structure, validate
from siltstone.session import table, written
from siltstone.sources import patterns, scan, store
from siltstone.streaming import deferral

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def latest(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """One row for each key, the one delivered last."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, *columns)).alias("_r")).select(key, "_r.*")


@query(merkle_diff.P4_SQL)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_diff.snapshot_changes(table(spark, sf_dir, "snapshot"), table(spark, sf_dir, "snapshots"))


# ---------------------------------------------------------------- snapshots

LIVE_SQL = r"""
f AS (SELECT snapshot_id, regexp_replace(replace(path, chr(92), '/'), '^(\./+)+', '') AS path, lower(coalesce(hash, '')) AS hash, size, lines, loaded_at FROM snapshot WHERE path IS NOT NULL),
live AS (SELECT snapshot_id, path, hash, size, lines FROM f QUALIFY row_number() OVER (PARTITION BY snapshot_id, path ORDER BY loaded_at DESC NULLS LAST, hash DESC, size DESC NULLS LAST, lines DESC NULLS LAST) = 1),
p AS (SELECT snapshot_id AS new_id, checkout_id, taken_at, lag(snapshot_id) OVER (PARTITION BY checkout_id ORDER BY taken_at NULLS FIRST, snapshot_id) AS old_id FROM snapshots),
n AS (SELECT p.new_id, live.* FROM p JOIN live ON live.snapshot_id = p.new_id WHERE old_id IS NOT NULL),
o AS (SELECT p.new_id, live.* FROM p JOIN live ON live.snapshot_id = p.old_id),
d AS (SELECT * FROM (SELECT coalesce(n.new_id, o.new_id) AS snapshot_id, coalesce(n.path, o.path) AS path,
    CASE WHEN o.path IS NULL THEN 'created' WHEN n.path IS NULL THEN 'deleted' WHEN n.hash <> o.hash THEN 'modified' END AS change_type,
    o.hash AS old_hash, n.hash AS new_hash, coalesce(o.lines, 0) AS lines_before, coalesce(n.lines, 0) AS lines_after, coalesce(n.lines, 0) - coalesce(o.lines, 0) AS lines_delta
  FROM n FULL OUTER JOIN o ON n.new_id = o.new_id AND n.path = o.path) WHERE change_type IS NOT NULL),
g AS (SELECT *, CASE change_type WHEN 'created' THEN least(1.0, lines_after / 200.0) WHEN 'deleted' THEN least(1.0, lines_before / 200.0) ELSE least(1.0, abs(lines_delta) / 100.0) END AS magnitude,
  CASE change_type WHEN 'created' THEN lines_after WHEN 'modified' THEN greatest(lines_delta, 0) ELSE 0 END AS plus,
  CASE change_type WHEN 'deleted' THEN lines_before WHEN 'modified' THEN greatest(-lines_delta, 0) ELSE 0 END AS minus FROM d),
m AS (SELECT snapshot_id, count(*) AS files_changed, count(*) FILTER (change_type = 'created') AS new_files_created, count(*) FILTER (change_type = 'deleted') AS files_deleted,
  CAST(sum(plus) AS BIGINT) AS lines_added, CAST(sum(minus) AS BIGINT) AS lines_removed, CAST(sum(plus - minus) AS BIGINT) AS net_lines, CAST(0 AS BIGINT) AS affected_nodes_count,
  sum(magnitude) AS total_magnitude, bool_or(change_type <> 'modified') AS has_structural_changes FROM g GROUP BY 1),
c AS (SELECT *, CASE WHEN files_deleted > 0 AND new_files_created > 0 AND abs(net_lines) < 50 AND files_changed >= 3 THEN 'refactor'
  WHEN files_changed <= 2 AND lines_added + lines_removed <= 30 AND new_files_created = 0 AND NOT has_structural_changes THEN 'trivial'
  WHEN files_changed <= 5 AND lines_added + lines_removed <= 150 THEN 'minor' WHEN files_changed <= 15 AND lines_added + lines_removed <= 500 THEN 'standard' ELSE 'major' END AS session_type FROM m)
"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each snapshot against the one before it, keyed by the newer."""
    pairs = merkle_diff.consecutive(table(spark, sf_dir, "snapshots"))
    live = merkle_diff.live_rows(table(spark, sf_dir, "snapshot"), 0).select("snapshot_id", "path", "hash", "lines")
    sides = live.join(pairs, "snapshot_id")
    new = sides.where("as_new is not null").select(F.col("as_new").alias("snapshot_id"), "path", "hash", "lines")
    old = sides.where("as_old is not null").select(F.col("as_old").alias("snapshot_id"), "path", "hash", "lines")
    return diff.compare(old, new, ["snapshot_id", "path"])


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.metrics(_changes(spark, sf_dir), ["snapshot_id"])


@query(f"WITH {LIVE_SQL} SELECT * FROM d")
def q01_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@query(f"""WITH {LIVE_SQL} SELECT snapshot_id, count(*) FILTER (change_type = 'created') AS files_created, count(*) FILTER (change_type = 'modified') AS files_modified,
  count(*) FILTER (change_type = 'deleted') AS files_deleted, CAST(sum(plus) AS BIGINT) AS total_lines_added, CAST(sum(minus) AS BIGINT) AS total_lines_removed FROM g GROUP BY 1""")
def q02_diff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.totals(_changes(spark, sf_dir), ["snapshot_id"])


@query(f"WITH {LIVE_SQL} SELECT snapshot_id, path, CAST(round(magnitude, 6) AS DOUBLE) AS magnitude FROM g")
def q03_change_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("snapshot_id", "path", F.round(diff.magnitude(), 6).alias("magnitude"))


@query(f"WITH {LIVE_SQL} SELECT * EXCLUDE (total_magnitude), CAST(round(total_magnitude, 4) AS DOUBLE) AS total_magnitude FROM m")
def q04_change_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).withColumn("total_magnitude", F.round("total_magnitude", 4))


_DIM = "(VALUES " + ", ".join(f"('{k}', {i}, {o}, {classify.CONFIDENCE[k]})" for k, (i, o) in classify.BUDGETS.items()) + ") AS b(session_type, i, o, conf)"


@query(f"""WITH {LIVE_SQL} SELECT snapshot_id, session_type, CAST(conf AS DOUBLE) AS confidence, CAST(i AS BIGINT) AS input_token_budget, CAST(o AS BIGINT) AS output_token_budget,
  session_type = 'trivial' AS should_defer FROM c JOIN {_DIM} USING (session_type)""")
def q05_classify_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classify.classify(_metrics(spark, sf_dir))
    return c.select("snapshot_id", "session_type", "confidence", "input_token_budget", "output_token_budget", "should_defer")


@query(f"WITH {LIVE_SQL} SELECT session_type, count(*) AS sessions, CAST(sum(i) AS BIGINT) AS input_tokens FROM c JOIN {_DIM} USING (session_type) GROUP BY 1")
def q06_session_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classify.classify(_metrics(spark, sf_dir))
    return c.groupBy("session_type").agg(F.count("*").alias("sessions"), F.sum("input_token_budget").alias("input_tokens"))


# ---------------------------------------------------------------- graph, over edges between documents

EDGES_SQL = """
e AS (SELECT DISTINCT a.doc_id AS src, b.doc_id AS dst FROM documents a JOIN documents b ON b.doc_id = a.doc_id // 2 WHERE a.doc_id <> b.doc_id
  UNION SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id * 3 + 1 WHERE a.lang IS NULL AND a.doc_id <> b.doc_id)
"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    dst = d.select(F.col("doc_id").alias("dst"))
    a = d.select(F.col("doc_id").alias("src"), F.expr("doc_id div 2").alias("dst"))
    b = d.where("lang is null").select(F.col("doc_id").alias("src"), F.expr("doc_id * 3 + 1").alias("dst"))
    return a.union(b).where("src <> dst").distinct().join(dst, "dst", "left_semi").select(F.lit("all").alias("project"), "src", "dst")


@query(f"WITH {EDGES_SQL} SELECT dst AS src, src AS dst FROM e")
def q07_reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reverse(_edges(spark, sf_dir)).select("src", "dst")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lit("all").alias("project"), F.col("doc_id").alias("path"), F.coalesce("n_chars", F.lit(0)).alias("lines"), "doc_kind")


@query(f"""WITH {EDGES_SQL} SELECT d.doc_id AS path, (SELECT count(*) FROM e WHERE e.src = d.doc_id) AS imports, (SELECT count(*) FROM e WHERE e.dst = d.doc_id) AS imported_by FROM documents d""")
def q07_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_nodes(spark, sf_dir), _edges(spark, sf_dir)).drop("project")


_PY = "(SELECT DISTINCT project, path FROM files WHERE extension = '.py' AND path LIKE '%.py')"


@query(f"""WITH py AS (SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY path) AS n FROM {_PY}),
i AS (SELECT a.project, a.path AS src, replace(regexp_replace(b.path, '^(src/|lib/)|\\.py$', '', 'g'), '/', '.') AS module FROM py a JOIN py b ON a.project = b.project AND b.n IN (a.n, a.n + 1)),
k AS (SELECT DISTINCT project, src, module, o, p || replace(module, '.', '/') || s AS dst FROM i,
  (VALUES (0, '', '.py'), (1, '', '/__init__.py'), (2, 'src/', '.py'), (3, 'src/', '/__init__.py'), (4, 'lib/', '.py'), (5, 'lib/', '/__init__.py')) AS r(o, p, s))
SELECT DISTINCT project, src, dst FROM (SELECT project, src, module, arg_min(dst, o) AS dst FROM k JOIN (SELECT DISTINCT project, path FROM files) f USING (project)
  WHERE f.path = k.dst AND k.dst <> src GROUP BY 1, 2, 3)""")
def q08_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports are derived: each Python file names itself and the next one of its project."""
    from pyspark.sql import Window

    files = table(spark, sf_dir, "files").select("project", "path", "extension")
    py = files.where("extension = '.py' and path like '%.py'").select("project", "path").distinct()
    name = F.replace(F.regexp_replace("path", r"^(src/|lib/)|\.py$", ""), F.lit("/"), F.lit("."))
    w = Window.partitionBy("project").orderBy("path")
    modules = py.select("project", F.col("path").alias("src"), F.array(name, F.lead(name).over(w)).alias("m"))
    return graph.resolve(modules.select("project", "src", F.explode("m").alias("module")), files)


_SEED = "doc_kind = 'decision_record'"


@query(f"""WITH RECURSIVE {EDGES_SQL}, r AS (SELECT doc_id AS path FROM documents WHERE {_SEED} UNION SELECT e.src FROM r JOIN e ON e.dst = r.path)
SELECT path FROM r WHERE path NOT IN (SELECT doc_id FROM documents WHERE {_SEED})""")
def q09_affected_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _nodes(spark, sf_dir).where("doc_kind = 'decision_record'")
    return graph.affected(_edges(spark, sf_dir), seeds).select("path")


@query(f"""WITH RECURSIVE {EDGES_SQL}, ch AS (SELECT doc_id AS path, 'modified' AS change_type FROM documents WHERE {_SEED} UNION ALL SELECT doc_id + 1000000000, 'created' FROM documents WHERE doc_kind = 'readme'),
r AS (SELECT path FROM ch UNION SELECT e.src FROM r JOIN e ON e.dst = r.path)
SELECT path, change_type FROM ch UNION ALL SELECT path, 'affected' FROM r WHERE path NOT IN (SELECT path FROM ch)""")
def q10_change_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modified documents, created ones with new keys, and deleted ones that are no node and so are left out."""
    nodes = _nodes(spark, sf_dir)
    zero = F.lit(0).cast("long")

    def change(rows: DataFrame, kind: str, shift: int) -> DataFrame:
        return rows.select("project", (F.col("path") + shift).alias("path"), F.lit(kind).alias("change_type"), zero.alias("lines_before"), zero.alias("lines_after"), zero.alias("lines_delta"))

    changes = change(nodes.where("doc_kind = 'decision_record'"), "modified", 0).union(change(nodes.where("doc_kind = 'readme'"), "created", 10**9)).union(change(nodes.where("doc_kind = 'review'"), "deleted", 2 * 10**9))
    return graph.subgraph(nodes, _edges(spark, sf_dir), changes).select("path", "change_type")


# ---------------------------------------------------------------- sections and merging

_B = T.BLANK
_STRIP = f"regexp_replace(%s, '^{_B}+|{_B}+$', '', 'g')"
_ID = "CASE " + " ".join(f"WHEN contains(lower(heading), '{k}') THEN '{v}'" for k, v in sections.KEYWORDS) + " END"
SECTIONS_SQL = f"""
t AS (SELECT doc_id, regexp_replace(text, '(?s)\\A---\\n.*?\\n---\\n', '') AS t FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, regexp_extract_all(t, '(?m)(^##{_B}+.+$)', 1) AS hs, regexp_split_to_array(t, '(?m)^##{_B}+.+$') AS bs FROM t),
u AS (SELECT doc_id, i - 1 AS sec_ord, hs[i] AS h, bs[i + 1] AS b FROM (SELECT doc_id, hs, bs, unnest(range(1, len(hs) + 1)) AS i FROM h)),
s AS (SELECT doc_id, sec_ord, {_STRIP % "regexp_replace(h, '^[# ]+', '')"} AS heading, {_STRIP % "b"} AS content FROM u),
x AS (SELECT *, {_ID} AS section_id FROM s WHERE content <> '')
"""


@query(f"WITH {SECTIONS_SQL} SELECT doc_id, CAST(sec_ord AS BIGINT) AS sec_ord, heading, content, section_id FROM x")
def q11_extract_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.extract(table(spark, sf_dir, "documents"), ["doc_id"])


@query(f"WITH {SECTIONS_SQL} SELECT section_id, count(*) AS n, count(DISTINCT heading) AS headings FROM x GROUP BY 1")
def q12_section_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.extract(table(spark, sf_dir, "documents"), ["doc_id"]).groupBy("section_id").agg(F.count("*").alias("n"), F.count_distinct("heading").alias("headings"))


_SEC_SQL = """sec AS (SELECT * FROM sections QUALIFY row_number() OVER (PARTITION BY section_key ORDER BY loaded_at DESC) = 1),
k AS (SELECT *, coalesce(section_id, lower(heading)) AS group_key, row_number() OVER (PARTITION BY project, coalesce(section_id, lower(heading)) ORDER BY doc_ord, sec_ord) AS v,
  count(*) OVER (PARTITION BY project, coalesce(section_id, lower(heading))) AS nv FROM sec)"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "sections"), "section_key", "loaded_at", ["project", "doc_ord", "sec_ord", "doc_id", "heading", "content", "section_id"])


@query(f"""WITH {_SEC_SQL} SELECT project, group_key, count(*) AS n_versions, min(doc_ord) FILTER (v = 1) AS first_doc, min(sec_ord) FILTER (v = 1) AS first_sec, min(doc_id) FILTER (v = nv) AS latest_doc
FROM k GROUP BY 1, 2""")
def q13_group_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sections.groups(_sections(spark, sf_dir))
    return g.select("project", "group_key", "n_versions", F.col("first_ord.doc_ord").alias("first_doc"), F.col("first_ord.sec_ord").alias("first_sec"), "latest_doc")


_WORDS = f"len(list_filter(regexp_split_to_array(content, '{_B}+'), lambda x: x <> ''))"


@query(f"WITH {_SEC_SQL} SELECT section_key, heading, {_WORDS} AS words, CASE WHEN {_WORDS} > 100 THEN substring(content, 1, 500) ELSE content END AS content FROM sec")
def q14_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.summaries(_sections(spark, sf_dir), ["section_key"]).drop("sec_ord")


_NAMES = [s.name for s in config.SECTIONS]
_EXPECTED = "(VALUES " + ", ".join(f"('{n}')" for n in _NAMES) + ") AS w(section)"
_HEADS = f"hd AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '(?m)^##{_B}+(.+)$', 1), lambda x: lower({_STRIP % 'x'})) AS hs FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_HEADS} SELECT doc_id, section FROM hd, {_EXPECTED} WHERE len(list_filter(hs, lambda x: contains(x, lower(section)) OR contains(lower(section), x))) = 0")
def q15_missing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.missing_sections(table(spark, sf_dir, "documents").where("text is not null"), ["doc_id"], _NAMES)


@query("""WITH r AS (SELECT doc_id, i - 1 AS ord, refs[i] AS ref FROM (SELECT doc_id, refs, unnest(range(1, len(refs) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '`([^`]*\\.[a-zA-Z]{1,4})`', 1) AS refs FROM documents WHERE text IS NOT NULL))),
q AS (SELECT *, regexp_replace(ref, '^[./]+', '') AS path FROM r WHERE NOT starts_with(ref, 'http') AND NOT starts_with(ref, 'pip ') AND NOT contains(ref, '=')
  AND (contains(ref, '/') OR ref LIKE '%.py' OR ref LIKE '%.js' OR ref LIKE '%.ts' OR ref LIKE '%.yaml' OR ref LIKE '%.json')),
w AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM q WHERE path NOT IN (SELECT path FROM files)),
names AS (SELECT DISTINCT w.name FROM w JOIN (SELECT DISTINCT path AS p FROM files) f ON ends_with(f.p, w.name))
SELECT doc_id, ord, ref, path, name FROM w WHERE name NOT IN (SELECT name FROM names) AND name <> ''""")
def q16_unknown_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.unknown_paths(table(spark, sf_dir, "documents"), ["doc_id"], table(spark, sf_dir, "files").select("path"))


#: Frequent words of the documents, since those of doubt are rare there.
_DOUBT = ("unless", "who", "open", "maybe", "the", "of", "der", "und", "la")


def _count_sql(words: tuple[str, ...]) -> str:
    return f"len(regexp_extract_all(text, '(?i)\\b({'|'.join(words)})\\b'))"


@query(f"SELECT doc_id, {_count_sql(validate.HEDGING)} AS hedges, {_count_sql(_DOUBT)} AS frequent FROM documents WHERE text IS NOT NULL")
def q17_hedging_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", T.hedging_count(F.col("text"), validate.HEDGING).alias("hedges"), T.hedging_count(F.col("text"), _DOUBT).alias("frequent"))


@query(f"""WITH {_HEADS}, a AS (SELECT d.doc_id, length({_STRIP % "coalesce(d.text, '')"}) < 50 AS short, hs, d.text FROM documents d LEFT JOIN hd ON hd.doc_id = d.doc_id),
m AS (SELECT a.*, CASE WHEN short THEN 1 ELSE (SELECT count(*) FROM {_EXPECTED} WHERE len(list_filter(a.hs, lambda x: contains(x, lower(section)) OR contains(lower(section), x))) = 0)
  + CASE WHEN regexp_matches(text, '(?m)^#') THEN 0 ELSE 1 END + CASE WHEN {_count_sql(_DOUBT)} > 10 THEN 1 ELSE 0 END + coalesce(u.n, 0) END AS w FROM a LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({SQL["q16_unknown_paths"]}) GROUP BY 1) u ON u.doc_id = a.doc_id)
SELECT doc_id, CAST(w AS BIGINT) AS warnings, CAST(CASE WHEN short THEN 1 ELSE 0 END AS BIGINT) AS errors, NOT short AS is_valid FROM m""")
def q18_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = validate.warnings(docs, ["doc_id"], _NAMES, table(spark, sf_dir, "files").select("path"), hedging=_DOUBT)
    return validate.results(docs, ["doc_id"], found)


@query("SELECT source, CAST(sum(coalesce(length(text), 0) // 4) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def q19_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(compress.estimate_tokens(F.coalesce(F.length("text"), F.lit(0)))).alias("tokens"))


@query("""SELECT source, doc_id, running_tokens, running_tokens <= 2000 AS kept FROM (SELECT source, doc_id,
  CAST((sum(coalesce(length(text), 0)) OVER w + 2 * count(*) OVER w + 2) // 4 + 450 AS BIGINT) AS running_tokens FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))""")
def q20_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    return budget.prefix(d, ["source"], ["doc_id"], "n", F.lit(2000), F.lit(9)).drop("n")


_PRIORITIES = "(VALUES " + ", ".join(f"({s.priority})" for s in config.SECTIONS) + ") AS s(p)"


@query(f"""WITH g AS (SELECT doc_kind, lang, count(*) AS n_files, (sum(coalesce(length(text), 0)) + 2 * count(*) + 2) // 4 AS tokens, (sum(coalesce(length(text), 0) // 2) + 2 * count(*) + 2) // 4 AS bare_tokens FROM documents GROUP BY 1, 2),
c AS (SELECT count(*) FILTER (p <= 1) * 50 AS s1, count(*) FILTER (p <= 2) * 50 AS s2, count(*) * 50 AS s3 FROM {_PRIORITIES}),
b AS (SELECT *, CASE WHEN tokens + s3 <= 3000 THEN 0 WHEN tokens + s2 <= 3000 THEN 1 WHEN tokens + s1 <= 3000 THEN 2 WHEN bare_tokens + s1 <= 3000 THEN 3 ELSE 4 END AS stage FROM g, c)
SELECT doc_kind, lang, n_files, CAST(tokens AS BIGINT) AS tokens, CAST(bare_tokens AS BIGINT) AS bare_tokens, CAST(stage AS BIGINT) AS stage, CAST(CASE stage WHEN 0 THEN s3 WHEN 1 THEN s2 ELSE s1 END // 50 AS BIGINT) AS sections_kept FROM b""")
def q21_budget_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    d = table(spark, sf_dir, "documents").select("doc_kind", "lang", n.alias("n"), F.expr("coalesce(length(text), 0) div 2").alias("bare"))
    dim = spark.createDataFrame([(s.id, s.priority) for s in config.SECTIONS], "id string, priority int")
    return budget.stages(d, ["doc_kind", "lang"], "n", "bare", dim, F.lit(3000))


@query(f"""WITH d AS (SELECT doc_kind, lang, source, doc_id, coalesce(length(text), 0) AS n, coalesce(length(text), 0) // 2 AS b FROM documents),
c AS (SELECT count(*) FILTER (p <= 1) * 50 AS s1, count(*) FILTER (p <= 2) * 50 AS s2, count(*) * 50 AS s3 FROM {_PRIORITIES}),
g AS (SELECT doc_kind, lang, source, (sum(n) + 2 * count(*) + 2) // 4 AS t, (sum(b) + 2 * count(*) + 2) // 4 AS bt FROM d GROUP BY 1, 2, 3),
s AS (SELECT *, CASE WHEN t + s3 <= 2000 THEN 0 WHEN t + s2 <= 2000 THEN 1 WHEN t + s1 <= 2000 THEN 2 WHEN bt + s1 <= 2000 THEN 3 ELSE 4 END AS stage FROM g, c),
r AS (SELECT *, (sum(b) OVER w + 2 * count(*) OVER w + 2) // 4 AS run FROM d WINDOW w AS (PARTITION BY doc_kind, lang, source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT r.doc_kind, r.lang, r.source, doc_id, CAST(stage AS BIGINT) AS stage, CAST(CASE stage WHEN 0 THEN s3 WHEN 1 THEN s2 ELSE s1 END // 50 AS BIGINT) AS sections_kept,
  CASE WHEN stage < 3 THEN '{{"doc_id":' || doc_id || ',"n":' || n || '}}' ELSE '{{"doc_id":' || doc_id || '}}' END AS payload
FROM r JOIN s ON r.doc_kind IS NOT DISTINCT FROM s.doc_kind AND r.lang IS NOT DISTINCT FROM s.lang AND r.source IS NOT DISTINCT FROM s.source WHERE stage < 4 OR run + s1 <= 2000""")
def q40_trimmed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each group of documents keeps of a budget, after all stages."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    d = table(spark, sf_dir, "documents").select("doc_kind", "lang", "source", "doc_id", n.alias("json_size"), F.expr("coalesce(length(text), 0) div 2").alias("bare_size"), F.struct("doc_id", n.alias("n")).alias("payload"), F.struct("doc_id").alias("bare_payload"))
    return budget.trimmed(d, ["doc_kind", "lang", "source"], ["doc_id"], [(s.id, s.priority) for s in config.SECTIONS], 2000)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"""SELECT project, {_quoted(prompt.TEMPLATES["standard"])} AS system_prompt, '# Project: ' || project || chr(10) || chr(10) || {_quoted(prompt.sections_directive(config.SECTIONS))} || chr(10) || chr(10)
  || '## Project Structure' || chr(10) || '```json' || chr(10) || '[' || string_agg('"' || path || '"', ',' ORDER BY path) || ']' || chr(10) || '```' AS user_prompt
FROM (SELECT DISTINCT project, path FROM parsed) GROUP BY project""")
def q22_prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "parsed").select("project", "path").distinct()
    payload = names.groupBy("project").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list("path")), lambda p: F.concat(F.lit('"'), p, F.lit('"'))), ","), F.lit("]")).alias("payload"))
    return prompt.generation_prompt(payload, config.SECTIONS, F.col("project"), F.col("payload"), F.lit("standard")).drop("payload")


@query("SELECT substr(sha256(text), 1, 16) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1")
def q23_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.content_hash16(F.col("text")).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


_MERGE_SQL = f"""{_SEC_SQL}, l AS (SELECT *, last_value(content) OVER w AS lc, last_value(heading) OVER w AS lh, row_number() OVER (PARTITION BY project, group_key, content ORDER BY v DESC) AS back
  FROM k WINDOW w AS (PARTITION BY project, group_key ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
mg AS (SELECT project, group_key, nv, min(lh) AS heading, CASE WHEN bool_and(content = lc) THEN 'latest' ELSE 'accumulated' END AS strategy, min(doc_ord) FILTER (v = 1) AS fd, min(sec_ord) FILTER (v = 1) AS fs,
  min(lc) AS lc, string_agg('*[' || doc_id || ']*' || chr(10) || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY v) FILTER (back = 1) AS parts FROM l GROUP BY 1, 2, 3)"""


@query(f"WITH {_MERGE_SQL} SELECT project, group_key, heading, strategy, nv AS n_versions, md5(CASE strategy WHEN 'latest' THEN lc ELSE parts END) AS content_md5 FROM mg")
def q25_merge_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merge.merged(_sections(spark, sf_dir), threshold=None)
    return m.select("project", "group_key", "heading", "strategy", "n_versions", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"""WITH {_MERGE_SQL}, dn AS (SELECT project, count(DISTINCT doc_id) AS n FROM sec GROUP BY 1)
SELECT project, md5('# Project Documentation (Merged from ' || min(n) || ' snapshots)' || chr(10) || chr(10) || string_agg('## ' || heading || chr(10) || chr(10) || CASE strategy WHEN 'latest' THEN lc ELSE parts END || chr(10), chr(10) ORDER BY fd, fs)) AS document_md5
FROM mg JOIN dn USING (project) GROUP BY project""")
def q26_merged_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merged_document(_sections(spark, sf_dir), threshold=None).select("project", F.md5(F.col("document").cast("binary")).alias("document_md5"))


@query()
def q24_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different texts of a group that are similar: the first place of the earlier one and the last place of the later one."""
    pairs = merge.similar_pairs(written(merge.versions(_sections(spark, sf_dir), ["project"]), "versions"), ["project", "group_key"])
    return pairs.select("project", "group_key", F.col("first1.doc_ord").alias("doc_a"), F.col("first1.sec_ord").alias("sec_a"), F.col("last2.doc_ord").alias("doc_b"), F.col("last2.sec_ord").alias("sec_b"), "similarity")


@query()
def q25_fuzzy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As q25_merge_strategy, but versions over the threshold of similarity are alike, too."""
    m = merge.merged(_sections(spark, sf_dir))
    return m.select("project", "group_key", "heading", "strategy", "n_versions", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query()
def q26_fuzzy_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As q26_merged_document, but versions over the threshold of similarity are alike, too."""
    return merge.merged_document(_sections(spark, sf_dir)).select("project", F.md5(F.col("document").cast("binary")).alias("document_md5"))


# ---------------------------------------------------------------- structure of files


def _parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files")
    lang = F.coalesce("language", T.language(F.col("path")))
    return structure.parse(files.withColumn("language", lang), ("file_id", "scanned_at", "project", "path"))


@query()
def q27_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of every file, by the parser of its language; rows once for each delivery that differs."""
    p = _parsed_files(spark, sf_dir).select("file_id", "language", F.explode(compress.all_functions()).alias("f"))
    return p.select("file_id", "language", "f.name", "f.line_start", "f.is_method", compress.signature(F.col("f")).alias("signature"), "f.complexity_hint").distinct()


@query(r"""WITH f AS (SELECT DISTINCT file_id, lower(extension) AS e, decode(content) AS t FROM files WHERE content IS NOT NULL AND lower(extension) IN ('.go', '.rs')),
l AS (SELECT file_id, e, unnest(string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS x, generate_subscripts(string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS n FROM f),
m AS (SELECT file_id, CASE e WHEN '.go' THEN 'go' ELSE 'rust' END AS language, n, regexp_extract(x, CASE e WHEN '.go' THEN '^func\s+(?:\([^()]*\)\s*)?(\w+)\s*\(' ELSE '^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?fn\s+(\w+)\s*[(<]' END, 1) AS name FROM l)
SELECT DISTINCT file_id, language, name, CAST(n AS BIGINT) AS line_start FROM m WHERE name <> ''""")
def q27_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of Go and Rust files, as the reader of declarations finds them."""
    files = table(spark, sf_dir, "files").where(F.lower("extension").isin(".go", ".rs"))
    p = structure.parse(files.withColumn("language", T.language(F.col("path"))), ("file_id",))
    return p.select("file_id", "language", F.explode("functions").alias("f")).select("file_id", "language", "f.name", "f.line_start").distinct()


@query()
def q28_python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.imports(_parsed_files(spark, sf_dir), ("project",)).distinct()


_LANG = "CASE regexp_extract(lower(path), '[^/](\\.[^./]+)$', 1) " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in T.LANGUAGE_OF.items()) + " END"


@query("""WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY parsed_at DESC NULLS LAST, path DESC) AS r FROM parsed) WHERE r = 1),
i AS (SELECT DISTINCT project, path AS src, unnest(imports).module AS module FROM p),
c AS (SELECT project, src, module, o, root || replace(module, '.', '/') || e AS dst FROM i, (VALUES (0, '', '.py'), (1, '', '/__init__.py'), (2, 'src/', '.py'), (3, 'src/', '/__init__.py'), (4, 'lib/', '.py'), (5, 'lib/', '/__init__.py')) AS v(o, root, e) WHERE module <> ''),
e AS (SELECT project, src, module, dst FROM (SELECT c.*, row_number() OVER (PARTITION BY c.project, src, module ORDER BY o) AS r FROM c JOIN (SELECT DISTINCT project, path FROM files) f ON f.project = c.project AND f.path = c.dst WHERE dst <> src) WHERE r = 1)
SELECT i.project, i.module, count(*) AS importers, count(e.dst) AS resolved FROM i LEFT JOIN e ON e.project = i.project AND e.src = i.src AND e.module = i.module WHERE i.module <> '' GROUP BY 1, 2""")
def q41_parsed_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files that the project's parser read import, and how many of the imports lead to a scanned file."""
    own = latest(table(spark, sf_dir, "parsed"), "file_id", "parsed_at", ["path", "project", "imports"])
    named = own.select("project", F.col("path").alias("src"), F.explode("imports").alias("i")).select("project", "src", "i.module").distinct()
    edges = graph.resolved(named, table(spark, sf_dir, "files"))
    return named.where("module <> ''").join(edges, ["project", "src", "module"], "left").groupBy("project", "module").agg(F.count("*").alias("importers"), F.count("dst").alias("resolved"))


@query(f"SELECT project, {_LANG} AS language, count(DISTINCT path) AS files FROM files WHERE {_LANG} IS NOT NULL GROUP BY 1, 2")
def q29_language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").select("project", "path").distinct().withColumn("language", T.language(F.col("path")))
    return scan.language_counts(f)


@query("""WITH f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC, lines DESC) = 1)
SELECT project, count(*) AS total_files, CAST(sum(lines) AS BIGINT) AS total_lines FROM f GROUP BY 1""")
def q29_manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.totals(latest(table(spark, sf_dir, "files"), "file_id", "scanned_at", ["lines", "project"]))


@query("SELECT DISTINCT file_id, coalesce(sha256(content), '') AS hash, coalesce(octet_length(content), 0) AS size FROM files")
def q29_file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files")
    return f.select("file_id", T.sha256(F.col("content")).alias("hash"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size")).distinct()


@query("""SELECT project, snapshot_id, n AS doc_ord, printf('pd_%03d', n) AS doc_id, CASE WHEN n > 1 THEN 'stale' ELSE 'pending' END AS merge_state
FROM (SELECT project, snapshot_id, row_number() OVER (PARTITION BY project ORDER BY taken_at, snapshot_id) AS n FROM snapshots)""")
def q30_doc_ids_and_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.numbered(table(spark, sf_dir, "snapshots").select("project", "snapshot_id", "taken_at"), ["taken_at", "snapshot_id"]).drop("taken_at")


@query("SELECT checkout_id, arg_max(snapshot_id, taken_at) AS snapshot_id FROM snapshots GROUP BY 1")
def q31_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "snapshots").groupBy("checkout_id").agg(F.max_by("snapshot_id", "taken_at").alias("snapshot_id"))


_FOLD = """ses AS (SELECT checkout_id, m.snapshot_id, CAST(round(total_magnitude, 4) AS DOUBLE) AS mag, row_number() OVER (PARTITION BY checkout_id ORDER BY p.taken_at, m.snapshot_id) AS i FROM m JOIN p ON p.new_id = m.snapshot_id),
fo AS (SELECT checkout_id, snapshot_id, i, mag, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS n, mag AS acc, mag >= 0.4 AS flushed FROM ses WHERE i = 1
  UNION ALL SELECT s.checkout_id, s.snapshot_id, s.i, s.mag, CASE WHEN f.flushed THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.flushed THEN 1 ELSE f.n + 1 END, CASE WHEN f.flushed THEN s.mag ELSE f.acc + s.mag END,
    CASE WHEN f.flushed THEN s.mag >= 0.4 ELSE f.n + 1 >= 5 OR f.acc + s.mag >= 0.4 END FROM fo f JOIN ses s ON s.checkout_id = f.checkout_id AND s.i = f.i + 1)"""


@query(f"WITH RECURSIVE {LIVE_SQL}, {_FOLD} SELECT checkout_id, snapshot_id, batch, round(acc, 4) AS accumulated, flushed FROM fo")
def q32_deferral_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "snapshots").select("snapshot_id", "checkout_id", "taken_at")
    s = _metrics(spark, sf_dir).select("snapshot_id", F.round("total_magnitude", 4).alias("magnitude")).join(heads, "snapshot_id")
    out = deferral.fold(s, ["checkout_id"], ["taken_at", "snapshot_id"], "magnitude")
    return out.select("checkout_id", "snapshot_id", "batch", F.round("accumulated", 4).alias("accumulated"), "flushed")


@query("SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS hash16 FROM documents")
def q33_content_hash16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash16(F.coalesce("text", F.lit(""))).alias("hash16"))


_IGNORE = ["tests/", "*.java", "!IndexAdapter.java", "web/**", "!web/**/*.ts", "/cmd/token"]


def _case(pats: list[str]) -> str:
    out = "false"
    for r in (patterns.to_regex(p) for p in pats):
        if r:
            out = f"CASE WHEN regexp_matches(path, '{r[0]}') THEN {str(r[1]).lower()} ELSE {out} END"
    return out


@query(f"SELECT DISTINCT path FROM files WHERE NOT {_case(_IGNORE)} AND {_case(['**/*.py', '*.ts'])}")
def q34_ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("path").where(patterns.selected(F.col("path"), ["**/*.py", "*.ts"], _IGNORE)).distinct()


@query(f"""WITH f AS (SELECT doc_id, regexp_extract(text, '(?s)\\A---\\n(.*?)\\n---', 1) AS f FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, {_STRIP % "regexp_extract(f, 'session_type:[ \\t\\n\\r\\f]*(.+)', 1)"} AS st, {_STRIP % "regexp_extract(f, 'generated:[ \\t\\n\\r\\f]*(.+)', 1)"} AS g FROM f)
SELECT doc_id, CASE WHEN st = '' THEN 'standard' ELSE st END AS session_type, g AS generated FROM v""")
def q35_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.front_matter(table(spark, sf_dir, "documents"), ["doc_id"])


# ---------------------------------------------------------------- compression, over what the project's parser kept

_SIG = """(CASE WHEN f.is_async THEN 'async ' ELSE '' END) || 'def ' || f.name || '(' || coalesce(array_to_string(list_transform(f.parameters, lambda p: p.name || coalesce(': ' || nullif(p.annotation, ''), '')), ', '), '') || ')' || coalesce(' -> ' || nullif(f.return_annotation, ''), '')"""


@query(f"""SELECT file_id, parsed_at, f.name AS name, f.line_start AS line_start, {_SIG} AS signature
FROM (SELECT file_id, parsed_at, unnest(list_concat(functions, flatten(list_transform(classes, lambda c: c.methods)))) AS f FROM parsed)""")
def q36_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "parsed").select("file_id", "parsed_at", F.explode(compress.all_functions()).alias("f"))
    return p.select("file_id", "parsed_at", "f.name", "f.line_start", compress.signature(F.col("f")).alias("signature"))


@query("""SELECT file_id, parsed_at, len(list_concat(functions, flatten(list_transform(classes, lambda c: c.methods)))) AS n_functions,
  len(functions) = 0 AND len(classes) = 0 AND total_lines < 20 AS trivial,
  coalesce(array_to_string(flatten(list_transform(classes, lambda c: list_filter(list_transform(c.methods, lambda m: m.name), lambda n: NOT starts_with(n, '_')))), ','), '') AS public_methods,
  coalesce(array_to_string(list_transform(list_filter(imports, lambda i: i.module <> ''), lambda i: i.module), ','), '') AS modules FROM parsed""")
def q37_file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed").select(
        "file_id", "parsed_at", compress.function_count().alias("n_functions"), compress.is_trivial().alias("trivial"),
        F.array_join(F.flatten(F.transform("classes", compress.public_methods)), ",").alias("public_methods"),
        F.array_join(F.transform(F.filter("imports", lambda i: i["module"] != ""), lambda i: i["module"]), ",").alias("modules"),
    )


_FN_SQL = """'{' || substr(concat(',"name":' || to_json(f.name), CASE WHEN len(f.parameters) > 0 THEN ',"params":' || to_json(list_transform(f.parameters, lambda q: CASE WHEN length(q.annotation) > 0 THEN q.name || ': ' || q.annotation ELSE q.name END)) END,
  CASE WHEN f.return_annotation <> '' THEN ',"returns":' || to_json(f.return_annotation) END, CASE WHEN f.is_async THEN ',"async":true' END, CASE WHEN len(f.decorators) > 0 THEN ',"decorators":' || to_json(list_transform(f.decorators, lambda q: q.name)) END,
  CASE WHEN f.complexity_hint > 5 THEN ',"complexity":' || f.complexity_hint END), 2) || '}'"""
_FILE_SQL = f"""WITH fn AS (SELECT file_id, parsed_at, path, {_FN_SQL} AS j, i FROM (SELECT file_id, parsed_at, path, unnest(functions) AS f, generate_subscripts(functions, 1) AS i FROM parsed)),
fs AS (SELECT file_id, parsed_at, path, string_agg(j, ',' ORDER BY i) AS j FROM fn GROUP BY 1, 2, 3),
cl AS (SELECT file_id, parsed_at, path, unnest(classes) AS c, generate_subscripts(classes, 1) AS i FROM parsed),
me AS (SELECT file_id, parsed_at, path, i, k, {_FN_SQL} AS j FROM (SELECT file_id, parsed_at, path, i, unnest(c.methods) AS f, generate_subscripts(c.methods, 1) AS k FROM cl) WHERE NOT (f.name LIKE '\\_\\_%' ESCAPE '\\' AND f.name LIKE '%\\_\\_' ESCAPE '\\' AND f.name <> '__init__')),
ms AS (SELECT file_id, parsed_at, path, i, string_agg(j, ',' ORDER BY k) AS j FROM me GROUP BY 1, 2, 3, 4),
cs AS (SELECT cl.file_id, cl.parsed_at, cl.path, string_agg('{{' || substr(concat(',"name":' || to_json(c.name), CASE WHEN len(c.bases) > 0 THEN ',"bases":' || to_json(c.bases) END, CASE WHEN len(c.decorators) > 0 THEN ',"decorators":' || to_json(list_transform(c.decorators, lambda q: q.name)) END,
  CASE WHEN len(c.class_variables) > 0 THEN ',"vars":' || to_json(c.class_variables) END, ',"methods":[' || ms.j || ']'), 2) || '}}', ',' ORDER BY cl.i) AS j
  FROM cl LEFT JOIN ms ON ms.file_id = cl.file_id AND ms.parsed_at IS NOT DISTINCT FROM cl.parsed_at AND ms.path IS NOT DISTINCT FROM cl.path AND ms.i = cl.i GROUP BY 1, 2, 3),
im AS (SELECT file_id, parsed_at, path, list(m ORDER BY i) AS m FROM (SELECT file_id, parsed_at, path, m, min(i) AS i FROM (SELECT file_id, parsed_at, path, unnest(imports).module AS m, generate_subscripts(imports, 1) AS i FROM parsed) WHERE length(m) > 0 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
t AS (SELECT p.file_id, p.parsed_at, p.path, '{{' || substr(concat(',"path":' || to_json(p.path), ',"lang":' || to_json(p.language), ',"lines":' || p.total_lines, CASE WHEN p.has_entry_point THEN ',"entry_point":true' END, ',"imports":' || to_json(im.m), ',"classes":[' || cs.j || ']', ',"functions":[' || fs.j || ']'), 2) || '}}' AS payload
  FROM parsed p LEFT JOIN fs ON fs.file_id = p.file_id AND fs.parsed_at IS NOT DISTINCT FROM p.parsed_at AND fs.path IS NOT DISTINCT FROM p.path LEFT JOIN cs ON cs.file_id = p.file_id AND cs.parsed_at IS NOT DISTINCT FROM p.parsed_at AND cs.path IS NOT DISTINCT FROM p.path
  LEFT JOIN im ON im.file_id = p.file_id AND im.parsed_at IS NOT DISTINCT FROM p.parsed_at AND im.path IS NOT DISTINCT FROM p.path WHERE NOT (len(functions) = 0 AND len(classes) = 0 AND total_lines < 20)),
z AS (SELECT *, list_sum(list_transform(string_split(json_pretty(CAST(payload AS JSON)), chr(10)), lambda x: length(x) - (length(x) - length(ltrim(x))) // 2 + 3)) - 1 + 5 * length(regexp_replace(payload, '[\\x00-\\x7f]', '', 'g')) AS n FROM t)
SELECT file_id, epoch_us(parsed_at) AS parsed_us, path, payload, CAST(n AS BIGINT) AS json_size, CAST(n // 4 AS BIGINT) AS tokens FROM z"""


@query(_FILE_SQL)
def q38_compressed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = compress.json_sizes(compress.files(table(spark, sf_dir, "parsed"), ("file_id", "parsed_at")))
    return c.select("file_id", F.unix_micros("parsed_at").alias("parsed_us"), "path", F.to_json("payload").alias("payload"), "json_size", compress.estimate_tokens(F.col("json_size")).alias("tokens"))


@query(f"""WITH p AS ({SQL["q22_prompt_text"]}), s AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_quoted(s.name)})" for i, s in enumerate(config.SECTIONS))}) AS v(o, name))
SELECT project, CAST(o AS BIGINT) AS sec_ord, name, CAST(length('Nothing to report in this section; the payload has ' || length(user_prompt) || ' characters.') AS BIGINT) AS length FROM p, s""")
def q39_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stub's answers to the prompts of q22, checked and formatted into sections."""
    out = model.generate_all(q22_prompt_text(spark, sf_dir), config.Model())
    return sections.for_output(out, ["project"], "content").select("project", "sec_ord", "name", F.length("content").cast("long").alias("length"))
