"""Further queries of the core: what is stored, shown and sent, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import __version__, config
from siltstone.functions import text as T
from siltstone.operators import classify, diff, graph, prompt, sections
from siltstone.plans import catalogue as C
from siltstone.plans.catalogue import query
from siltstone.session import new_table, table
from siltstone.sources import scan, store


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"WITH {C.EDGES_SQL} SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM (SELECT DISTINCT src, dst FROM e) GROUP BY 1")
def q42_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = graph.adjacency(C._edges(spark, sf_dir))
    return a.select("src", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query("SELECT project, arg_max(snapshot_id, (taken_at, snapshot_id)) AS snapshot_id, epoch_us(max(taken_at)) AS taken_us FROM snapshots WHERE project IS NOT NULL GROUP BY 1")
def q43_latest_of_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest snapshot of each project, by headers that were saved in a store twice."""
    own = store.Store(spark, new_table(spark, "store"))
    heads = table(spark, sf_dir, "snapshots").where("project is not null").select("project", "snapshot_id", "taken_at", "doc_id")
    for _ in range(2):
        own.save_headers(heads)
    return own.latest_of_each().select("project", "snapshot_id", F.unix_micros("taken_at").alias("taken_us"))


@query(f"""WITH h AS (SELECT doc_id, text, regexp_extract_all(text, '(?m)(^##{C._B}+.+$)', 1) AS hs, regexp_split_to_array(text, '(?m)^##{C._B}+.+$') AS bs FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, i AS o, {C._STRIP % "regexp_replace(hs[i], '^[# ]+', '')"} AS name, {C._STRIP % "bs[i + 1]"} AS content FROM (SELECT doc_id, hs, bs, unnest(range(1, len(hs) + 1)) AS i FROM h)
  UNION ALL SELECT doc_id, 1, 'Documentation', {C._STRIP % "text"} FROM h WHERE len(hs) = 0 AND {C._STRIP % "text"} <> ''),
b AS (SELECT doc_id, string_agg('## ' || name || chr(10) || chr(10) || content || chr(10), chr(10) ORDER BY o) AS body FROM u GROUP BY 1)
SELECT b.doc_id, md5('---' || chr(10) || 'generated: ' || strftime(coalesce(created_at, TIMESTAMPTZ '2025-01-01 00:00:00+00') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || ' UTC' || chr(10) || 'session_type: ' || doc_kind || chr(10) || 'model: stub' || chr(10)
  || 'files_analyzed: ' || n_chars || chr(10) || 'tokens: 1/2' || chr(10) || '---' || chr(10) || chr(10) || '# ' || source || chr(10) || chr(10) || body || chr(10) || '---' || chr(10) || {_text(f"*siltstone {__version__}*")} || chr(10)) AS document_md5
FROM b JOIN documents d ON d.doc_id = b.doc_id""")
def q44_formatted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    at = F.coalesce("created_at", F.lit("2025-01-01 00:00:00+00:00").cast("timestamp"))
    heads = d.select("doc_id", F.col("source").alias("project"), F.lit("stub").alias("model"), F.col("doc_kind").alias("session_type"), F.col("n_chars").alias("files_analyzed"), F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens"), F.to_utc_timestamp(at, F.current_timezone()).alias("saved_at"))
    out = prompt.formatted(sections.for_output(d, ["doc_id"]), ["doc_id"], heads)
    return out.select("doc_id", F.md5(F.col("document").cast("binary")).alias("document_md5"))


@query(f"""WITH s AS (SELECT DISTINCT project, doc_ord, doc_id FROM sections WHERE project IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY doc_ord, summary) AS i FROM (SELECT *, '{{"doc_id":"' || doc_id || '"}}' AS summary FROM s))
SELECT project, {_text(prompt.TEMPLATES["merge"])} AS system_prompt, md5('# Project: ' || project || chr(10) || chr(10) || 'Merge the following ' || count(*) || ' documentation snapshots:' || chr(10) || chr(10)
  || string_agg('## Snapshot ' || i || chr(10) || '```json' || chr(10) || summary || chr(10) || '```' || chr(10), chr(10) ORDER BY i)) AS user_md5 FROM n GROUP BY 1""")
def q45_merge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "sections").where("project is not null").select("project", "doc_ord", "doc_id").distinct()
    p = prompt.merge_prompt(docs.withColumn("summary", F.to_json(F.struct("doc_id"))), ["project"], ["doc_ord"], F.col("project"))
    return p.select("project", "system_prompt", F.md5(F.col("user_prompt").cast("binary")).alias("user_md5"))


@query(f"WITH {C.LIVE_SQL} SELECT snapshot_id, path FROM d WHERE change_type IN ('created', 'deleted')")
def q46_changes_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.of_type(C._changes(spark, sf_dir), diff.CREATED, diff.DELETED).select("snapshot_id", "path")


@query(f"""WITH {C.LIVE_SQL}, k AS (SELECT DISTINCT snapshot_id FROM snapshots), b AS (SELECT c.snapshot_id, session_type, i, o, conf FROM c JOIN {C._DIM} USING (session_type))
SELECT k.snapshot_id, coalesce(session_type, 'standard') AS session_type, CAST(coalesce(conf, 1.0) AS DOUBLE) AS confidence, CAST(coalesce(i, 3000) AS BIGINT) AS input_token_budget, CAST(coalesce(o, 5000) AS BIGINT) AS output_token_budget, coalesce(session_type = 'trivial', false) AS should_defer
FROM k LEFT JOIN b ON b.snapshot_id = k.snapshot_id""")
def q47_every_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all snapshots; the first of a checkout, which has no changes, is standard with the configured budgets."""
    keys, m = table(spark, sf_dir, "snapshots").select("snapshot_id"), config.Model()
    found = classify.classify_session(C._metrics(spark, sf_dir))
    out = classify.or_standard(found, keys, ["snapshot_id"], m.max_input_tokens, m.max_output_tokens)
    return out.select("snapshot_id", "session_type", "confidence", "input_token_budget", "output_token_budget", "should_defer")


@query(f"""WITH {C.LIVE_SQL} SELECT snapshot_id, path, CASE WHEN lines_delta > 0 THEN '+' || lines_delta ELSE CAST(lines_delta AS VARCHAR) END AS delta, printf('%.1f', CAST(lines_after AS DOUBLE) / 10) AS tenths FROM d""")
def q48_shown_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C._changes(spark, sf_dir).select("snapshot_id", "path", T.signed(F.col("lines_delta")).alias("delta"), T.one_place(F.col("lines_after") / 10).alias("tenths"))


_CODE = ", ".join(f"'{x}'" for x in T.CODE)


@query(f"SELECT project, {C._LANG} AS language, path FROM files WHERE {C._LANG} IN ({_CODE}) GROUP BY ALL")
def q49_code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").select("project", T.language(F.col("path")).alias("language"), "path")
    return scan.code_files(f).distinct()


@query(f"""WITH {C.SECTIONS_SQL} SELECT doc_id, arg_min(heading, sec_ord) AS heading, arg_min(content, sec_ord) AS content FROM x WHERE contains(lower(heading), 'edge cases') OR contains('edge cases', lower(heading)) GROUP BY 1""")
def q50_one_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.get_section(sections.extract(table(spark, sf_dir, "documents"), ["doc_id"]), "Edge Cases").select("doc_id", "heading", "content")


_SYSTEM = "CASE session_type " + " ".join(f"WHEN '{k}' THEN {_text(prompt.TEMPLATES[t])}" for k, t in prompt.TEMPLATE_OF.items()) + f" ELSE {_text(prompt.TEMPLATES['standard'])} END"


@query(f"""WITH g AS (SELECT project, session_type, list_sort(list(DISTINCT model) FILTER (model IS NOT NULL)) AS hi, list_sort(list(DISTINCT finish_reason) FILTER (finish_reason IS NOT NULL)) AS de, count(*) AS n FROM responses WHERE project IS NOT NULL GROUP BY 1, 2)
SELECT project, session_type, {_SYSTEM} AS system_prompt, md5('# Project: ' || project || chr(10) || chr(10) || {_text(prompt.sections_directive(config.SECTIONS))} || chr(10) || chr(10)
  || CASE WHEN len(hi) > 0 THEN '## Focus Areas' || chr(10) || 'Look at these files first:' || chr(10) || array_to_string(list_transform(hi, lambda x: '- `' || x || '`'), chr(10)) || chr(10) || chr(10) ELSE '' END
  || CASE WHEN len(de) > 0 THEN '## Previously Deferred Changes' || chr(10) || 'Small changes of earlier sessions:' || chr(10) || array_to_string(list_transform(de, lambda x: '- ' || x), chr(10)) || chr(10) || 'Take them into the notes.' || chr(10) || chr(10) ELSE '' END
  || '## Project Structure' || chr(10) || '```json' || chr(10) || '[' || n || ']' || chr(10) || '```') AS user_md5 FROM g""")
def q51_prompts_of_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of every class of session, with files to look at first and changes held back."""
    g = table(spark, sf_dir, "responses").where("project is not null").groupBy("project", "session_type").agg(F.sort_array(F.collect_set("model")).alias("hi"), F.sort_array(F.collect_set("finish_reason")).alias("de"), F.count("*").alias("n"))
    p = prompt.generation_prompt(g, config.SECTIONS, F.col("project"), F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]")), F.col("session_type"), F.col("hi"), F.col("de"))
    return p.select("project", "session_type", "system_prompt", F.md5(F.col("user_prompt").cast("binary")).alias("user_md5"))


@query("""SELECT '{"response_id":' || response_id || CASE WHEN model IS NULL THEN '' ELSE ',"model":' || to_json(model) END || CASE WHEN output_tokens IS NULL THEN '' ELSE ',"output_tokens":' || output_tokens END || '}' AS value FROM responses""")
def q52_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON, read by their schema and written again."""
    rows = table(spark, sf_dir, "responses").select("response_id", "model", "output_tokens")
    again = store.from_json_rows(store.to_json_rows(rows), "response_id bigint, model string, output_tokens bigint")
    return store.to_json_rows(again)
