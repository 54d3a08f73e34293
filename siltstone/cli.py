"""A thin command line over the library: init, generate, merge, status, diff, version, explain."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import __version__, config, model
from siltstone.functions import text as T
from siltstone.operators import budget, classify, compress, diff, graph, merge, prompt, structure, validate
from siltstone.operators import sections as sections_of
from siltstone.session import local_session, written
from siltstone.sources import scan
from siltstone.sources.store import Store
from siltstone.streaming import deferral


class Pipeline:
    """The whole way of one project, lazily up to each result that a step needs."""

    def __init__(self, spark: SparkSession, root: str, conf: config.Config, clock: datetime | None = None) -> None:
        self.spark, self.root, self.conf = spark, root, conf
        self.project = conf.project.name
        self.store = Store(spark, str(Path(root) / config.FOLDER / "store"))
        self.now = clock or datetime.now(timezone.utc)
        self.problems: list[tuple] = []  # what validation says of the text generated last
        f = conf.focus
        self.files = scan.scan_project(spark, root, f.include_patterns, f.exclude_patterns, self.project)

    def snapshot(self) -> tuple[str, DataFrame]:
        sid = f"snap_{self.now:%Y%m%d_%H%M%S_%f}"
        return sid, scan.snapshot_of(self.files, sid)

    def changes(self) -> DataFrame | None:
        """None if there is no earlier snapshot."""
        old = self.store.load_latest_snapshot(self.project)
        return None if old is None else diff.compare(old, self.snapshot()[1], ["project", "path"])

    def classified(self, changes: DataFrame | None) -> DataFrame:
        parsed = structure.parse(self.files)
        edges = graph.resolve(structure.imports(parsed), self.files)
        keys = self.spark.createDataFrame([(self.project,)], "project string")
        m = self.conf.model
        if changes is None:
            none = self.spark.createDataFrame([], "project string, session_type string, confidence double, reason string, input_token_budget bigint, output_token_budget bigint, should_defer boolean")
            return classify.or_standard(none, keys, ["project"], m.max_input_tokens, m.max_output_tokens)
        nodes = graph.subgraph(self.files, edges, changes)
        c = self.conf.classifier
        limits = classify.Limits(c.trivial_max_files, c.trivial_max_lines, c.minor_max_files, c.minor_max_lines, c.standard_max_files, c.standard_max_lines)
        return classify.or_standard(classify.classify(diff.metrics(nodes, ["project"]), limits), keys, ["project"], m.max_input_tokens, m.max_output_tokens)

    def prompts(self, classified: DataFrame, scope: DataFrame | None = None, deferred: list[str] | None = None) -> DataFrame:
        """One prompt for each project; scope (path) narrows the payload to some files."""
        files = scan.code_files(self.files)
        if scope is not None:
            files = files.join(scope.select("path").distinct(), "path", "left_semi")
        payloads = compress.files(structure.parse(files), verbose=self.conf.output.compression == "verbose", skip_trivial=self.conf.focus.skip_trivial)
        first = classified.select("project", "session_type", "input_token_budget")
        limit = first.first()["input_token_budget"]  # a pipeline is of one project
        sections = self.conf.template_sections
        kept = written(budget.trimmed(compress.sized(payloads), ["project"], ["path"], [(s.id, s.priority) for s in sections], limit), "trimmed")
        found = kept.agg(F.max("stage").alias("stage")).first()["stage"]
        # Without any row that is kept only the sections count.
        stage = found if found is not None else next((i for i, p in enumerate(budget.PRIORITY) if budget.SECTION_TOKENS * sum(s.priority <= p for s in sections) <= limit), 4)
        sections = [s for s in sections if s.priority <= budget.PRIORITY[stage]]
        body = prompt.payload_json(kept, ["project"], ["path"])
        body = first.join(body, "project", "left").withColumn("payload", F.coalesce("payload", F.lit("[]"))).withColumn("n_files", F.coalesce("n_files", F.lit(0)))
        texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
        return prompt.generation_prompt(body, sections, F.col("project"), F.col("payload"), F.col("session_type"), texts(self.conf.focus.highlight), texts(deferred or []))

    def generate(self, call: model.Call | None = None, force: bool = False, dry_run: bool = False, auto_flush: bool = False, only_changed: bool = False) -> str | None:
        """Writes a document and the snapshot it describes; gives the document's id.

        None if nothing has changed, on a dry run, or if the session is trivial: it is then held
        back, unless forced. auto_flush gives out what is held back when its limits are reached;
        only_changed narrows the payload to changed and affected files.
        """
        changes = self.changes()
        if changes is not None and not force and diff.is_empty(changes):
            return None
        kind = self.classified(changes)
        first = kind.first()
        sid, snap = self.snapshot()
        c = self.conf.classifier
        deferred: list[str] = []
        if changes is not None and first["should_defer"] and not force:
            m = diff.metrics(changes, ["project"]).withColumn("s", deferral.summary(F.col("files_changed"), F.col("lines_added"), F.col("lines_removed"))).first()
            paths = [r["path"] for r in changes.select("path").limit(c.trivial_max_files + 1).collect()]  # a trivial session has no more
            self.store.save_pending(self.project, f"deferred_{sid}", self.now, paths, m["s"], m["total_magnitude"])
            held = self.store.load_pending(self.project).agg(F.count("*").alias("n"), F.sum("magnitude").alias("m")).first()
            if not (auto_flush and (held["n"] >= c.max_deferred_sessions or held["m"] >= c.flush_threshold)):
                self.store.save_snapshot(snap, self.project, sid, self.now)
                return None
        if dry_run:
            return None
        if auto_flush:
            deferred = self.store.flush(self.project, self.now)
        scope = None
        if only_changed and changes is not None:
            edges = graph.resolve(structure.imports(structure.parse(self.files)), self.files)
            scope = graph.subgraph(self.files, edges, changes)
        row = model.generate_all(self.prompts(kind, scope, deferred), self.conf.model, call).first()
        self.problems = [tuple(r) for r in self.warnings(row["content"]).drop("doc_id").collect()]  # of one text
        docs = self.spark.createDataFrame([(self.project, row["content"])], "project string, text string")
        heads = self.spark.createDataFrame(
            [(self.project, row["model"], row["session_type"], row["n_files"], row["input_tokens"], row["output_tokens"], self.now)],
            "project string, model string, session_type string, files_analyzed bigint, input_tokens bigint, output_tokens bigint, saved_at timestamp",
        )
        text = prompt.formatted(sections_of.for_output(docs, ["project"]), ["project"], heads).first()["document"]
        doc_id = self.store.save_doc(self.project, text, self.now, row["session_type"], row["model"], row["n_files"])
        self.store.save_snapshot(snap, self.project, sid, self.now, doc_id)
        return doc_id

    def warnings(self, content: str) -> DataFrame:
        docs = self.spark.createDataFrame([("doc", content)], "doc_id string, text string")
        return validate.warnings(docs, ["doc_id"], [s.name for s in self.conf.template_sections], self.files.select("path"))

    def merge_local(self) -> str:
        found = sections_of.extract(self.store.load_all_docs(self.project), ["project", "doc_ord", "doc_id"], "content")
        row = merge.merged_document(found).first()
        return row["document"] if row else "# No documentation found\n"

    def merge_with_model(self, call: model.Call | None = None) -> str:
        """The documents' summaries merged by a model call."""
        docs = self.store.load_all_docs(self.project)
        keys = ["project", "doc_ord", "doc_id"]
        parts = sections_of.summaries(sections_of.extract(docs, keys, "content"), keys)
        item = F.struct("sec_ord", "heading", "words", "content")
        body = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["heading"].alias("heading"), x["words"].alias("words"), x["content"].alias("content"))).alias("sections"))
        front = sections_of.front_matter(docs, keys, "content").withColumnRenamed("generated", "timestamp")
        whole = front.join(body, keys, "left").select("project", "doc_ord", F.to_json(F.struct("doc_id", "session_type", "timestamp", "sections")).alias("summary"))
        prompts = prompt.merge_prompt(whole, ["project"], ["doc_ord"], F.col("project"))
        out = model.generate_all(prompts, self.conf.model, call)
        n = docs.groupBy("project").agg(F.count("*").alias("n_docs"))
        return prompt.formatted_merge(out.join(n, "project").withColumn("saved_at", F.lit(self.now)), ["project"], self.conf.model.model_name).first()["document"]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siltstone")
    p.add_argument("--root", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("init")
    a.add_argument("--preset")
    a.add_argument("--name")
    a.add_argument("--language")
    for name in ("status", "diff", "version"):
        sub.add_parser(name)
    a = sub.add_parser("generate")
    for flag in ("--force", "--dry-run", "--auto-flush", "--only-changed"):
        a.add_argument(flag, action="store_true")
    a = sub.add_parser("merge")
    a.add_argument("--output")
    a.add_argument("--local", action="store_true")
    sub.add_parser("explain").add_argument("doc_id")
    args = p.parse_args(argv)
    try:
        if args.command == "version":
            print(__version__)
            return 0
        if args.command == "init":
            print(config.init_project(args.root, args.preset, args.name, args.language).project.name)
            return 0
        conf = config.load_config(args.root)
        run = Pipeline(local_session(), str(Path(args.root).resolve()), conf)
        if args.command == "generate":
            print(run.generate(force=args.force, dry_run=args.dry_run, auto_flush=args.auto_flush, only_changed=args.only_changed) or "nothing written")
            for problem in run.problems:
                print("warning:", *problem, file=sys.stderr)
        elif args.command == "merge":
            text = run.merge_local() if args.local else run.merge_with_model()
            target = Path(args.output or Path(args.root) / config.FOLDER / "DOCUMENTATION.md")
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(text, encoding="utf-8")
            print(target)
        elif args.command == "status":
            from siltstone.sources.store import manifest

            own = run.store.docs().where(F.col("project") == conf.project.name)
            m = manifest(own).first()
            rows = [("Project", conf.project.name), ("Language", conf.project.language), ("Model", conf.model.model_name), ("Documents", m["total_docs"] if m else 0), ("Last document", m["last_doc_id"] if m else "-"), ("Merge state", m["merge_state"] if m else "none"), ("Cadence", conf.cadence.n_value), ("Trigger", conf.cadence.trigger)]
            for name, value in rows:
                print(f"{name}: {value}")
            for r in own.select("doc_id", "session_type", "model", "files_analyzed", T.display_time(F.col("saved_at")).alias("at")).orderBy("doc_ord").toLocalIterator():
                print(*r, sep="\t")
        elif args.command == "diff":
            found = run.changes()
            if found is None:
                print("no snapshot yet")
            else:
                for r in found.select("change_type", "path", T.signed(F.col("lines_delta")).alias("d")).orderBy("path").toLocalIterator():
                    print(r["change_type"], r["path"], r["d"])
        else:
            row = run.store.get_doc(conf.project.name, args.doc_id).first()
            if row is None:
                raise ValueError(f"no document {args.doc_id}")
            print(row["content"])
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
