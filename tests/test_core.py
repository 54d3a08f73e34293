import difflib
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltstone import config, model
from siltstone.functions import text as T
from siltstone.operators.running import running
from siltstone.operators import budget, classify, compress, diff, graph, merge, prompt, sections, structure, validate
from siltstone.sources import patterns, scan
from siltstone.sources.store import Store, from_json_rows, manifest, numbered, to_json_rows
from siltstone.streaming import deferral

SIDE = "project string, path string, hash string, lines long"


def test_snapshots_of_two_projects_with_one_id(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("x", "a.py", "1", 1, 1)], "project string, path string, hash string, size long, lines long")
    for p, n in (("A", 1), ("B/ü", 2)):
        store.save_snapshot(rows.withColumn("path", F.lit(p)), p, "s1", datetime(2025, 1, n))
    store.save_snapshot(rows.withColumn("path", F.lit("b2")), "B/ü", "s1", datetime(2025, 1, 3))
    assert {(r.project, r.path) for r in store.load_snapshot("s1").collect()} == {("A", "A"), ("B/ü", "b2")}
    assert [r.path for r in store.load_latest_snapshot("A").collect()] == ["A"]
    assert {(r.project, r.snapshot_id) for r in store.latest_of_each().collect()} == {("A", "s1"), ("B/ü", "s1")}


def test_writers_at_one_time_get_different_numbers(spark, tmp_path, monkeypatch):
    a, b = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    first = a.save_doc("p/q", "x", datetime(2025, 1, 1), "minor", "m", 1)
    # The second writer still sees an empty table.
    monkeypatch.setattr(b, "docs", lambda: a.docs().where("false"))
    assert [first, b.save_doc("p/q", "y", datetime(2025, 1, 1), "minor", "m", 1)] == ["pd_001", "pd_002"]


def test_a_cluster_must_name_a_shared_folder():
    from unittest.mock import MagicMock

    from siltstone.session import shared_dir

    s = MagicMock()
    s.conf.get.return_value = None
    s.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    s.sparkContext.master = "spark://x:7077"
    with pytest.raises(ValueError):
        shared_dir(s)
    s.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = True
    s.sparkContext._jsc.sc().getCheckpointDir().get.return_value = "hdfs://x/y"
    assert shared_dir(s) == "hdfs://x/y"


def test_compare_and_totals(spark):
    old = spark.createDataFrame([("p", "same", "1", 5), ("p", "mod", "1", 10), ("p", "gone", "1", 7), ("p", "unread", "", 1), ("p", "null", None, 1)], SIDE)
    new = spark.createDataFrame([("p", "same", "1", 5), ("p", "mod", "2", 4), ("p", "new", "1", 300), ("p", "unread", "", 1), ("p", "null", "", 1)], SIDE)
    c = diff.compare(old, new, ["project", "path"])
    assert {(r.path, r.change_type, r.lines_delta) for r in c.collect()} == {("mod", "modified", -6), ("gone", "deleted", -7), ("new", "created", 300)}
    t = diff.totals(c, ["project"]).first()
    assert (t.files_created, t.files_modified, t.files_deleted, t.total_lines_added, t.total_lines_removed) == (1, 1, 1, 300, 13)
    m = {r.path: r.m for r in c.select("path", diff.magnitude().alias("m")).collect()}
    assert m == {"mod": 0.06, "gone": 7 / 200, "new": 1.0}
    assert diff.is_empty(diff.compare(old, old, ["project", "path"]))


METRICS = "k string, files_changed long, new_files_created long, files_deleted long, lines_added long, lines_removed long, net_lines long, affected_nodes_count long, total_magnitude double, has_structural_changes boolean"


@pytest.mark.parametrize(
    ("v", "kind"),
    [
        ((1, 0, 0, 10, 5, 5, 0, 0.1, False), "trivial"),
        ((3, 1, 0, 80, 20, 60, 2, 0.3, True), "minor"),
        ((8, 2, 0, 300, 50, 250, 5, 0.5, True), "standard"),
        ((20, 5, 2, 800, 200, 600, 10, 0.8, True), "major"),
        ((2, 0, 0, 30, 0, 30, 0, 0.0, False), "trivial"),
        ((2, 0, 0, 31, 0, 31, 0, 0.0, False), "minor"),
        ((3, 0, 0, 1, 0, 1, 0, 0.0, False), "minor"),
        ((5, 0, 0, 150, 0, 150, 0, 0.0, False), "minor"),
        ((5, 0, 0, 151, 0, 151, 0, 0.0, False), "standard"),
        ((6, 0, 0, 1, 0, 1, 0, 0.0, False), "standard"),
        ((15, 0, 0, 500, 0, 500, 0, 0.0, False), "standard"),
        ((16, 0, 0, 1, 0, 1, 0, 0.0, False), "major"),
        ((3, 1, 1, 100, 51, 49, 0, 0.0, True), "refactor"),
        ((3, 1, 1, 100, 149, -49, 0, 0.0, True), "refactor"),
        ((3, 1, 1, 100, 50, 50, 0, 0.0, True), "minor"),
        ((2, 1, 1, 10, 10, 0, 0, 0.0, True), "minor"),
    ],
)
def test_classes(spark, v, kind):
    r = classify.classify(spark.createDataFrame([("k", *v)], METRICS)).first()
    assert (r.session_type, r.should_defer, r.input_token_budget) == (kind, kind == "trivial", classify.BUDGETS[kind][0])


def test_closure_on_random_graphs(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        n = 40
        edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(60)}
        start = set(rnd.sample(range(n), 3))
        seen, todo = set(start), list(start)
        while todo:
            x = todo.pop()
            for a, b in edges:
                if b == x and a not in seen:
                    seen.add(a)
                    todo.append(a)
        e = spark.createDataFrame([("p", str(a), str(b)) for a, b in edges], "project string, src string, dst string")
        c = spark.createDataFrame([("p", str(x)) for x in start], "project string, path string")
        assert {int(r.path) for r in graph.affected(e, c).collect()} == seen - start


def test_resolution_takes_the_first_other_file(spark):
    files = spark.createDataFrame([("p", x, "", 1) for x in ("a.py", "a/__init__.py", "src/b.py", "lib/b.py", "lib/c/__init__.py")], SIDE)
    imports = spark.createDataFrame([("p", "x.py", "a"), ("p", "a.py", "a"), ("p", "x.py", "b"), ("p", "x.py", "c"), ("p", "x.py", "none"), ("p", "x.py", None)], "project string, src string, module string")
    assert {(r.src, r.dst) for r in graph.resolve(imports, files).collect()} == {("x.py", "a.py"), ("a.py", "a/__init__.py"), ("x.py", "src/b.py"), ("x.py", "lib/c/__init__.py")}


def test_deleted_nodes_are_opt_in(spark):
    nodes = spark.createDataFrame([("p", "a", "", 3)], SIDE)
    ch = spark.createDataFrame([("p", "gone", "deleted", 4, 0, -4), ("p", "new", "created", 0, 2, 2)], "project string, path string, change_type string, lines_before long, lines_after long, lines_delta long")
    e = spark.createDataFrame([("p", "a", "gone")], "project string, src string, dst string")
    assert {(r.path, r.change_type) for r in graph.subgraph(nodes, e, ch).collect()} == {("new", "created"), ("a", "affected")}
    assert ("gone", "deleted") in {(r.path, r.change_type) for r in graph.subgraph(nodes, e, ch, include_deleted=True).collect()}


COMPLEX = 4
CODE = '''"""Doc."""
import os, sys as s
from . import x
from a.b import c as d

G = 1

@deco(1, "x")
async def f(a: int, /, b="q", *args, k=2, **kw) -> str:
    """First.

    More."""
    import deep
    if a and b or a:
        return [i for i in b if i]

class C(Base):
    v = 1
    w: int = 2

    @property
    def p(self): return 1

    def __repr__(self): return ""

if __name__ == "__main__":
    f(1)
'''


def test_python_structure():
    r = structure.python_file(CODE)
    f, c = r["functions"][0], r["classes"][0]
    assert [p["name"] for p in f["parameters"]] == ["a", "b", "*args", "k", "**kw"]
    assert (f["is_async"], f["return_annotation"], f["decorators"][0]) == (True, "str", {"name": "deco", "arguments": ["1", "'x'"]})
    assert [m["name"] for m in c["methods"]] == ["p", "__repr__"] and c["methods"][0]["is_property"] and c["methods"][0]["parameters"] == []
    assert c["class_variables"] == ["v", "w"] and r["global_variables"] == ["G"] and r["has_entry_point"]
    assert [i["module"] for i in r["imports"]] == ["os", "sys", "", "a.b"] and set(r["deep_imports"]) == {"os", "sys", "a.b", "deep"}
    assert f["complexity_hint"] == COMPLEX
    assert structure.python_file("def (")["failed"] and structure.python_file("def (\n\n")["total_lines"] == 3


def test_pattern_structure():
    js = structure.other_file("import a from 'm';\n\nexport async function go(x) {}\nclass K extends B {\n}\n", ".js")
    assert js["functions"][0]["name"] == "go" and js["functions"][0]["line_start"] == 3 and js["classes"][0]["bases"] == ["B"] and js["imports"][0]["module"] == "m"
    assert structure.other_file("pub fn a(x: u8) {}", ".rs")["functions"][0]["name"] == "a"
    assert structure.other_file("x", ".cjs")["language"] == "unknown"


FLAT = """def f(a, b):
    with a as x, b as y:
        assert x
        return [i for i in y], {j: 1 for j in x}
"""


def test_complexity_counts_branches_only():
    n = lambda t: structure.python_file(t)["functions"][0]["complexity_hint"]
    assert n(FLAT) == 1
    assert n("def f(a):\n    if a and b or c:\n        pass\n    elif a:\n        pass\n    while a: a = 1 if b else 2\n") == 7
    assert n("async def f(a):\n    async for x in a:\n        try: pass\n        except E: pass\n        except F: pass\n") == 4


DECLARED = {
    ".js": ("// function no() {}\nconst s = 'function no() {}';\nimport a, {\n  b } from 'm';\nimport './side';\nconst c = require(\"n\");\n\nexport async function go(x = f(1)) { return function () {} }\nexport default class K extends L.M {\n}\n", [("go", 8)], [("K", 9, ["L.M"])], ["m", "n"]),
    ".tsx": ("import type { A } from './a'\nfunction f<T extends Map<K, V>>(x: T) {}\nexport class B<T> extends C<T> implements D, E {\n}\n", [("f", 2)], [("B", 3, ["C"])], ["./a"]),
    ".java": ("package p;\nimport a.b.C;\nimport static a.b.D;\n/* class No { } */\npublic class A<T> extends B {\n  public A(int x) { if (x > 1) { } else if (x < 2) { } }\n  @Override\n  public static List<String> run(Map<String, int[]> a) throws X, Y {\n    return new Z(1) { };\n  }\n  int g();\n}\n", [("A", 6), ("run", 8)], [("A", 5, ["B"])], ["a.b.C"]),
    ".go": ("package a\nimport \"fmt\"\nimport (\n\tx \"a/b\"\n\t\"c\"\n)\nfunc (t *T) F(a int) { fmt.Println(\"d\") }\nfunc G[K any]() {}\nvar h = func(x int) {}\n", [("F", 7)], [], ["fmt", "a/b", "c"]),
    ".rs": ("// fn no() {}\npub async fn f<T: Fn(u8) -> u8>(x: T) {}\nimpl A { fn g(&self) { let c = '{'; } }\n", [("f", 2), ("g", 3)], [], []),
    ".rb": ("def f\nend\n", [], [], []),
}


@pytest.mark.parametrize("ending", list(DECLARED))
def test_declarations(ending):
    text, functions, classes, imports = DECLARED[ending]
    r = structure.other_file(text, ending)
    assert [(f["name"], f["line_start"]) for f in r["functions"]] == functions
    assert [(c["name"], c["line_start"], c["bases"]) for c in r["classes"]] == classes
    assert [i["module"] for i in r["imports"]] == imports and all(i["is_from"] for i in r["imports"])
    assert r["total_lines"] == text.count("\n") + 1
    for cut in range(0, len(text), 7):
        structure.other_file(text[:cut], ending)


def test_compression_and_token_size(spark):
    files = spark.createDataFrame([("p", "m.py", "python", CODE.encode()), ("p", "t.py", "python", b"# nothing\n"), ("p", "n.py", "python", None)], "project string, path string, language string, content binary")
    parsed = structure.parse(files)
    c = compress.json_sizes(compress.files(parsed))
    r = c.collect()
    assert [x.path for x in r] == ["m.py"]
    data = json.loads(c.select(F.to_json("payload")).first()[0])
    assert data["functions"][0]["params"] == ["a: int", "b", "*args", "k", "**kw"] and [m["name"] for m in data["classes"][0]["methods"]] == ["p"]
    assert "doc" not in data["functions"][0] and data["imports"] == ["os", "sys", "a.b"]
    assert len(json.dumps([data], indent=2)) == r[0].json_size + 4
    v = compress.files(parsed, verbose=True).select(F.to_json("payload")).first()[0]
    assert json.loads(v)["functions"][0]["doc"] == "First." and json.loads(v)["module_doc"] == "Doc."
    sig = parsed.where("size(functions) > 0").select(compress.signature(F.element_at("functions", 1)).alias("s")).first().s
    assert sig == "async def f(a: int, b, *args, k, **kw) -> str"


@pytest.mark.parametrize(("cap", "stage"), [(10_000, 0), (610, 1), (500, 2), (300, 3), (200, 4)])
def test_stages(spark, cap, stage):
    d = spark.createDataFrame([("p", i, 60, 20) for i in range(15)], "project string, i int, n long, bare long")
    dim = spark.createDataFrame([(s.id, s.priority) for s in config.SECTIONS], "id string, priority int")
    assert budget.stages(d, ["project"], "n", "bare", dim, F.lit(cap)).first().stage == stage


def test_prefix_is_the_longest_that_fits(spark):
    items = [{"a": "x" * k} for k in range(20)]
    size = [sum(len(y) + 3 for y in json.dumps(i, indent=2).split("\n")) - 1 for i in items]
    d = spark.createDataFrame([("p", i, n) for i, n in enumerate(size)], "project string, i int, n long")
    for cap in (10, 60, 100, 1000):
        kept = budget.prefix(d, ["project"], ["i"], "n", F.lit(cap), F.lit(1)).where("kept").count()
        best = max([k for k in range(21) if len(json.dumps(items[:k], indent=2)) // 4 + 50 <= cap and k] or [0])
        assert kept == best


def test_sections(spark):
    text = "---\nsession_type: minor\ngenerated: 2025\n---\nintro\n## Code Architecture\nbody\n\n##\nnext\nmore\n## Empty\n\n##  Data Flow \r\nx\n```\n## inside\n```\n### no\n"
    d = spark.createDataFrame([(1, text, "c"), (2, None, "c"), (3, "", "c"), (4, "plain", "c")], "doc_id long, text string, content string").drop("content")
    r = {(x.sec_ord, x.heading): (x.content, x.section_id) for x in sections.extract(d, ["doc_id"]).collect()}
    assert r[0, "Code Architecture"] == ("body", "architecture") and r[1, "next"] == ("more", None)
    assert r[3, "Data Flow"][1] == "data_flow" and (2, "Empty") not in r and r[4, "inside"][0] == "```\n### no"
    o = {(x.doc_id, x.name) for x in sections.for_output(d, ["doc_id"]).collect()}
    assert (1, "Empty") in o and (4, "Documentation") in o and not any(k == 3 for k, _ in o)
    f = {x.doc_id: (x.session_type, x.generated) for x in sections.front_matter(d, ["doc_id"]).collect()}
    assert f == {1: ("minor", "2025"), 3: ("standard", ""), 4: ("standard", "")}


def _merge_by_hand(versions, threshold):
    def near(a, b):
        return difflib.SequenceMatcher(None, a, b).ratio() > threshold

    last = versions[-1][1]
    if all(near(c, last) for _, c in versions[:-1]):
        return "latest", last
    keep = [f"*[{d}]*\n\n{c}" for i, (d, c) in enumerate(versions) if i == len(versions) - 1 or not any(near(c, e) for _, e in versions[i + 1 :])]
    return "accumulated", "\n\n---\n\n".join(keep)


def test_fuzzy_merge_as_by_hand(spark):
    rnd = random.Random(3)
    base = ["alpha beta gamma delta " * 4, "quite another text on other things " * 3, "short"]
    rows, want = [], {}
    for g in range(8):
        versions = []
        for i in range(rnd.randint(1, 6)):
            c = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 8)):
                c[rnd.randrange(len(c))] = rnd.choice("xyz ")
            versions.append((f"pd_{i:03d}", "".join(c)))
            rows.append(("p", i, g, f"pd_{i:03d}", f"Group {g}", "".join(c), None))
        want[f"group {g}"] = _merge_by_hand(versions, 0.85)
    s = spark.createDataFrame(rows, "project string, doc_ord long, sec_ord long, doc_id string, heading string, content string, section_id string")
    assert {r.group_key: (r.strategy, r.content) for r in merge.merged(s).collect()} == want
    assert merge.merged_document(s).count() == 1
    assert merge.ratio("a", "a") == 1.0 and merge.ratio("abc", "xyz") < 0.5


def test_validation(spark):
    good = "# T\n## Status\n" + "maybe " * 11 + "see `src/a.py` and `zz/unknown.py` and `pip install x.py` and `http://a.py` and `a=b.py` and `..`\n"
    docs = spark.createDataFrame([(1, good), (2, "short"), (3, None), (4, "x" * 60)], "doc_id long, text string")
    known = spark.createDataFrame([("src/a.py",), ("lib/other.py",)], "path string")
    w = validate.warnings(docs, ["doc_id"], ["Status", "Debt"], known)
    got = {(r.doc_id, r.category, r.severity) for r in w.collect()}
    assert got == {(1, "missing_section", "warning"), (1, "hallucination", "warning"), (1, "hedging", "warning"), (2, "format", "error"), (3, "format", "error"), (4, "missing_section", "warning"), (4, "format", "warning")}
    assert {r.doc_id: r.is_valid for r in validate.results(docs, ["doc_id"], w).collect()} == {1: True, 2: False, 3: False, 4: True}


@pytest.mark.parametrize(
    ("pats", "path", "hit"),
    [
        (["*.pyc"], "a/b.pyc", True), (["/x"], "x/y", True), (["/x"], "a/x", False), (["tests/"], "a/tests/b", True), (["tests/"], "tests", False), (["a/**/b"], "a/b", True), (["a/**/b"], "a/x/y/b", True),
        (["**/*.py"], "m.py", True), (["*.py", "!keep.py"], "d/keep.py", False), (["# c", ""], "# c", False), (["a?c"], "abc", True), (["[ab].x"], "b.x", True), (["[!ab].x"], "b.x", False), (["*.{js,ts}"], "a.js", False), (["d/**"], "d/e/f", True), (["d/**"], "d", False),
    ],
)
def test_patterns(spark, pats, path, hit):
    assert spark.createDataFrame([(path,)], "path string").select(patterns.matched(F.col("path"), pats)).first()[0] is hit


def test_scan_and_store(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "__pycache__").mkdir()
    (root / ".gitignore").write_text("# c\n__pycache__/\n")
    (root / "src/a.py").write_bytes(b"x\r\ny")
    (root / "b.TXT").write_bytes(b"")
    (root / "__pycache__/a.py").write_bytes(b"z")
    f = scan.scan_project(spark, str(root), exclude=[".gitignore"])
    assert {(r.path, r.size, r.lines, r.language) for r in f.collect()} == {("src/a.py", 4, 2, "python"), ("b.TXT", 0, 0, None)}
    assert {r.language: r.files for r in scan.language_counts(f).collect()} == {"python": 1}
    with pytest.raises(NotADirectoryError):
        scan.scan_project(spark, str(root / "none"))
    s = Store(spark, str(tmp_path / "store"))
    assert s.load_latest_snapshot("default") is None
    for i in (1, 2):
        s.save_snapshot(scan.snapshot_of(f, f"s{i}"), "default", f"s{i}", datetime(2025, 1, i))
    assert s.latest("default") == "s2" and s.load_snapshot("s1").count() == 2
    assert [s.save_doc("default", "text", datetime(2025, 1, 1), "minor", "m", 1) for _ in range(2)] == ["pd_001", "pd_002"]
    assert manifest(s.docs()).first().merge_state == "stale" and s.get_doc("default", "pd_001").count() == 1


def test_numbers_and_json(spark):
    d = spark.range(1001).select(F.lit("p").alias("project"), "id")
    assert numbered(d, ["id"]).orderBy(F.desc("id")).first().doc_id == "pd_1001"
    j = to_json_rows(spark.createDataFrame([(1.23456, None)], "m double, s string"), {"m": 4})
    assert from_json_rows(j, "m double, s string").first().m == 1.2346


def test_fold_and_stream_agree(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(f"u{rnd.randrange(3)}", f"s{i:03d}", datetime(2025, 1, 1, 0, i), rnd.choice([0.01, 0.1, 0.3, None])) for i in range(50)]
    d = spark.createDataFrame(rows, "key string, session_id string, ts timestamp, magnitude double")
    batch = deferral.fold(d, ["key"], ["ts", "session_id"], "magnitude")
    want = {}
    for k, s, _, m in sorted(rows, key=lambda r: r[2]):
        n, total, b, held = want.setdefault(k, [0, 0.0, 0, []])
        held.append((s, b))
        n, total = n + 1, total + (m or 0.0)
        if n >= 5 or total >= 0.4:
            n, total, b = 0, 0.0, b + 1
        want[k][:3] = [n, total, b]
    assert {(r.key, r.session_id, r.batch) for r in batch.collect()} == {(k, s, b) for k, v in want.items() for s, b in v[3]}
    assert {r.key: r.sessions_deferred for r in deferral.pending(batch, ["key"]).collect()} == {k: v[0] for k, v in want.items()}
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    st = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = deferral.stream(st).writeStream.format("memory").queryName("fold_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    flushed = batch.groupBy("key", "batch").agg(F.bool_or("flushed").alias("f")).where("f").select("key", "batch")
    assert {(r.key, r.batch, r.session_id) for r in spark.table("fold_out").collect()} == {(r.key, r.batch, r.session_id) for r in batch.join(flushed, ["key", "batch"]).collect()}


def test_config(tmp_path):
    assert config.from_dict(None) == config.Config()
    for bad in ({"cadence": {"n_value": 51}}, {"model": {"max_input_tokens": 1}}, {"project": {"type": "no"}}, {"nope": 1}, {"classifier": {"flush_threshold": 1.1}}):
        with pytest.raises(ValueError):
            config.from_dict(bad)
    with pytest.raises(FileNotFoundError):
        config.load_config(tmp_path)
    c = config.init_project(tmp_path, "fullstack", language="go")
    assert config.load_config(tmp_path) == c and c.project.name == tmp_path.name and c.project.language == "go"
    with pytest.raises(FileExistsError):
        config.init_project(tmp_path)
    with pytest.raises(ValueError, match="minimal"):
        config.load_preset("none")
    assert len(config.list_presets()) == 7
    p = config.load_preset("ml_research")
    assert (p.project.phase_style, p.model.max_input_tokens, p.output.max_doc_tokens) == ("phased", 3500, 8000) and "wandb/**" in p.focus.exclude_patterns
    assert [(s.id, s.priority) for s in p.template_sections][-2:] == [("interview", 2), ("commands", 1)] and p.template_sections[3].depth == "non_obvious_only"


def test_model_and_prompt(spark):
    with pytest.raises(ValueError):
        model.generate("", "", config.Model(tier="api", provider="openai"))
    d = spark.createDataFrame([("p", "[]", "minor")], "project string, payload string, session_type string")
    p = prompt.generation_prompt(d, config.SECTIONS[:2], F.col("project"), F.col("payload"), F.col("session_type"), F.array(F.lit("a.py")), F.array().cast("array<string>"))
    r = model.generate_all(p, config.Model()).first()
    assert "Focus Areas" in r.user_prompt and "Deferred" not in r.user_prompt and r.content.count("## ") == 2


def test_text_functions(spark):
    d = spark.createDataFrame([("a/b.PY", " x\x1c "), (".env", " w w ")], "p string, t string")
    r = d.select(T.language(F.col("p")).alias("l"), T.strip(F.col("t")).alias("s"), T.word_count(F.col("t")).alias("n")).collect()
    assert [(x.l, x.s, x.n) for x in r] == [("python", "x", 1), (None, "w w", 2)]


def test_large_groups_are_split_without_a_difference(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), i, rnd.choice([None, 1, 5])) for i in range(400)]
    d = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    x, y = ({tuple(r) for r in running(d, ["k"], ["i"], "v", n).collect()} for n in (10**6, 20))
    assert x == y and len(x) == 400
    total = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        n, t = total.get(k, (0, 0))
        total[k] = n, t = n + 1, t + (v or 0)
        assert (k, i, v, n, t) in x
    assert running(d.where("false"), ["k"], ["i"], "v").collect() == []


def test_payload_is_trimmed_in_stages(spark):
    rows = [("p", f"f{i}", {"path": f"f{i}", "doc": "x" * 200, "functions": [{"name": "a", "doc": "y" * 100}], "globals": ["g" * 40]}) for i in range(4)] + [(None, "n", {"path": "n", "doc": None, "functions": [], "globals": None})]
    d = spark.createDataFrame(rows, "project string, path string, payload struct<path:string,doc:string,functions:array<struct<name:string,doc:string>>,globals:array<string>>")
    sized = compress.sized(d)
    first = sized.where("path = 'f0'").select("json_size", "bare_size", F.to_json("bare_payload").alias("b")).first()
    assert json.loads(first.b) == {"path": "f0", "functions": [{"name": "a"}]} and first.bare_size < first.json_size - 300
    whole, bare = (4 * x + 10 for x in (first.json_size, first.bare_size))
    sections = [("a", 1), ("b", 2), ("c", 3)]

    def kept(limit):
        r = budget.trimmed(sized, ["project"], ["path"], sections, limit).where("project = 'p'").collect()
        return [x.path for x in sorted(r)], {(x.stage, x.sections_kept) for x in r}, any("doc" in x.payload for x in r)

    names = ["f0", "f1", "f2", "f3"]
    assert kept(whole // 4 + 150) == (names, {(0, 3)}, True)
    assert kept(whole // 4 + 149) == (names, {(1, 2)}, True)
    assert kept(whole // 4 + 99) == (names, {(2, 1)}, True)
    assert kept(bare // 4 + 50) == (names, {(3, 1)}, False)
    assert kept(bare // 4 + 49) == (names[:3], {(4, 1)}, False)
    assert kept(10) == ([], set(), False)
    assert budget.trimmed(sized, ["project"], ["path"], sections, 2000).where("project is null").count() == 1


def test_a_registered_parser(spark, monkeypatch):
    class Upper:
        def supports(self, ending):
            return ending == ".up"

        def parse(self, text, ending):
            return {"functions": [], "global_variables": [w for w in text.split() if w.isupper()]}

    monkeypatch.setattr(structure, "PARSERS", [])
    structure.register(Upper())
    d = spark.createDataFrame([("p", "a.up", None, b"A b C"), ("p", "a.rs", None, b"fn f() {}")], "project string, path string, language string, content binary")
    got = {r.path: r for r in structure.parse(d).collect()}
    assert got["a.up"].global_variables == ["A", "C"] and got["a.rs"].functions[0].name == "f"


def test_calls_of_services(monkeypatch):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            seen.append((self.path, body, dict(self.headers)))
            out = {"/chat": {"choices": [{"message": {"content": "c"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}}, "/messages": {"content": [{"text": "a"}, {"text": "b"}], "usage": {"input_tokens": 1, "output_tokens": 2}, "stop_reason": "end"}, "/local": {"response": "l", "eval_count": 5}}[self.path]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    conf = config.Model(tier="api", model_name="m", api_key_env="SILT_KEY")
    with pytest.raises(OSError):
        model.generate("s", "u", conf, model.chat_call(base + "/chat"))
    monkeypatch.setenv("SILT_KEY", "k")
    got = [model.generate("s", "u", conf, c) for c in (model.chat_call(base + "/chat"), model.messages_call(base + "/messages", "1"), model.local_call(base + "/local"))]
    server.shutdown()
    server.server_close()
    assert [(r.content, r.output_tokens, r.finish_reason) for r in got] == [("c", 4, "stop"), ("ab", 2, "end"), ("l", 5, "stop")] and all(r.latency_ms > 0 for r in got)
    assert seen[0][1]["messages"][1] == {"role": "user", "content": "u"} and seen[1][1]["system"] == "s" and not seen[2][1]["stream"]
    with pytest.raises(ConnectionError):
        model.generate("s", "u", conf, model.local_call(base + "/local", 2))


def test_small_accessors(spark):
    d = spark.createDataFrame([("a", "created"), ("b", "affected"), ("c", "unchanged")], "path string, change_type string")
    assert diff.total_changes(d) == 1 and [r.path for r in diff.affected_paths(d).collect()] == ["b"] and scan.file_of(d, "c").count() == 1
    r = spark.sql("select timestamp'2025-01-02 03:04:05.678' as t, 0.256D as s").select(T.display_time(F.col("t")).alias("a"), T.percent(F.col("s")).alias("b"), T.one_place(F.col("s")).alias("c")).first()
    assert tuple(r) == ("2025-01-02T03:04:05", "26%", "0.3")
