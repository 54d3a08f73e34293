from datetime import datetime, timedelta
from pathlib import Path

from siltstone import cli, config, model

MAIN = '''"""Main."""
from src.utils import helper


def main(a: int) -> int:
    return helper(a)
'''


def test_a_project_from_first_scan_to_merge(spark, tmp_path):
    root = Path(tmp_path) / "demo"
    (root / "src").mkdir(parents=True)
    (root / "src/main.py").write_text(MAIN)
    (root / "src/utils.py").write_text("def helper(x):\n    return x\n")
    conf = config.init_project(root)
    t = datetime(2025, 1, 1)

    def run(i):
        return cli.Pipeline(spark, str(root), conf, t + timedelta(minutes=i))

    def echo(system, user, m):
        return model.Response(user)

    assert run(0).changes() is None and run(0).generate(dry_run=True) is None
    assert run(0).generate() == "pd_001"
    assert run(1).generate() is None
    (root / "src/utils.py").write_text("def helper(x):\n    return x\n\n")
    # Trivial: held back until there are enough, or forced.
    assert run(2).generate(auto_flush=True) is None
    assert run(3).store.load_pending("demo").count() == 1
    (root / "src/utils.py").write_text("\n".join(f"def helper{i}(x):\n    return x\n" for i in range(200)))
    p = run(4)
    marked = {r.path: r.change_type for r in p.changes().collect()}
    assert marked == {"src/utils.py": "modified"}
    kind = p.classified(p.changes()).first()
    assert (kind.session_type, kind.affected_nodes_count) == ("major", 1)
    assert p.generate(lambda s, u, m: model.Response("# x\n" + "see `zz/none.py` " * 5), auto_flush=True, only_changed=True) == "pd_002"
    assert {x[0] for x in p.problems} == {"missing_section", "hallucination"} or any("zz/none.py" in str(x) for x in p.problems)
    assert run(5).store.load_pending("demo").count() == 0
    w = {r.category for r in run(6).warnings("# x\n" + "see `zz/none.py` " * 5).collect()}
    assert w == {"missing_section", "hallucination"}
    assert run(6).merge_local().startswith("# Project Documentation (Merged from 2 snapshots)")
    text = run(6).merge_with_model(echo)
    assert "docs_merged: 2" in text and "## Snapshot 2" in text and '"doc_id":"pd_001"' in text


def test_commands(spark, tmp_path, capsys):
    root = str(tmp_path)
    assert cli.main(["--root", root, "version"]) == 0
    assert cli.main(["--root", root, "diff"]) == 1
    assert cli.main(["--root", root, "init", "--preset", "minimal", "--name", "x"]) == 0
    assert cli.main(["--root", root, "init"]) == 1
    assert cli.main(["--root", root, "init", "--preset", "none"]) == 1
    assert config.load_config(root).project.name == "x"
