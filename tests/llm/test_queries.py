"""The queries of this subpackage over the smallest of the driver's tables."""

from pathlib import Path

import pytest

from siltstone.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")
COLUMNS = {
    "p1_found": ["section_a", "section_b"], "p2_found": ["file_id"], "p3_found": ["response_id"], "p5_found": ["file_id", "line_start", "name"],
    "p6_found": ["file_id"], "p7_found": ["response_id", "defect"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_a", "doc_b"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert len(rows) == len(set(rows)) and (rows or name == "p6_json")


def test_look_alikes_as_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = {tuple(r) for r in c.execute(queries.SQL["p10_found"]).fetchall()}
    assert {tuple(r) for r in queries.QUERIES["p10_found"](spark, str(DATA)).collect()} == want


def test_nothing_else_imports_this_subpackage():
    root = Path(queries.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "siltstone.llm" not in p.read_text(encoding="utf-8"), p
