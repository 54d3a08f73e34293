import random
from datetime import datetime

import pytest

from siltstone.llm import handwritten as H

BODY = b"import os\n\ndef f(a):\n    for x in a:\n        print(x)\n    return a\n" * 6


@pytest.mark.parametrize(
    ("text", "sort"),
    [
        (b"# Code generated by x v1. DO NOT EDIT.\n" + BODY, "gen"), (b"/*\n * This file was automatically\n * generated by x\n */\nint a;", "gen"), (b"// @generated\nx", "gen"), (b"# Dieses Modul wurde von x erzeugt. Nicht von Hand bearbeiten.\n", "gen"),
        (b"// @preserve lib 1.2.3\nx", "lib"), (b"/*\n * Upstream release: a 0.1.2\n */\nx", "lib"), (b"// a v1.0.0 | MIT License | (c) 2019 x\n", "lib"),
        (b'HEADER = "// Code generated by x. DO NOT EDIT."\n', ""), (b"// SPDX-License-Identifier: MIT\n// Part of ours.\nx", ""), (b"x = 1\n# @generated\n", ""), (b"#include <generated by me.h>\n", ""), (b"", ""),
    ],
)
def test_heads(text, sort):
    assert H.label(text) == sort


def test_shapes():
    assert H.shape(b"var a=function(e,t){return e.x+t*2};" * 30) == "min"
    assert H.shape(b"X = [\n" + b"    0x1f, 0x2a, 0x3c, 0x4d,\n" * 30 + b"]\n") == "data"
    assert H.shape(b"T = [\n" + b'    ["tariff", 3019, 23.15], ["tide", 1, 2.5],\n' * 12 + b"];\n") == "data"
    assert H.shape(b'"""' + b"One, two, three and so on, and on. " * 20 + b'"""\n') == ""
    assert H.shape(b"".join(b'F_%d = field("abc_%d", number=%d)\n' % (i, i, i) for i in range(20))) == "list"
    assert H.shape(BODY) == "" and H.shape(b"") == ""
    assert H.shape(BODY + b'labels = ["' + b'", "'.join(b"the label of %d" % i for i in range(40)) + b'"]\n') == ""


def test_scores_are_those_of_the_sparse_rows():
    rnd = random.Random(1)
    w = H.np.array([rnd.gauss(0, 1) for _ in range(4 << H.BITS)], H.np.float32)
    m = H.Model(w.reshape(4, -1), 0.5, 0.25)
    contents, paths = [b"", b"a", b"abcdefg", b"# head 1\n" + BODY, b"abc", b"// x\n" + BODY * 100, b"# only a head\n"], [None, "a.py", "x/y/z_pb2.py", "", "q\\r.min.js", "a/b.c", "a.rs"]
    scores, bodies = m.scores(contents, paths)
    for got, c, p, body in zip(scores, contents, paths, bodies):
        assert c.endswith(body)
        ids, values, _ = H.sparse(c, p)
        assert abs(got - (w[ids] @ values + 0.5 - 0.25)) < 1e-2


def test_masked_bodies():
    assert H.form(b"def ab_1(x2): return 0x1F + 3.5\n") == b"w w(w): w 0 + 0\n"


def test_table(spark):
    t0, t1 = datetime(2025, 1, 1), datetime(2025, 1, 2)
    rows = [(i, f"proj{i % 7}", f"src/m{i}/file{i}.py", b"# c\nimport a%d\n\ndef f%d(x):\n    return x + %d\n" % (i, i, i) * 4, ".py", t0) for i in range(60)]
    rows += [(100 + i, f"proj{i % 7}", f"vendor/lib{i}/m.py", b"# @preserve lib 1.0.0\nq%d = 1\n" % i + BODY, ".py", t0) for i in range(30)]
    rows += [(200, "a", "vendor/x/one.py", b"# @preserve lib 1.0.0\n" + BODY, ".py", t0), (201, "b", "src/m1/file1.py", BODY.replace(b"\n", b"\r\n"), ".py", t0), (202, "a", "n.py", None, ".py", t0), (203, "a", "e.py", b"", ".py", t0), (204, None, None, b"# @preserve lib 1.0.0\nq77 = 1\n" + BODY, ".py", None), (205, "a", "m.md", b"# @generated\n", ".md", t0), (None, "a", "g.py", b"# @generated\n", ".py", t0), (206, "a", "vendor/h.py", b"# @preserve lib 1.0.0\n" + BODY, ".py", t0), (206, "a", "src/m2/file2.py", rows[2][3] + b"\n", ".py", t1)]
    # A short body that many write: one of them in a third-party folder doesn't take the others along.
    rows += [(300 + i, f"proj{i % 7}", f"src/m{i}/one.py", b"import a\n", ".py", t0) for i in range(6)] + [(310, "a", "vendor/lib3/m.py", b"# @preserve lib 1.0.0\nimport a\n", ".py", t0)]
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], "file_id long, project string, path string, content binary, extension string, scanned_at timestamp, body string, sort string")
    got = [r[0] for r in H.not_handwritten(d).collect()]
    assert len(got) == len(set(got))
    assert {100 + i for i in range(30)} | {200, 201, 204} <= set(got)
    assert not {202, 203, 205, 206, *range(300, 306)} & set(got) and not set(range(60)) & set(got)
    ways = {r["file_id"]: r["way"] for r in H.found(d).collect()}
    assert ways[100] == ways[200] == "margin" and ways[201] in ("copy", "margin")
    assert H.not_handwritten(d.where("false")).collect() == []
    assert {r["head"] for r in H.measures(d).collect()} == {"seen", "masked"}
    assert sum(r["files"] for r in H.ways(d).collect()) == len(got)
