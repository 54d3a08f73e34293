"""The fuzzy merge: its bounds lose nothing, and the registered queries use them over every section."""

import difflib
import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from siltstone.operators import merge
from siltstone.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


def near(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def changed(rnd, text, share, words):
    return "".join(rnd.choice(words) if rnd.random() < share else c for c in text)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85])
def test_the_bounds_lose_no_pair(threshold):
    rnd = random.Random(5)
    texts = ["", "a", "ab", "aaaa" * 80, "aaab" * 75]
    for size, words in ((30, "ab"), (150, "abcdef "), (199, "etaoin "), (200, "etaoin "), (420, "etaoinshrdlu QXZ")):
        base = "".join(rnd.choice(words) for _ in range(size))
        texts += [base, base[size // 8 :], base[: size // 2] + "#" * (size // 9) + base[size // 2 :], base[::-1]]
        texts += [changed(rnd, base, s, words) for s in (0.02, 0.1, 0.16, 0.3)]
    texts = list(dict.fromkeys(texts))
    all_of = np.arange(len(texts))
    got = {(i, j): r for i, j, r in merge.similar(texts, [(all_of, all_of)], lambda i, j: True, threshold)}
    want = {(i, j): r for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and (r := near(a, b)) > threshold}
    assert got == want and len(want) > 20


def _groups():
    last = {}
    for r in pq.read_table(DATA / "sections.parquet").to_pylist():
        k = (r["loaded_at"], r["project"], r["doc_ord"], r["sec_ord"], r["doc_id"], r["heading"], r["content"])
        if r["section_key"] not in last or k > last[r["section_key"]][0]:
            last[r["section_key"]] = k, r
    out = defaultdict(list)
    for _, r in last.values():
        out[r["project"], r["section_id"] or r["heading"].lower()].append(r)
    return {k: sorted(v, key=lambda r: (r["doc_ord"], r["sec_ord"])) for k, v in out.items()}


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("block", [1000, 1])
def test_registered_pairs_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(merge, "BLOCK", block)
    want = {(*g, x, y) for g, v in _groups().items() for i, a in enumerate(v) for b in v[i + 1 :] if (x := a["content"]) != (y := b["content"]) and near(x, y) > 0.85}
    text = {(*g, r["doc_ord"], r["sec_ord"]): r["content"] for g, v in _groups().items() for r in v}
    got = [(r.project, r.group_key, text[r.project, r.group_key, r.doc_a, r.sec_a], text[r.project, r.group_key, r.doc_b, r.sec_b]) for r in catalogue.QUERIES["q24_similar_pairs"](spark, str(DATA)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_registered_merge_drops_similar_versions(spark):
    strategies = {g: "latest" if all(near(r["content"], v[-1]["content"]) > 0.85 for r in v[:-1]) else "accumulated" for g, v in _groups().items()}
    got = {(r.project, r.group_key): r for r in catalogue.QUERIES["q25_fuzzy_merge"](spark, str(DATA)).collect()}
    assert {k: r.strategy for k, r in got.items()} == strategies
    equal = {(r.project, r.group_key): r.content_md5 for r in catalogue.QUERIES["q25_merge_strategy"](spark, str(DATA)).collect()}
    assert any(r.content_md5 != equal[k] for k, r in got.items())
