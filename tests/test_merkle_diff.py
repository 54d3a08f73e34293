import random
from datetime import datetime, timedelta

import pytest

from siltstone.operators import merkle_diff as M

ROWS = "snapshot_id string, path string, hash string, size long, lines long, loaded_at timestamp, leaf string"
HEADS = "snapshot_id string, checkout_id long, taken_at timestamp, path string"
T0 = datetime(2025, 1, 1)


def brute(rows, heads):
    live = {}
    for s, p, h, z, n, at, _ in rows:
        if s is None or p is None:
            continue
        p = p.replace("\\", "/")
        while p.startswith("./"):
            p = p[2:].lstrip("/")
        order = (at is not None, at or T0, (h or "").lower(), z is not None, z or 0, n is not None, n or 0)
        if (s, p) not in live or order > live[s, p][0]:
            live[s, p] = (order, (h or "").lower(), z, n)
    by = {}
    for s, c, at, _ in heads:
        by.setdefault(c, []).append((at is not None, at or T0, s))
    out = set()
    for snaps in by.values():
        snaps.sort()
        for (_, _, old), (_, _, new) in zip(snaps, snaps[1:]):
            a = {p: v[1:] for (s, p), v in live.items() if s == old}
            b = {p: v[1:] for (s, p), v in live.items() if s == new}
            for p in a.keys() | b.keys():
                if p not in a or p not in b:
                    out.add((new, p, "added" if p in b else "removed"))
                elif a[p][0] != b[p][0] if a[p][0] and b[p][0] else a[p][1:] != b[p][1:]:
                    out.add((new, p, "changed"))
    return out


@pytest.mark.parametrize("bits", [0, 1, 4, 7, None])
def test_random_snapshots_as_brute_force(spark, bits):
    rnd = random.Random(bits or 99)
    heads = [(f"s{c}_{i}", c, None if i == 0 and c == 1 else T0 + timedelta(days=i), "x") for c in range(3) for i in range(4)]
    rows = []
    for s, *_ in heads:
        for _ in range(rnd.randint(0, 40)):
            p = rnd.choice([None, "./", "", ""]) or ""
            path = None if rnd.random() < 0.03 else p + rnd.choice("abcdef") + rnd.choice("/\\") + rnd.choice("xyz")
            rows.append((s, path, rnd.choice([None, "", "AA", "aa", "bb"]), rnd.choice([None, 1, 2]), rnd.choice([None, 1, 2]), rnd.choice([None, T0, T0 + timedelta(hours=1)]), "z"))
    rows += rows[:5]
    found = M.snapshot_changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(heads, HEADS), bits).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == brute(rows, heads)


def test_empty_tables_and_no_header(spark):
    none = spark.createDataFrame([], ROWS)
    assert M.snapshot_changes(none, spark.createDataFrame([], HEADS)).collect() == []
    one = spark.createDataFrame([("s", "a", "h", 1, 1, T0, "")], ROWS)
    assert M.snapshot_changes(one, spark.createDataFrame([("s", 1, T0, "")], HEADS)).collect() == []
    assert M.snapshot_changes(one, spark.createDataFrame([], HEADS)).collect() == []


def test_only_differing_ranges_are_named(spark):
    rows = [(s, f"p{i}", f"h{i}" if s == "a" or i != 7 else "new", 1, 1, T0, "") for s in "ab" for i in range(200)]
    order = M.ordered(spark.createDataFrame([("a", 1, T0, ""), ("b", 1, T0 + timedelta(days=1), "")], HEADS))
    live = M._placed(spark.createDataFrame(rows, ROWS), order, 6, True)
    assert len(M.changed_leaves(live, order, 6, True).collect()) == 1


def test_headers_that_are_not_broadcast(spark):
    rows = [(f"s{i}", f"p{j}", str(i // 2), 1, 1, T0, "") for i in range(5) for j in range(3)]
    heads = [(f"s{i}", 1, T0 + timedelta(days=i), "") for i in range(5)]
    got = M.snapshot_changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(heads, HEADS), 2, broadcast_headers=0).collect()
    assert {tuple(r) for r in got} == brute(rows, heads)


def test_depth():
    assert [M.leaf_bits_for(n, 1) for n in (0, 4, 8, 4096)] == [0, 0, 1, 10]
    assert M.leaf_bits_for(10**12, 10**9) == 20
