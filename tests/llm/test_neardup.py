import random
from datetime import datetime

from siltstone.llm import neardup as N

SCHEMA = "section_key long, heading string, content string, loaded_at timestamp, cid string, a string, text string"
T0, T1 = datetime(2025, 1, 1), datetime(2025, 1, 2)


def rows_of(rnd, n):
    vocab = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(vocab) for _ in range(60)] for _ in range(n // 4)]
    rows = []
    for k in range(n):
        x = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 3, 6, 12])):
            x[rnd.randrange(len(x))] = rnd.choice(vocab)
        if rnd.random() < 0.3:
            rnd.shuffle(x)
        rows.append((k, " ".join(x[:2]).upper(), " ".join(x[2:]), T0, "x", "y", "z"))
    return rows


def brute(rows, threshold):
    last = {}
    for r in rows:
        if r[0] is not None and (r[0] not in last or (r[3] or T0) >= (last[r[0]][3] or T0)):
            last[r[0]] = r
    t = {k: "\n".join(x for x in r[1:3] if x is not None) for k, r in last.items()}
    keys = sorted(t)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if N.similarity(t[a], t[b]) >= threshold}


def test_pairs_as_brute_force(spark):
    rows = rows_of(random.Random(1), 200)
    rows += [(900, None, None, T0, "", "", ""), (901, "", "...", T0, "", "", ""), (None, "a", "b", T0, "", "", ""), (902, "One Two", None, None, "", "", ""), (903, None, "two one", T0, "", "", "")]
    rows += rows[:20]
    # A later delivery with another text holds.
    rows.append((0, "entirely", "different words here", T1, "", "", ""))
    want = brute(rows, 0.85)
    near = {(a, b) for a, b in brute(rows, 0.75) if (a, b) not in want}
    got = [tuple(r) for r in N.near_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    assert want <= set(got) <= want | near
    assert (902, 903) in got and not any(k in (900, 901) for p in got for k in p)


def test_a_third_equal_texts_form_one_class(spark):
    rows = [(i, "same", "one two three four", T0, "", "", "") for i in range(60)] + rows_of(random.Random(2), 120)[60:]
    member, near = N.near_classes(spark.createDataFrame(rows, SCHEMA), "section_key", ["heading", "content"], "loaded_at")
    hot = member.groupBy("cid").count().where("count >= 60").collect()
    assert len(hot) == 1 and hot[0]["count"] == 60
    assert near.where("a >= b").count() == 0


def test_empty_table_and_long_text(spark):
    assert N.near_pairs(spark.createDataFrame([], SCHEMA)).collect() == []
    long = " ".join(f"t{i}" for i in range(50_000))
    got = N.near_pairs(spark.createDataFrame([(1, "", long, T0, "", "", ""), (2, "x", long + " more", T0, "", "", "")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(1, 2)]


def test_bands():
    for n in (0, 1000, 300_000, 10**7, 10**10):
        b = N.banding(n)
        assert 1 - (1 - 0.8**b.rows) ** b.bands >= 0.99 and b.bands * n * 0.22**b.rows <= 20_000
        assert len(set(b.sketches()[0]) | set(b.sketches()[1])) == 128
    assert (N.banding(200_000).rows, N.banding(200_000).bands) == (6, 18)
    assert abs(N.similarity("a a b", "a b b") - 0.5) < 1e-9 and N.similarity("", "") == 0


def test_finer_bands_find_the_same(spark):
    d = spark.createDataFrame(rows_of(random.Random(5), 120), SCHEMA)
    a = {tuple(r) for r in N.near_pairs(d).collect()}
    _, near = N.near_classes(d, "section_key", ["heading", "content"], "loaded_at", shape=N.banding(10**8))
    _, base = N.near_classes(d, "section_key", ["heading", "content"], "loaded_at")
    x, y = ({(r.a, r.b) for r in t.where("similarity > 0.87").collect()} for t in (near, base))
    assert x == y and a


def test_earlier_texts_of_a_key_are_in_no_pair(spark):
    """Key 10 i has X, later Y; 10 i + 1 has X, 10 i + 2 has Z; Y and Z are alike, X and Z aren't."""
    rnd = random.Random(8)
    rows = []
    for i in range(10):
        x = [f"g{i}w{rnd.randrange(10**6)}" for _ in range(60)]
        z = x[:44] + [f"g{i}z{j}" for j in range(16)]
        y = z[:-2] + ["new", "end"]
        for k, t, at in ((10 * i, x, T0), (10 * i, y, T1), (10 * i + 1, x, T0), (10 * i + 2, z, T0)):
            rows.append((k, "", " ".join(t), at, "", "", ""))
    want = brute(rows, 0.75)
    assert want == {(10 * i, 10 * i + 2) for i in range(10)}
    assert {tuple(r) for r in N.near_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_without_sketches_and_members(spark):
    rows = rows_of(random.Random(4), 160)
    rows += [(1000 + i, *rows[3][1:]) for i in range(5)]
    d = spark.createDataFrame(rows, SCHEMA)
    pairs = {tuple(r) for r in N.near_pairs(d, sketched=False).collect()}
    assert brute(rows, 0.85) <= pairs <= brute(rows, 0.75)
    links = {}
    for a, b in N.near_pairs(d).collect():
        links[a] = links.get(a, 0) + 1
        links[b] = links.get(b, 0) + 1
    got = N.near_members(d).collect()
    assert {r["section_key"]: r["links"] for r in got} == links
    by = {r["section_key"]: r for r in got}
    assert by[1000]["class"] == by[3]["class"] == min(r["section_key"] for r in got if r["class"] == by[3]["class"]) and by[1000]["copies"] >= 6


def test_class_ids_alone_are_those_of_signatures():
    texts = ["", "a b a", "b A a", "c", "..", "x " * 500 + "y"]
    assert (N.Signer().class_ids(texts) == N.Signer()(texts)[0]).all()
