import random
import unicodedata

import pyarrow as pa

from siltstone.llm import lookalike as L


def plain(s):
    if s is None:
        return None
    alike = {o: x for x, o in zip(L.LATIN, L.OTHER)}
    wide = "".join(unicodedata.normalize("NFKC", c) if unicodedata.decomposition(c).startswith("<wide>") else " " if ord(c) in L.SPACES else "" if ord(c) in L.INVISIBLE else c for c in s)
    return unicodedata.normalize("NFC", "".join(alike.get(c, c) for c in unicodedata.normalize("NFD", wide)))


def test_as_character_by_character():
    rnd = random.Random(1)
    alphabet = "abcéüñ ẞß\n.,АаеоΟοіѕ１ＡｂＣ　\u00a0\u2009\u200b\u00ad\ufeff\u0301\u0308\u0323\u0327한국中①²ﬁ😀ёй"
    texts = [None, "", "\u200b", *["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]]
    got = L.normalise(pa.array(texts)).to_pylist()
    assert [plain(a) for a in texts] == got
    assert L.normalise(pa.array(["x", None])[1:]).to_pylist() == [None]
    assert L.normalise(pa.array(got)).to_pylist() == got


def test_what_differs_stays_different():
    pairs = ["a A", "e é", "2 ²", "1 ①", ". ,", "o 0", "l I", "fi ﬁ", "n ñ"]
    for p in pairs:
        a, b = p.split()
        x, y = L.normalise(pa.array([a, b])).to_pylist()
        assert x != y


def test_pairs(spark):
    rows = [(1, "café one"), (2, "cafe\u0301 one"), (3, "cafе\u0301\u00a0one"), (4, "cafe one"), (5, "café one"), (6, None), (7, ""), (8, "\u200b"), (9, "Ａ"), (10, "A"), (9, "Ａ")]
    d = spark.createDataFrame([(*r, "f", "r") for r in rows], "doc_id long, text string, form string, raw string")
    got = [tuple(r) for r in L.look_alike_pairs(d).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(1, 2), (1, 3), (2, 3), (2, 5), (3, 5), (9, 10)}
    classes = {(r.least, r.copies) for r in L.look_alike_classes(d).collect()}
    assert (1, 2) in classes
    assert L.look_alike_pairs(d.where("false")).collect() == []
    assert {r.doc_id: r.form for r in L.normalised(d).collect()}[6] is None


def test_a_third_of_the_rows_alike(spark):
    rows = [(i, "same text") for i in range(50)] + [(100, "same\u00a0text")] + [(200 + i, f"other {i}") for i in range(100)]
    assert L.look_alike_pairs(spark.createDataFrame(rows, "doc_id long, text string")).count() == 50


def test_members_count_the_pairs(spark):
    rows = [(1, "café"), (2, "café"), (3, "café"), (4, "cafe"), (5, "ａb"), (6, "ab"), (7, None), (8, ""), (9, "a​b"), (9, "a​b")]
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, form string, raw string")
    links = {}
    for a, b in L.look_alike_pairs(d).collect():
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    got = {r["doc_id"]: r for r in L.look_alike_members(d).collect()}
    assert set(got) == set(links) == {1, 2, 3, 5, 6, 9}
    assert got[1]["links"] == 2 and got[2]["links"] == 1 and got[1]["class"] == got[3]["class"] == 1 and got[6]["spellings"] == 3
    assert L.look_alike_members(d.where("false")).collect() == []
