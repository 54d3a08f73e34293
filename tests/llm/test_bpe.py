import random
from pathlib import Path

import pytest

from siltstone.llm import bpe

PATH = bpe.vocabulary_path()
pytestmark = pytest.mark.skipif(not Path(PATH).exists(), reason="no vocabulary files here")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def texts():
    rnd = random.Random(1)
    alphabet = "aaeettooinnshrdlu  \n\té中文😀0123.,'-_<|>"
    yield from ("", " ", "\n\n", "<|endoftext|>", "don't", "a" * 500, "ab" * 300, " " * 40, "١٢٣", "x" * 3 + "\u200b" + "é")
    for _ in range(800):
        yield "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
    yield "".join(rnd.choice("etaoin") for _ in range(20_000))


def test_as_reference(reference):
    enc = bpe.encoder(Path(PATH).read_bytes())
    for x in texts():
        assert enc.encode(x) == reference(x)
    assert enc.encode(None) == []


def test_appends_and_edits():
    v = bpe.vocabulary(Path(PATH).read_bytes())
    rnd = random.Random(2)
    for _ in range(60):
        p = bpe.Prefixes(v)
        for _ in range(5):
            p.append(bytes(rnd.choice(b"abcdet ") for _ in range(rnd.randint(0, 12))))
            i, j = sorted(rnd.randint(0, len(p.bytes)) for _ in "ab")
            p.edit(i, j, bytes(rnd.choice(b"xyzing") for _ in range(rnd.randint(0, 5))))
            assert p.ids() == bpe.Prefixes(v, bytes(p.bytes)).ids()
            assert b"".join(v.token[t] for t in p.ids()) == bytes(p.bytes)


def test_table(spark):
    d = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode(d).collect())
    assert got == [(1, [31373, 995]), (2, []), (3, []), (3, [])]
    assert sorted(r.n_tokens for r in bpe.sizes(d).collect()) == [0, 0, 0, 2]
    assert bpe.encode(d.where("false")).collect() == []
