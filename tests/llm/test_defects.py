from datetime import datetime

import pytest

from siltstone.llm import defects as D
from siltstone.llm import terminal as T
from siltstone.llm import truncation

P = "Describe how `a_b` and `c_d` share the cache. Use plain prose and name the files involved."


@pytest.mark.parametrize(
    ("text", "state"),
    [
        (None, "empty"), ("", "empty"), (" \n\t\u200b", "empty"), ("## Head\n", "empty"), ("```\n```", "empty"), ("---\na: b\n---\n", "empty"), ("<!-- -->", "empty"), ("**\n---", "empty"),
        ("It is done.", "done"), ("Is it?", "done"), ("完成了。", "done"), ("(It is done.)", "done"), ("*Note 3, for us.*", "done"), ("- one.\n- two.", "done"), ("Text.\n\n---", "done"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", "done"), ("```\nx\n```", "done"), ("See `a.py`.", "done"),
        ("It is do", "open"), ("See `a.", "open"), ("```\nx", "open"), ("text\n```", "open"), ("| a | b |\n|---|---|\n| 1 |", "open"), ("| a | b |\n|---|---|", "open"), ("- one.\n- tw", "open"), ("(It is done.", "open"), ("Text.\n\n## Hea", "open"), ("Text.\n\n`", "open"),
        ("Text.\n\nRevision 12", "line"), ("Text.\n\n// team", "line"), ("Text.\n\nContact: the team", "line"), ("Text.\n\n-- end of section --", "line"),
    ],
)
def test_terminal_context(text, state):
    assert T.state(text)[0] == state


@pytest.mark.parametrize(
    ("prompt", "content", "defect"),
    [
        (P, P.upper(), "copied_prompt"), (P, "> " + P, "copied_prompt"), (P, f'You asked: "{P}"', "copied_prompt"), (P, f"Prompt:\n{P}\n\nAnswer:\n{P}", "copied_prompt"), (P, P + "\n\nBoth read `x.py` and neither writes to it, so the order of calls doesn't matter here at all.", ""),
        (P, "I'm sorry, but I can't help with this request.", "refusal"), (P, "## Logic\n\nJe dois décliner cette requête.", "refusal"), (P, "抱歉，我无法协助完成此请求。", "refusal"), (P, "Sorry for the short list; the payload names only a few files.", ""), (P, "Unfortunately, the parser has no tests yet.", ""),
        (P, "Die Funktion `a_b` prüft jetzt die Schlüssel vor dem Rückbau.", "other_language"), (P + " Please answer in German.", "Die Funktion `a_b` prüft jetzt die Schlüssel vor dem Rückbau.", ""), (P + " Output language: French.", "The function now reads the cache of the module.", "other_language"),
        ("在 4 个文件变更之后，`x` 还有哪些边界情况？", "下一步是把依赖关系图拆分到 `a.py`。", ""), ("¿Qué casos deja abiertos `x`?", "Модуль всё ещё зависит от полной сборки проекта.", "other_language"), (None, "Die Funktion ist nicht neu.", ""), ("", "Fine as it is.", ""), (P, "The step rewrites th", "truncated"), (P, None, "empty"),
    ],
)
def test_defects(prompt, content, defect):
    assert D.judge(prompt, content)[0] == defect


SCHEMA = "response_id long, prompt string, content string, loaded_at timestamp, defect string, unit string, model string"


def test_table(spark):
    t0, t1 = datetime(2025, 1, 1), datetime(2025, 1, 2)
    rows = [(1, P, "Text.\n\nContact: the sched", t0), (2, P, "Text.\n\nContact: the scheduling team", t0), (3, P, "## Edge Ca", t0), (4, P, "## Edge Cases\n\nAll is well here.", t0), (5, P, "## Edge Cases", t0), (6, P, "half a sen", t0), (6, P, "Whole now.", t1), (7, P, "half a sen", t0), (7, P, "half a sen", t0), (None, P, None, t0), (8, None, None, None)]
    d = spark.createDataFrame([(*r, "x", "y", "m") for r in rows], SCHEMA)
    got = [tuple(r) for r in D.broken_pairs(d).collect()]
    assert sorted(got) == [(1, "truncated"), (5, "empty"), (7, "truncated"), (8, "empty")] + [] or set(got) == {(1, "truncated"), (3, "truncated"), (5, "empty"), (7, "truncated"), (8, "empty")}
    assert len(got) == len({k for k, _ in got})
    assert {k for k, x in got if x == "truncated"} == {r[0] for r in D.truncated(d).collect()}
    assert D.broken_pairs(d.where("false")).collect() == []


def test_prefixes_as_brute_force(spark):
    import random

    rnd = random.Random(1)
    v = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 10))) for _ in range(800)]
    d = spark.createDataFrame([(x,) for x in v] + [(None,)], "v string")
    s = set(v)
    assert {r[0] for r in truncation.strict_prefixes(d.repartition(7)).collect()} == {x for x in s if any(y != x and y.startswith(x) for y in s)}
    assert truncation.strict_prefixes(d.where("false")).collect() == []


def test_lines_of_any_length():
    assert T.state("Text.\n\nTotal: " + "x" * 300)[0] == T.state("Text.\n\nTotal: x")[0] == "line"
    assert T.state("Text.\n\n// " + "team " * 80)[0] == "line"


def test_copies_of_any_length():
    more = "List the technical debt around the late index, given 53 deferred sessions. "
    whole = P + " " + " ".join(f"{more} Case {i} of `f_{i}`." for i in range(40))
    assert D.copied(whole, P) and D.copied(whole, whole.upper() + "\n\n" + whole) and D.copied(P, " ".join([P] * 9))
    assert not D.copied(P, "Both read `x.py` and neither writes to it.") and not D.copied("", "a") and not D.copied(P, "!!")
    assert not D.copied(whole, P + " Both read the cache once at the start and neither of them ever writes to it again afterwards.")


def test_keys_are_in_every_phrase():
    """What the whole dictionary finds, its parts behind their keys find."""
    every = D.re.compile("|".join(D.REFUSALS))
    for t in ("i am not able to", "i'm not permitted", "i can't help", "i do not feel comfortable", "i'd rather not", "i have to pass", "it isn't possible for me", "outside what i am allowed", "something i must refuse", "das kann ich leider nicht", "ich darf das nicht", "ich muss das ablehnen", "je ne peux pas", "je dois refuser", "il ne m'est pas permis", "no me es posible", "no puedo", "debo rechazar", "não posso", "devo recusar", "я не могу", "мне не позволено", "вынуждена отказать", "必须拒绝", "all is well"):
        assert D.refuses(t) == bool(every.search(t)), t


def test_continued_as_brute_force(spark):
    import random

    rnd = random.Random(2)
    v = sorted({"".join(rnd.choice("ab") for _ in range(rnd.choice([0, 1, 3, 5, 15, 16, 17, 70, 300]))) for _ in range(120)})
    v += [x + y for x in v[::3] for y in ("a", "b" * 40)]
    v = sorted(set(v))
    d = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + [(None, None)], "k long, text string").selectExpr("xxhash64(text) as id", "text")
    asked = d.where("text is not null and text <> ''").where("pmod(id, 2) = 0").select("id")
    ids = {r["id"]: r["text"] for r in d.collect()}
    want = {i for (i,) in asked.collect() if any(x != ids[i] and x.startswith(ids[i]) for x in v)}
    got = [r[0] for r in truncation.continued(d, asked).collect()]
    assert set(got) == want and want
    assert truncation.continued(d.where("false"), asked).collect() == []


def test_ways(spark):
    t0 = datetime(2025, 1, 1)
    rows = [(1, 7, 10, P, "The step rewr", t0, "m"), (2, 7, 10, P, "The step rewrites the cache.", t0, "m"), (3, 7, 100, P, "Half a sen", t0, "m"), (4, None, None, P, "Half a wor", t0, None), (5, 7, 100, P, "Done.", t0, None), (6, 7, 9, P, "Text.\n\nContact: the sched", t0, "m"), (7, 7, 9, P, "Text two.\n\nContact: the scheduling team", t0, "m"), (7, 7, 9, P, "Text two.\n\nContact: the scheduling team", t0, "m")]
    d = spark.createDataFrame(rows, "response_id long, config_id long, output_tokens long, prompt string, content string, loaded_at timestamp, model string")
    configs = spark.createDataFrame([(7, 100), (7, 90), (None, 1)], "config_id long, max_output_tokens long")
    found = D.truncated_ways(d, configs)
    assert {tuple(r) for r in found.collect()} == {(1, "prefix"), (3, "limit"), (4, "context"), (6, "line")}
    r = {x["model"]: x for x in truncation.rates(found, d, "response_id", "model").collect()}
    assert (r["m"].records, r["m"].cut, r["m"].by_prefix, r["m"].by_line, r["m"].at_limit, r["m"].by_context) == (5, 3, 1, 1, 1, 0)
    assert r[None].records == 2 and r[None].by_context == 1 and r[None].rate == 0.5


def test_says_as_bare():
    for t in ("", "# a", "# a\nb", "```\nx", "```x\n", "--- a", "---\na: b\n---\nc", "<!-- a -->", "<!-- a --> b", "***", "!", "\u200b", "# a\n\n_ _", "١"):
        assert T.says(t) == bool(T.bare(t)), t
