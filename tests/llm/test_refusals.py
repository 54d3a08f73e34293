import pytest

from siltstone.llm import defects as D

LONG = "I'm sorry, but I can't help with this request. " + "It would require access to material that I have not been shown. This is outside of what I may use, so I must decline. " * 4 + "Please contact your administrator. Is there anything else I can do?"


@pytest.mark.parametrize(
    ("content", "refusal"),
    [
        (LONG, True),
        (LONG * 6, True),
        ("I'm sorry, but I can't help with this. Both modules read the cache and close it.", False),
        ("I'm sorry, but I can't describe `src/cache.py`. Please contact your administrator.", True),
        ("I cannot provide the following:\n\n- the sections of `a.py`\n- its history\n\nPlease contact your administrator.", True),
        ("Es tut mir leid, aber ich kann `a.py` leider nicht beschreiben.", True),
        ("I can't describe `a.py`, but `b.py` reads the cache and closes it after each call.", False),
        (LONG + " The cache is read by two modules, and both close it after each call.", False),
        ("I cannot provide the history.\n\n- `a.py` reads the cache\n- `b.py` closes it", False),
        ("I can't share the key:\n\n```\nx = 1\n```", False),
        ("`a.py` reads the cache. " * 30, False),
    ],
)
def test_refusals_of_any_length(content, refusal):
    assert D.declines(content) is refusal
