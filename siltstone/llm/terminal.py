"""How a text ends: the terminal context that tells finished texts from texts cut off.

Only the end of the text counts, read with the markup that is open there: a fence, a table
row, a code span, a bracket. What ends in none of them is finished if it ends with a sentence
mark, or with a line of one of the forms that close a note (sign-off, date, contact, total,
revision). Lines of those forms can be cut themselves, and so can a lone heading; for them
state() says "line" and the caller looks for longer lines in the collection.
"""

from __future__ import annotations

import re

EMPTY, OPEN, DONE, LINE = "empty", "open", "done", "line"

FENCE = re.compile(r"^ {0,3}(```+|~~~+)")
FRONT = re.compile(r"\A\s*---[ \t]*\n(?:.*?\n)??---[ \t]*(?:\n|\Z)", re.S)
COMMENT = re.compile(r"<!--.*?-->", re.S)
HEADING = re.compile(r"^ {0,3}#{1,6}(?:\s|$)")
BLANK = re.compile(r"[\s\u200b-\u200d\u2060\ufeff\u00ad]+")
MARKUP = re.compile(r"[#*_`~>|\-=+:.\\/<>()\[\]{}\"']+")
#: A sentence mark, and what may follow it on the same sentence.
FINISHED = re.compile(r"[.!?…。！？｡](?:[)\]}\"'”’»」』）*_`]*|</\w+>)\Z")
#: Forms of closing lines: remarks after a comment mark or a label, dates, counted totals, framed words.
CLOSING = [
    re.compile(p)
    for p in (
        r"(?://|--|#|;|%) ?\S.*",
        r"[A-Z][\w'-]*(?:[ -][\w'-]+){0,3}: ?\S+(?: \S+){0,4}",
        r"(?:Signed(?: off)?|Reviewed|Approved|Written|Prepared|Revision|Version|Page|Total|TOTAL|Kind regards|Regards|Best|End of)\b.*",
        r"(?:Next|Last) [a-z]+\b[^,]*",
        r"\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d.*)?",
        r"(?:\*\*?|__?)[^*_].*(?:\*\*?|__?)",
    )
]
RULE = re.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
LIST = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s")


def masked(line: str) -> str:
    """A line by its words: runs of digits are one 0, code spans one pair of marks."""
    return re.sub(r"\d+", "0", re.sub(r"`[^`]*`", "``", line.strip()))


def bare(text: str) -> str:
    """What is left without front matter, comments, headings, fences, blanks and markup."""
    t = COMMENT.sub("", FRONT.sub("", text, count=1))
    lines = [x for x in t.split("\n") if not HEADING.match(x) and not FENCE.match(x)]
    return MARKUP.sub("", BLANK.sub("", "".join(lines)))


_LETTER = re.compile(r"[^\W_]")


def says(text: str) -> bool:
    """Whether bare() leaves anything."""
    if "<!--" not in text and not text.lstrip().startswith("---"):
        # A line with a letter or digit is enough.
        for x in text.split("\n"):
            if _LETTER.search(x) and not HEADING.match(x) and not FENCE.match(x):
                return True
    return bool(bare(text))


def state(text: str | None) -> tuple[str, str]:
    """(state, unit): the unit is the last line, "" where no other line may continue it.

    A text without content is empty; if it is a lone heading, the heading is its unit.
    """
    if text is None or not says(text):
        lines = [x for x in (text or "").split("\n") if x.strip()]
        return EMPTY, masked(lines[-1]) if len(lines) == 1 and HEADING.match(lines[-1]) else ""
    text = text.rstrip()
    lines = text.split("\n")
    fence, start = "", 0
    for i, x in enumerate(lines):
        if (m := FENCE.match(x)) and (not fence or x.strip().startswith(fence) and not x.strip().strip("`~")):
            fence = "" if fence else m[1]
            start = i + 1
    last = lines[-1]
    if fence:
        return OPEN, masked(last)
    if start == len(lines):
        return DONE, ""
    if last.lstrip().startswith("|"):
        return _table(lines), masked(last)
    if HEADING.match(last):
        return OPEN, masked(last)
    if RULE.match(last):
        return DONE, ""
    block = []
    for x in reversed(lines[start:]):
        if not x.strip() or x.lstrip().startswith("|"):
            break
        block.append(x)
    block = "\n".join(reversed(block))
    if block.count("`") % 2:
        return OPEN, masked(last)
    words = re.sub(r"`[^`]*`", "", block)
    if words.startswith("(") and words.count("(") > words.count(")"):
        return OPEN, masked(last)
    if FINISHED.search(text):
        if re.match(r"(\*\*?|__?)[^\s*_]", words) and not re.search(r"[*_]\Z", words) and words.count("*") % 2:
            return OPEN, masked(last)
        return DONE, masked(last)
    if not LIST.match(last) and any(p.fullmatch(last.strip()) for p in CLOSING):
        return LINE, masked(last)
    return OPEN, masked(last)


def _table(lines: list[str]) -> str:
    rows = []
    for x in reversed(lines):
        if not x.lstrip().startswith("|"):
            break
        rows.append(x.strip())
    rows.reverse()
    cells = [len(re.split(r"(?<!\\)\|", re.sub(r"`[^`]*`", "x", x))) for x in rows]
    body = [x for x in rows[1:] if not re.fullmatch(r"[|:\-\s]+", x)]
    if len(rows) > 1 and not body or len(rows) == 1 and len(lines) > 1 and lines[-2].strip() == "" and cells[0] > 2:
        return OPEN
    return DONE if rows[-1].endswith("|") and len(rows[-1]) > 1 and cells[-1] == cells[0] and rows[-1].count("`") % 2 == 0 else OPEN
