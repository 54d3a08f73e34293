"""Ignore and include patterns with the syntax of git, as regular expressions made once on the driver."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression on a relative path, whether it excludes); None for blanks and comments.

    A pattern with a slash before its end is bound to the root, others match at any depth; a
    final slash asks for a folder; ** crosses folders, * and ? don't. There is no brace expansion.
    """
    p = pattern.rstrip("\n")
    p = re.sub(r"(?<!\\) +$", "", p)
    if not p or p.startswith("#"):
        return None
    takes = not p.startswith("!")
    p = p[1:] if not takes else p
    folder = p.endswith("/")
    p = p.rstrip("/")
    bound = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out += "(?:.*/)?"
            i += 3
        elif p.startswith("**", i) and i + 2 == len(p) and (i == 0 or p[i - 1] == "/"):
            out += ".+"
            i += 2
        elif c == "*":
            out += "[^/]*"
            while p.startswith("*", i):
                i += 1
        elif c == "?":
            out += "[^/]"
            i += 1
        elif c == "[" and (end := p.find("]", i + 2)) > 0:
            inside = p[i + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + inside[1:] if inside[0] in '!^' else inside}]"
            i = end + 1
        elif c == "\\" and i + 1 < len(p):
            out += re.escape(p[i + 1])
            i += 2
        else:
            out += re.escape(c)
            i += 1
    # What is below a matched folder is matched as well.
    return f"^{'' if bound else '(?:.*/)?'}{out}{'/.+' if folder else '(?:/.*)?'}$", takes


def matched(path: Column, patterns: Sequence[str]) -> Column:
    """Whether the last pattern that matches takes the path; false if none matches."""
    out = F.lit(False)
    for r in (to_regex(p) for p in patterns):
        if r is not None:
            out = F.when(path.rlike(r[0]), F.lit(r[1])).otherwise(out)
    return out


def selected(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Excluded paths are left out before included ones are taken; no include pattern takes all."""
    keep = ~matched(path, exclude)
    return keep & matched(path, include) if include else keep


def read_ignore_file(path: str) -> list[str]:
    try:
        with open(path, encoding="utf-8") as f:
            return [x.strip() for x in f if x.strip() and not x.strip().startswith("#")]
    except OSError:
        return []
