"""Source files that don't parse: generalised LL over the grammars of all dialects of a file's language.

A file is lexed by one pattern, its bracketed groups and lists are recognised by gll.py, and
it is flagged if every dialect of its extension rejects it. Python blocks, made by
indentation, are sequences of kinds of lines, recognised by a grammar of their own.

The grammars are somewhat wider than their languages, never knowingly narrower.

Defined results: null content is no case, empty content (or blanks and comments only) is
valid except for json; a byte order mark isn't an error; bytes that are no UTF-8 are read as
replacement characters, which are valid in strings and comments only; of several deliveries
of one key the last one counts; a null key is no record; other extensions are no case.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import grammars, nested
from siltstone.llm.common import map_batches
from siltstone.llm.gll import Grammar
from siltstone.llm.grammars import BAD, ID, INDENT0, JSX, KEPT_TOKENS, MOST_INDENT, NUM, STR, columns

#: The dialects of each extension, as grammar and form of text. The grammar of JavaScript is that of scripts and modules
#: at once; "jsx" is a text whose elements are taken apart, "fields" one with f-strings whose fields hold any quotes (nested.py).
_PY = ("python", ""), ("python", "fields")
_JS, _TS = (("javascript", ""), ("javascript", "jsx")), (("typescript", ""),)
DIALECTS = {
    ".py": _PY, ".pyi": _PY, ".js": _JS, ".mjs": _JS, ".cjs": _JS, ".jsx": _JS,
    ".ts": _TS, ".mts": _TS, ".cts": _TS, ".tsx": (*_TS, ("typescript", "jsx")), ".java": (("java", ""),), ".go": (("go", ""),), ".rs": (("rust", ""),),
    ".c": (("c", ""),), ".h": (("c", ""),), ".json": (("json", ""),),
}
LANGUAGE = {e: d[0][0] for e, d in DIALECTS.items()}


_INDENT = re.compile(r"(?<=\n)[ \t\f]+")


@functools.lru_cache(1)
def languages() -> dict[str, grammars.Language]:
    return grammars.languages()


def kinds(lang: grammars.Language, text: str) -> str:
    return "".join(map(lang.kinds.__getitem__, lang.lex(text)))


@functools.lru_cache(8)
def _lines(name: str) -> tuple[re.Pattern, re.Pattern | None]:
    """Line ends that don't count, and those that stand for a semicolon."""
    lang = languages()[name]
    t = lang.tokens
    chars = lambda x: "".join(re.escape(t[k]) for k in x.split() if k in t)
    if lang.newlines == "go":
        return re.compile("\n"), re.compile(f"(?<=[{ID}{NUM}{STR}{chars('break continue fallthrough return ++ -- ) ] }')}])(?:\n+|\\Z)")
    binary = ", . ?. ... ? : => = == === != !== < <= >= * / % ** & | ^ && || ?? << += -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??="
    after = chars(binary + " + - ! ~ ; ( [ { else do extends implements in instanceof typeof new delete void export import const let var await")
    before = chars(binary + " ; ) ] else catch finally instanceof in")
    return re.compile(f"\n(?=\n)|(?<=[{after}])\n+|\n+(?=[{before}])|(?<=\\))\n(?=\\{{)|\\A\n+|\n+\\Z"), None


def forms(lang: grammars.Language, text: str, wanted: tuple[str, ...]) -> list[str]:
    """text in each form of a dialect that it can have, fit for the lexer; the same form once."""
    if lang.newlines == "py":
        out = [text] if "" in wanted else []
        if "fields" in wanted and nested.has_fields(text) and (more := nested.without_fields(text)) is not None:
            out.append(more)
        return [_indents("\n" + x) for x in out]
    if lang.newlines != "asi":
        return [text]
    if JSX in text:
        return []
    out = [text if not nested.has_templates(text) else nested.plain(text, False)] if "" in wanted else []
    if "jsx" in wanted and nested.has_elements(text):
        out.append(nested.plain(text, True))
    return [x for x in out if x is not None]


def _indents(text: str) -> str:
    """text with the indents of its lines ranked if one is too wide for a character of its own."""
    if len(text) <= MOST_INDENT // 8 or max((columns(x) for x in _INDENT.findall(text)), default=0) <= MOST_INDENT:
        return text
    rank = {w: i for i, w in enumerate(sorted({0, *map(columns, _INDENT.findall(text))}))}
    return _INDENT.sub(lambda m: " " * rank[columns(m[0])], text)


def parses(lang: grammars.Language, text: str, wanted: tuple[str, ...] = ("",)) -> bool:
    """Whether the text derives from the grammar in one of the forms."""
    return any(_derives(lang, x) for x in forms(lang, text, wanted))


def _derives(lang: grammars.Language, text: str) -> bool:
    s = kinds(lang, text)
    if BAD in s:
        return False
    if lang.newlines == "py":
        return _python(lang, s)
    if lang.newlines:
        drop, end = _lines(lang.name)
        if end is not None:
            s = end.sub(lang.tokens[";"], s)
        s = drop.sub("", s)
    if not s:
        return lang.name != "json"
    known = lang.r.known.get(("", s))
    if known is not None:
        return known
    c = lang.r.collapse(s)
    if c is None:
        return False
    if lang.name in ("go", "java"):
        # The head of the file isn't a part that may stand elsewhere.
        package = lang.tokens["package"]
        end = c.find(lang.tokens[";"]) + 1
        if package in c[:end]:
            if not (re.fullmatch(f"{package}{ID};".replace(";", lang.tokens[";"]), c[:end]) if lang.name == "go" else lang.r.derives("Package", c[:end])):
                return False
            c = c[end:]
        elif lang.name == "go":
            return False
    return lang.r.derives(lang.start, c)


# Python's blocks


@functools.lru_cache(1)
def _block() -> tuple[Grammar, dict[str, bool]]:
    return Grammar(grammars.PY_BLOCK, {k: k for k in grammars.PY_LINES}, {}), {}


_HEADS = {"if": "I", "elif": "E", "else": "L", "while": "W", "for": "F", "try": "T", "except": "X", "finally": "Y", "with": "H", "def": "D", "class": "C", "@": "@", "match": "M", "case": "K"}


def _line(lang: grammars.Language, line: str) -> tuple[str, bool]:
    """(letter of its kind, "" if it is none; whether a block must follow)."""
    t = lang.tokens
    heads = lang.__dict__.setdefault("heads", {t[k]: v for k, v in _HEADS.items()})
    first = line[1:2] if line[0] == t["async"] else line[0]
    letter = heads.get(first, "s")
    opens = line[-1] == t[":"]
    if letter in "MK" and not (letter == "M" and opens or letter == "K" and t[":"] in line):
        letter = "s"
    if letter != "s" and lang.r.derives(grammars.PY_LINES[letter], line):
        return letter, opens
    if letter in "sMK" and lang.r.derives("Line", line):
        return "s", False
    return "", False


_SPLIT = re.compile(f"([{grammars.INDENT}]+)")


def _python(lang: grammars.Language, s: str) -> bool:
    c = lang.r.collapse(s)
    if c is None:
        return False
    kept = lang.__dict__.setdefault("lines", {})
    parts = _SPLIT.split(c)
    stack: list[tuple[int, list[str]]] = [(0, [])]
    opens = False
    for i in range(0, len(parts), 2):
        line = parts[i]
        if not line:
            continue
        indent = ord(parts[i - 1][-1]) - INDENT0 if i else 0
        if opens:
            if indent <= stack[-1][0]:
                return False
            stack.append((indent, []))
        while indent < stack[-1][0]:
            if not _is_block(stack.pop()[1]):
                return False
        if indent != stack[-1][0]:
            return False
        found = kept.get(line)
        if found is None:
            if len(kept) > KEPT_TOKENS:
                kept.clear()
            found = kept[line] = _line(lang, line)
        letter, opens = found
        if not letter:
            return False
        stack[-1][1].append(letter)
    return not opens and all(not b or _is_block(b) for _, b in stack)


def _is_block(letters: list[str]) -> bool:
    grammar, known = _block()
    s = re.sub("s+", "s", "".join(letters))
    ok = known.get(s)
    if ok is None:
        if len(known) > KEPT_TOKENS:
            known.clear()
        ok = known[s] = grammar.accepts("Block", s)
    return ok


def decode(content: bytes) -> str:
    return content.decode("utf-8", "replace").removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


def valid(content: bytes | None, extension: str | None) -> bool | None:
    """Whether any dialect of the extension accepts the content; None if that isn't to be judged.

    Dialects of one grammar are forms of its text; what they have in common is recognised once.
    """
    dialects = DIALECTS.get((extension or "").lower())
    if content is None or dialects is None:
        return None
    text = decode(content)
    return any(parses(languages()[name], text, tuple(form for other, form in dialects if other == name)) for name in dict.fromkeys(n for n, _ in dialects))


def judged(files: DataFrame, key: str = "file_id", at: str = "scanned_at") -> DataFrame:
    """(key, project, language, extension, valid), one row for each key; valid is null where it isn't judged.

    Files are parsed where they are read; only the judgements are shuffled.
    """
    src = files.where(F.col(key).isNotNull()).select(key, at, "project", "language", "extension", "content")

    def make():  # noqa: ANN202
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            ok = [valid(c, e) for c, e in zip(b.column(5).to_pylist(), b.column(4).to_pylist())]
            return pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(ok, pa.bool_())], names=[key, at, "project", "language", "extension", "valid"])

        return batch

    t = {f.name: f.dataType.simpleString() for f in src.schema}
    rows = map_batches(src, make, f"{key} {t[key]}, {at} {t[at]}, project string, language string, extension string, valid boolean")
    cols = ["project", "language", "extension", "valid"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(at, "valid")).alias("_r")).select(key, "_r.*")


def invalid(files: DataFrame, key: str = "file_id", at: str = "scanned_at") -> DataFrame:
    """(key) of the files that every dialect rejects."""
    return judged(files, key, at).where("not valid").select(key)


def rates(files: DataFrame, key: str = "file_id", at: str = "scanned_at") -> DataFrame:
    """(project, language, files, invalid, rate): of judged files; a null language is that of the extension."""
    named = F.coalesce("language", F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE.items() for x in kv]), F.lower("extension")))
    j = judged(files, key, at).where("valid is not null").select("project", named.alias("language"), (~F.col("valid")).cast("long").alias("bad"))
    return j.groupBy("project", "language").agg(F.count("*").alias("files"), F.sum("bad").alias("invalid")).withColumn("rate", F.col("invalid") / F.col("files"))
