"""Declarations of JavaScript, TypeScript, Java, Go and Rust, read from a stream of tokens.

Comments and strings are tokens of their own, so nothing in them is taken for a declaration,
and neither is control flow. What counts: named functions (in Java: methods and constructors
with a body), classes with the class that they extend, imports with the module they name.
Parameters and members aren't read. A declaration lies on the line of its first modifier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

#: A token: its text and its line. Strings keep their quotes; comments and blanks are left out.
Token = tuple[str, int]

_STRINGS = {
    "javascript": r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\[\s\S]|[^`\\])*`",
    "java": r"\"\"\"[\s\S]*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "go": r"`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "rust": r"r#*\"[\s\S]*?\"#*|\"(?:\\[\s\S]|[^\"\\])*\"|'(?:\\[^\n]|[^'\\\n])'",
}
_STRINGS["typescript"] = _STRINGS["javascript"]
_TOKENS = {k: re.compile(rf"(?P<gap>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|{v}|\w+|\S") for k, v in _STRINGS.items()}
_CLOSE = {"(": ")", "<": ">", "{": "}"}
#: Words before a round bracket and a block that name no method, and words that no type is called.
_CONTROL = frozenset("if for while switch catch synchronized try do else return new throw assert super this case".split())


@dataclass(frozen=True)
class Kind:
    """How a language declares: the word that begins a function ("" where none does), modifiers before it, whether there are classes."""

    function: str
    modifiers: frozenset[str]
    classes: bool
    imports: str = ""


LANGUAGES = {
    "javascript": Kind("function", frozenset(("export", "async")), True, "from require"),
    "typescript": Kind("function", frozenset(("export", "async")), True, "from"),
    "java": Kind("", frozenset(("public", "private", "protected", "static", "final", "abstract", "synchronized")), True, "name"),
    "go": Kind("func", frozenset(), False, "list"),
    "rust": Kind("fn", frozenset(("pub", "async")), False),
}


def tokens(text: str, language: str) -> list[Token]:
    out, line, at = [], 1, 0
    for m in _TOKENS[language].finditer(text):
        if m["gap"] is None:
            line += text.count("\n", at, m.start())
            at = m.start()
            out.append((m[0], line))
    return out


class Reader:
    """The declarations in the tokens of one file, in order."""

    def __init__(self, text: str, language: str) -> None:
        self.kind = LANGUAGES[language]
        self.tokens = tokens(text, language)

    def word(self, i: int) -> str:
        """The text of token i, "" beyond the ends."""
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        w = self.word(i)
        return bool(w) and (w[0].isalnum() or w[0] == "_")

    def behind(self, i: int) -> int:
        """The place behind the bracket that closes the one at i; beyond the end if none does."""
        opening = self.word(i)
        closing, depth = _CLOSE[opening], 0
        while i < len(self.tokens):
            w = self.word(i)
            # The > of an arrow closes nothing.
            depth += (w == opening) - (w == closing and not (w == ">" and self.word(i - 1) in ("-", "=")))
            i += 1
            if not depth:
                return i
        return len(self.tokens) + 1

    def start(self, i: int) -> int:
        """The line of the first of the modifiers directly before token i."""
        while self.word(i - 1) in self.kind.modifiers:
            i -= 1
        return self.tokens[i][1]

    def functions(self) -> Iterator[tuple[str, int]]:
        yield from self._by_word() if self.kind.function else self._methods()

    def _by_word(self) -> Iterator[tuple[str, int]]:
        for i, (w, _) in enumerate(self.tokens):
            if w != self.kind.function:
                continue
            name = self.behind(i + 1) if w == "func" and self.word(i + 1) == "(" else i + 1
            after = self.behind(name + 1) if self.word(name + 1) == "<" else name + 1
            if self.is_name(name) and self.word(after) == "(" and self.behind(after) <= len(self.tokens):
                yield self.word(name), self.start(i)

    def _methods(self) -> Iterator[tuple[str, int]]:
        for i in range(1, len(self.tokens) - 1):
            typed = self.is_name(i - 1) or self.word(i - 1) in (">", "]")
            if not (self.is_name(i) and self.word(i + 1) == "(" and typed) or self.word(i) in _CONTROL or self.word(i - 1) in _CONTROL:
                continue
            j = self.behind(i + 1)
            if self.word(j) == "throws":
                while j < len(self.tokens) and self.word(j) not in ("{", ";"):
                    j += 1
            if self.word(j) == "{":
                first = i - 1 if self.is_name(i - 1) else i
                yield self.word(i), self.start(first)

    def classes(self) -> Iterator[tuple[str, int, list[str]]]:
        if not self.kind.classes:
            return
        for i, (w, _) in enumerate(self.tokens):
            if w != "class" or not self.is_name(i + 1) or self.word(i - 1) == ".":
                continue
            j = self.behind(i + 2) if self.word(i + 2) == "<" else i + 2
            base = ""
            if self.word(j) == "extends" and self.is_name(j + 1):
                j += 1
                while self.is_name(j) and self.word(j) != "implements" or self.word(j) == ".":
                    base += self.word(j)
                    j += 1
            while j < len(self.tokens) and self.word(j) not in ("{", "}", ";"):
                j += 1
            if self.word(j) == "{":
                yield self.word(i + 1), self.start(i), [base] if base else []

    def imports(self) -> Iterator[str]:
        how = self.kind.imports.split()
        for i, (w, _) in enumerate(self.tokens):
            if w == "require" and "require" in how and self.word(i + 1) == "(" and self.word(i + 3) == ")" and self.word(i + 2)[:1] in "\"'":
                yield self.word(i + 2)[1:-1]
            elif w == "import" and "from" in how:
                j = i + 1
                while j < len(self.tokens) and self.word(j) not in (";", "(", "import") and self.word(j)[0] not in "\"'":
                    j += 1
                if self.word(j - 1) == "from" and self.word(j)[:1] in ("'", '"'):
                    yield self.word(j)[1:-1]
            elif w == "import" and "name" in how:
                j = i + 1
                while self.is_name(j) or self.word(j) == ".":
                    j += 1
                if self.word(j) == ";" and j > i + 1 and self.word(i + 1) != "static":
                    yield "".join(self.word(k) for k in range(i + 1, j))
            elif w == "import" and "list" in how:
                last = self._list_end(i + 1)
                for k in range(i + 1, last):
                    if self.word(k)[0] in '"`':
                        yield self.word(k)[1:-1]

    def _list_end(self, i: int) -> int:
        """Behind the path of one import of Go, or behind its list in brackets."""
        if self.word(i) == "(":
            return min(self.behind(i), len(self.tokens))
        return min(i + 1 if self.word(i)[:1] in '"`' else i + 2, len(self.tokens))
