"""Texts whose tokens nest, in a form that one pattern can lex.

A template string with substitutions becomes its pieces with the substitutions as groups
between them: `a${x}b` is `a`{x}`b`. A JSX element becomes one mark and its expressions in
parentheses: <a b={x}>t {y}</a> is the mark and ({x}{y}). Both nest in each other. An
f-string of Python whose fields hold quotes of its own kind becomes an empty string.
"""

from __future__ import annotations

import re

from siltstone.llm.grammars import C_COMMENT, DQ, JS_RE, JSX, PY_STR, SQ

#: Where an element may begin: where an operand is due.
_OPENS = r"(?:(?<=[=(,?:&|{\[;>}\n])|(?<=[=(,?:&|{\[;>}] )|(?<=return )|(?<=default )|(?<=yield )|(?<=await )|(?<=return\n)|(?<=\A))[ \t\n]*<(?=[A-Za-z_$>])(?![A-Za-z_$][\w$]*(?:\s*,|\s+extends\b))"
_START = re.compile(_OPENS)
_CODE = {
    False: re.compile(rf"{C_COMMENT}|{DQ}|{SQ}|{JS_RE}|[`{{}}]"),
    True: re.compile(rf"{C_COMMENT}|(?P<open>{_OPENS})|{DQ}|{SQ}|{JS_RE}|[`{{}}]"),
}
_CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_NAME = re.compile(r"\s*([A-Za-z_$][\w$.:-]*)?")
_SPACE = re.compile(rf"(?:\s|{C_COMMENT})*")
_ATTRIBUTE = re.compile(r"[A-Za-z_$][\w$:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?=[{<])))?")
_TEXT = re.compile(r"[^<{>}]*")


class Broken(ValueError):
    """The text is no such dialect."""


def has_templates(text: str) -> bool:
    return "${" in text and "`" in text


def has_elements(text: str) -> bool:
    return "<" in text and _START.search(text) is not None


class _Reader:
    def __init__(self, text: str, jsx: bool) -> None:
        self.text, self.code = text, _CODE[jsx]
        self.out: list[str] = []

    def run(self, pos: int, inner: bool) -> int:
        """Writes code from pos on up to the end, or up to the } that closes what is read; gives where it ended."""
        text, out, search = self.text, self.out, self.code.search
        depth, done = 0, pos
        while m := search(text, pos):
            c, pos = m[0], m.end()
            if c == "{":
                depth += 1
            elif c == "}":
                if not depth and inner:
                    out.append(text[done : pos - 1])
                    return pos
                depth -= 1
            elif c == "`":
                out.append(text[done : pos - 1])
                pos = done = self.template(pos)
            elif c[-1] == "<" and c.isspace() is False and c.strip() == "<":
                out.append(text[done : pos - 1])
                pos = done = self.element(pos)
        if inner:
            raise Broken
        out.append(text[done:])
        return len(text)

    def template(self, pos: int) -> int:
        text, out = self.text, self.out
        while True:
            end = _CHUNK.match(text, pos).end()
            # What a piece says is of no account but for its line ends, which begin lines in the lexer.
            out.append("`" + "`")
            if text.startswith("`", end):
                return end + 1
            if not text.startswith("${", end):
                raise Broken
            out.append("{")
            pos = self.run(end + 2, True)
            out.append("}")

    def element(self, pos: int) -> int:
        """Writes the element whose < stands before pos."""
        self.out.append(f"{JSX}(")
        end = self.tag(pos)
        self.out.append(")")
        return end

    def tag(self, pos: int) -> int:
        text = self.text
        m = _NAME.match(text, pos)
        name, pos = m[1] or "", m.end()
        while True:
            pos = _SPACE.match(text, pos).end()
            if text.startswith("/>", pos):
                return pos + 2
            if text.startswith(">", pos):
                pos += 1
                break
            if text.startswith("{", pos):
                pos = self.container(pos + 1)
            elif name and (m := _ATTRIBUTE.match(text, pos)):
                pos = m.end()
                if m[0].rstrip().endswith("="):
                    pos = self.container(pos + 1) if text.startswith("{", pos) else self.tag(pos + 1)
            else:
                raise Broken
        while True:
            pos = _TEXT.match(text, pos).end()
            if text.startswith("{", pos):
                pos = self.container(pos + 1)
            elif text.startswith("</", pos):
                m = _NAME.match(text, pos + 2)
                end = _SPACE.match(text, m.end()).end()
                if (m[1] or "") != name or not text.startswith(">", end):
                    raise Broken
                return end + 1
            elif text.startswith("<", pos):
                pos = self.tag(pos + 1)
            else:
                raise Broken

    def container(self, pos: int) -> int:
        self.out.append("{")
        pos = self.run(pos, True)
        self.out.append("}")
        return pos


def plain(text: str, jsx: bool) -> str | None:
    """text with its template strings, and its elements if jsx, taken apart; None if they are broken.

    Nesting beyond what the stack of Python holds counts as broken.
    """
    reader = _Reader(text, jsx)
    try:
        reader.run(0, False)
    except (Broken, RecursionError):
        return None
    return "".join(reader.out)


# Python

_PY_CODE = re.compile(rf"#[^\n]*|(?<![\w])(?P<f>(?i:rf|fr|f|tr|rt|t))(?P<q>\"\"\"|\'\'\'|\"|\')|{PY_STR}|[()\[\]{{}}]|![rsa](?=\s*[:}}])|!=|:")


def has_fields(text: str) -> bool:
    return _F_STRING.search(text) is not None


_F_STRING = re.compile(r"(?<![\w])(?i:rf|fr|f|tr|rt|t)[\"'][^\n]*\{")


def without_fields(text: str) -> str | None:
    """text with each f-string as an empty one, whatever quotes its fields hold; None if one isn't closed."""
    out: list[str] = []
    done = pos = 0
    try:
        while m := _PY_CODE.search(text, pos):
            pos = m.end()
            if m["f"]:
                out.append(text[done : m.start()])
                done = pos = _f_string(text, pos, m["q"])
                # Its line ends don't begin lines.
                out.append('""')
    except (Broken, RecursionError):
        return None
    return "".join([*out, text[done:]])


def _f_string(text: str, pos: int, quote: str) -> int:
    """The end of the f-string whose text begins at pos."""
    while pos < len(text):
        if text.startswith(quote, pos):
            return pos + len(quote)
        c = text[pos]
        if c == "\n" and len(quote) == 1:
            break
        if c == "\\" or text.startswith(("{{", "}}"), pos):
            pos += 2
        else:
            pos = _field(text, pos + 1) if c == "{" else pos + 1
    raise Broken


def _field(text: str, pos: int) -> int:
    """The end of the replacement field that begins before pos."""
    depth, start = 0, pos
    while m := _PY_CODE.search(text, pos):
        c, pos = m[0], m.end()
        if m["f"]:
            pos = _f_string(text, pos, m["q"])
        elif c == "}" and not depth:
            if not text[start : m.start()].strip():
                break
            return pos
        elif c in ("(", "[", "{"):
            depth += 1
        elif c in (")", "]", "}"):
            depth -= 1
        elif c == ":" and not depth:
            # The format goes up to the } of the field and may hold fields itself.
            while pos < len(text) and text[pos] != "}":
                if text[pos] == "\n":
                    raise Broken
                pos = _field(text, pos + 1) if text[pos] == "{" else pos + 1
            return pos + 1
    raise Broken
