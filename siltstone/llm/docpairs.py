"""Functions and methods paired with their documentation.

Each file gives its part of the symbol table: the functions at top level and those directly in
a class or impl, with container, parameters, a normalised signature and the documentation
that stands with them. Comments and strings are blanked first, so declarations are found in
code only. Symbols without a body of their own (prototypes, signatures of interfaces) are
joined with the definitions of the same qualified name in the project, first by signature,
else by name where that is unique; then documentation without content is dropped.

Defined results: null content and files that don't parse (syntax.py) give no symbols; of
several deliveries of one key the last one counts; a null key is no record; other extensions
have no symbols. Documentation is trivial if without marks and tag lines it has fewer than
five words (an ideograph counts as one) or says nothing but the function's name.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import syntax
from siltstone.llm.common import map_batches

LEAST_WORDS = 5
_COMMENT, _DQ, _SQ = r"//[^\n]*|/\*[\s\S]*?\*/", r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_JS_RE = r"(?<=[=(,:;!&|?{}\[\n] )/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/|(?<=[=(,:;!&|?{}\[\n])/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/"
HIDDEN = {
    "javascript": re.compile(rf"{_COMMENT}|`(?:[^`\\]|\\[\s\S])*`|{_DQ}|{_SQ}|{_JS_RE}"),
    "java": re.compile(rf'{_COMMENT}|"""[\s\S]*?"""|{_DQ}|{_SQ}'),
    "go": re.compile(rf"{_COMMENT}|`[^`]*`|{_DQ}|{_SQ}"),
    "rust": re.compile(rf"""{_COMMENT}|b?r(#+)"[\s\S]*?"\1|b?r"[^"]*"|"(?:[^"\\]|\\[\s\S])*"|'(?:[^'\\\n]|\\[^\n][^'\n]*)'"""),
    "c": re.compile(rf"{_COMMENT}|{_DQ}|{_SQ}"),
    "python": re.compile(r"#[^\n]*|'''(?:[^\\]|\\[\s\S])*?'''|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\""),
}
HIDDEN["typescript"] = HIDDEN["javascript"]
_BRACE = re.compile(r"[{}]")
_NO_BODY = re.compile(r"[^{;]*;")
_NOT_LF = re.compile(r"[^\n]+")
_P = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
_N = r"[^\W\d][\w$]*"
_T = r"(?:<[^;{}()=]*>)?"
_JS_MOD = r"(?:(?:export|default|declare|async|abstract|public|private|protected|static|readonly|override|get|set)[ \t]++)*+"
_ARROW = rf"(?:async[ \t]+)?(?:{_T}(?P<p2>{_P})(?:\s*:\s*[^=;{{}}]+?(?:\{{[^{{}}]*\}}[^=;{{}}]*?)?)?|{_N})\s*=>"
# The name of a declaration is in group n1, n2 or n3, its parameters in p1, p2 or p3; "class" opens a container.
DECLARED = {
    "javascript": re.compile(
        rf"(?P<open>\{{)|(?P<shut>\}})|(?:^|(?<=[;{{}}]))[ \t]*+(?:(?P<class>{_JS_MOD}class\b(?:[ \t]+(?P<cn>{_N}))?[^{{;]*?(?=\{{))"
        rf"|{_JS_MOD}function\s*\*?\s*(?P<n1>{_N})\s*{_T}\s*(?P<p1>{_P})|(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<n2>{_N})\s*(?::[^=;]+(?:=>[^=;]+)?)?=\s*{_ARROW}"
        rf"|{_JS_MOD}\*?[ \t]*#?(?P<n3>{_N})\s*(?:\?\s*)?(?:{_T}\s*(?P<p3>{_P})(?=\s*(?::\s*[^;{{}}]+?)?\s*[;{{\n]|\s*:\s*\{{)|(?::[^=;\n]+)?=\s*(?P<field>(?:async[ \t]+)?(?:{_P}(?:\s*:\s*[^=;{{}}]+?)?|{_N})\s*=>)))",
        re.M,
    ),
    "java": re.compile(
        rf"(?P<open>\{{)|(?P<shut>\}})|(?:^|(?<=[;{{}}]))[ \t]*(?:@[\w.]+(?:{_P})?\s+)*(?:(?P<class>(?:(?:public|protected|private|abstract|static|final|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum|record|@interface)\s+(?P<cn>{_N})[^{{;]*?(?=\{{))"
        rf"|(?:(?:public|protected|private|abstract|static|final|native|synchronized|strictfp|default)\s+)*(?:<[^;{{}}()=]*>\s*)?(?:[\w.$]+(?:<[^;{{}}()=]*>)?(?:\s*\[\s*\])*\s+)?(?P<n1>{_N})\s*(?P<p1>{_P})(?:\s*throws[\w\s,.]+)?\s*(?=[;{{]))",
        re.M,
    ),
    "go": re.compile(rf"(?P<open>\{{)|(?P<shut>\}})|^func\s+(?P<recv>\([^()]*\)\s*)?(?P<n1>{_N})\s*(?:\[[^\[\]]*(?:\[[^\[\]]*\])*[^\[\]]*\])?\s*(?P<p1>{_P})", re.M),
    "rust": re.compile(
        rf"(?P<open>\{{)|(?P<shut>\}})|(?P<class>(?:^|(?<=[;{{}}]))[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:impl|trait)\b(?P<cn>[^{{;]*)(?=\{{))"
        rf"|(?:^|(?<=[;{{}}\]]))[ \t]*(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\w+)?)\s+)*(?:extern\s+)?fn\s+(?P<n1>{_N})\s*(?:<[^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*>)?\s*(?P<p1>{_P})",
        re.M,
    ),
    "c": re.compile(rf"(?P<open>\{{)|(?P<shut>\}})|(?:^|(?<=[;}}]))(?!\s*#)(?:[^\W\d][\w \t]*[\s*]+(?:__attribute__\s*\(\(.*?\)\)\s*)?)\**(?P<n1>{_N})\s*(?P<p1>{_P})\s*(?=[;{{_\n])", re.M),
}
DECLARED["typescript"] = DECLARED["javascript"]
_NO_NAMES = {
    "javascript": frozenset("if for while switch catch function return with do else new typeof await throw super constructor_ in of case delete void import".split()),
    "java": frozenset("if for while switch catch return new throw else do synchronized try assert super this case".split()),
    "c": frozenset("if for while switch return else do sizeof typedef case goto defined".split()),
    "go": frozenset(),
    "rust": frozenset(),
}
_NO_NAMES["typescript"] = _NO_NAMES["javascript"]
_NO_FIRST = re.compile(r"\s*(?:return|else|case|goto|throw|new|typedef|await|yield|do)\b")
_DIRECTIVE = re.compile(r"\s*//\s*(?:[a-z]+:\S|nolint|NOLINT|NOSONAR|eslint|@ts-|tslint|prettier|istanbul|c8 |v8 |jshint|jslint|clang-|biome|deno-)|\s*/\*\s*(?:eslint|istanbul|NOLINT|prettier|clang-)[^*]*\*/\s*$|\s*//export ")
_BETWEEN = {"javascript": re.compile(r"\s*@"), "typescript": re.compile(r"\s*@"), "java": re.compile(r"\s*@"), "go": re.compile(r"(?!)"), "rust": re.compile(r"\s*#!?\["), "c": re.compile(r"\s*(?:#|__attribute__|\[\[|__declspec)")}
_WORDS = re.compile(r"[一-鿿぀-ヿ]|[^\s一-鿿぀-ヿ]*[^\W_][^\s一-鿿぀-ヿ]*")
_TAG = re.compile(r"^\s*[@\\][A-Za-z]|^\s*:(?:param|type|returns?|rtype|raises?|var|ivar|yields?)\b")
_SECTION = re.compile(r"^\s*(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields?|Attributes|Keyword Args|Other Parameters|Examples?|Notes?|Warns?|See Also|References)\s*:?\s*$")
_KEEP = re.compile(r"[\W_]+")


def hide(language: str, text: str) -> str:
    """text with comments and strings as blanks of the same length, lines kept."""
    return HIDDEN[language].sub(lambda m: _NOT_LF.sub(lambda x: " " * len(x[0]), m[0]), text)


def trivial(doc: str | None, name: str) -> bool:
    """Whether documentation, without its marks, says nothing."""
    if not doc:
        return True
    lines = [x for x in doc.split("\n") if not _TAG.match(x)]
    if len(_WORDS.findall("\n".join(lines))) < LEAST_WORDS:
        return True
    said = [w for w in _KEEP.split("\n".join(lines).lower()) if w and w != "the"]
    return "".join(said) == "".join(w for w in _KEEP.split(name.lower()) if w)


def _block(lines: list[str], end: int) -> str | None:
    """The text of the /** */ comment whose last line is given."""
    start = end
    while start >= 0 and "/*" not in lines[start]:
        start -= 1
    if start < 0:
        return None
    text = "\n".join(lines[start : end + 1])
    at = text.rfind("/*")
    head = text[:at]
    if head.strip() or not text.startswith("/**", at) or text.startswith("/**/", at):
        return None
    body = text[at + 3 : text.rfind("*/")]
    return "\n".join(re.sub(r"^\s*\*+ ?|^\s+", "", x) for x in body.split("\n")).strip()


def _depth(line: str) -> int:
    """Brackets that a line opens, less those that it closes."""
    return sum(map(line.count, "([{")) - sum(map(line.count, ")]}"))


_DEEP = re.compile(r"\([^()]*\([^()]*\([^()]*\(")
_ROUND = re.compile(r"[(){}]")


def flat(code: str) -> str:
    """code with the brackets in the third level of () and below as blanks, as far as the patterns of declarations look; braces begin anew."""
    if not _DEEP.search(code):
        return code
    out: list[str] = []
    done, depth, outer = 0, 0, []
    for m in _ROUND.finditer(code):
        c = m[0]
        if c == "{":
            outer.append(depth)
            depth = 0
        elif c == "}":
            depth = outer.pop() if outer else 0
        else:
            depth += c == "("
            if depth > 3:
                out.append(code[done : m.start()] + " ")
                done = m.end()
            depth -= c == ")"
    return "".join([*out, code[done:]])


def _above(language: str, lines: list[str], hidden: list[str], at: int) -> str | None:
    """The documentation directly above line at, without its marks."""
    i = at - 1
    skip = _BETWEEN[language]
    docs: list[str] = []
    while i >= 0:
        x = lines[i]
        s = x.strip()
        if not s:
            break
        if hidden[i].strip():
            # Code: an attribute, or the end of one that spans lines, which begins where its brackets open.
            if skip.match(hidden[i]):
                i -= 1
                continue
            j, depth = i, _depth(hidden[i])
            while depth < 0 and j > 0:
                j -= 1
                depth += _depth(hidden[j])
            if j < i and depth == 0 and skip.match(hidden[j]):
                i = j - 1
                continue
            break
        if _DIRECTIVE.match(x):
            i -= 1
            continue
        if language == "rust":
            if not s.startswith("///") or s.startswith("////"):
                break
            docs.append(s[3:].strip())
        elif language == "go":
            if not s.startswith("//"):
                break
            docs.append(s[2:].strip())
        else:
            return _block(lines, i) if s.endswith("*/") else None
        i -= 1
    return "\n".join(reversed(docs)) if docs else None


def _split(params: str) -> list[str]:
    """Parameters at the commas outside of brackets."""
    out, depth, now = [], 0, ""
    for c in params:
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [" ".join(x.split()) for x in [*out, now] if x.strip()]


def _parameter(language: str, p: str) -> tuple[str, str]:
    """(name, normalised type) of a parameter."""
    p = re.sub(r"@\w+(?:\([^)]*\))?\s*", "", p).split("=")[0].strip()
    if language in ("javascript", "typescript", "rust", "python"):
        name, _, kind = p.partition(":")
        name = re.sub(r"^(?:(?:public|private|protected|readonly|mut|ref)\s+)+", "", name.strip()).strip("?* ")
    elif language == "go":
        name, _, kind = p.partition(" ")
    else:
        m = re.match(r"(.*?)([^\W\d]\w*)\s*((?:\[[^\]]*\])*)$", p)
        kind, name = (m[1] + m[3], m[2]) if m and m[1].strip() else (p, p)
    return name, re.sub(r"\s+|\bfinal\b|\bconst\b", "", kind)


Symbol = tuple[str, str, int, bool, list[str], str, str | None]


def symbols(language: str, text: str) -> Iterator[Symbol]:
    """(container, name, line, whether it has a body, parameters, signature, documentation) of each function."""
    if language == "python":
        yield from _python(text)
        return
    code = hide(language, text)
    lines, hidden = text.split("\n"), code.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    ends: dict[int, int] = {}
    opened: list[int] = []
    for m in _BRACE.finditer(code):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.end()
    stack: list[str] = []  # names of the containers around; what is in other braces is passed over
    waiting: str | None = None
    no_names = _NO_NAMES[language]
    pattern = DECLARED[language]
    shown = flat(code)
    at = 0
    while m := pattern.search(shown, at):
        at = max(m.end(), at + 1)
        g = m.groupdict()
        if g["open"]:
            if waiting is None:
                at = ends.get(m.start(), len(code))
            else:
                stack.append(waiting)
            waiting = None
            continue
        if g["shut"]:
            if stack:
                stack.pop()
            continue
        if g.get("class") is not None:
            waiting = " ".join((g.get("cn") or "").split())
            continue
        waiting = None
        which = next(k for k in ("n1", "n2", "n3") if g.get(k))
        name = g[which]
        if which == "n3" and not stack or name in no_names or language == "java" and not stack or _NO_FIRST.match(m[0]):
            at = m.start(which) + len(name)
            continue
        params = code[m.start("p" + which[1]) : m.end("p" + which[1])] if g.get("p" + which[1]) else ""
        if which == "n3" and g.get("field"):
            params = ""
        line = bisect.bisect_right(starts, m.start(which)) - 1
        # Declarations may begin above the line of their name, and blanks at the start belong to none.
        first = m.start() + len(m[0]) - len(m[0].lstrip())
        first = bisect.bisect_right(starts, first) - 1
        ps = [_parameter(language, p) for p in _split(params[1:-1])]
        container = stack[-1] if stack else (" ".join((g.get("recv") or "").strip("() \n").split()).split(" ")[-1].lstrip("*") if language == "go" else "")
        body = not _NO_BODY.match(code, m.end()) or which == "n2" or language == "go"
        yield container or "", name, line + 1, body, [n for n, _ in ps], ",".join(t for _, t in ps), _above(language, lines, hidden, first)


_PY = re.compile(r"^([ \t]*)(?:(?:async[ \t]+)?def[ \t]+(?P<def>[^\W\d]\w*)\s*(?:\[[^\[\]]*\])?\s*(?P<p>\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))(?:\s*->[^\n]+?)?\s*:|(?P<class>class)[ \t]+(?P<cn>[^\W\d]\w*)|(?P<other>(?:if|for|while|with|try|else|elif|except|finally|async|match|case)\b))", re.M)
_PY_DOC = re.compile(r"(?:[ \t]*(?:\#[^\n]*)?\n)*[ \t]*([rRuU]?)('''(?:[^\\]|\\[\s\S])*?'''|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\")[ \t]*(?=[\n;#'\"]|\Z)")


def _python(text: str) -> Iterator[Symbol]:
    code = hide("python", text)
    stack: list[tuple[int, str | None]] = []  # indent and name of the blocks around; None where it is no class
    for m in _PY.finditer(flat(code)):
        indent = len(m[1].expandtabs())
        while stack and stack[-1][0] >= indent:
            stack.pop()
        if m["class"]:
            stack.append((indent, m["cn"]))
            continue
        if m["other"]:
            stack.append((indent, None))
            continue
        if all(n is not None for _, n in stack):
            doc = None
            if d := _PY_DOC.match(text, m.end()):
                quote = 3 if d[2][:3] in ("'''", '"""') else 1
                doc = d[2][quote:-quote]
                lines = doc.split("\n")
                doc = "\n".join(x.strip() if not i else x for i, x in enumerate(lines)).strip()
            ps = [p for p in (_parameter("python", x) for x in _split(code[m.start("p") + 1 : m.end("p") - 1])) if p[0] not in ("", "/")]
            if stack and ps and ps[0][0] in ("self", "cls"):
                ps = ps[1:]
            yield stack[-1][1] if stack else "", m["def"], text.count("\n", 0, m.start("def")) + 1, True, [n for n, _ in ps], ",".join(t for _, t in ps), doc
        stack.append((indent, None))


SYMBOL = "struct<container:string,name:string,line_start:bigint,has_body:boolean,parameters:array<string>,signature:string,docstring:string,trivial:boolean>"
FIELDS = ("container", "name", "line_start", "has_body", "parameters", "signature", "docstring", "trivial")
_TYPE = pa.struct([("container", pa.string()), ("name", pa.string()), ("line_start", pa.int64()), ("has_body", pa.bool_()), ("parameters", pa.list_(pa.string())), ("signature", pa.string()), ("docstring", pa.string()), ("trivial", pa.bool_())])
_LANGUAGES = frozenset(DECLARED) | {"python"}


def of_file(content: bytes | None, extension: str | None, texts: bool) -> list[dict]:
    language = syntax.LANGUAGE.get((extension or "").lower())
    if not content or language not in _LANGUAGES:
        return []
    found = [
        dict(zip(FIELDS, (container, name, line, body, parameters if texts else None, signature, doc if texts else None, trivial(doc, name))))
        for container, name, line, body, parameters, signature, doc in symbols(language, syntax.decode(content))
    ]
    # Only a file that gives something has to be parsed.
    return found if found and syntax.valid(content, extension) else []


def symbol_table(files: DataFrame, key: str = "file_id", at: str = "scanned_at", texts: bool = True) -> DataFrame:
    """(key, project, language, path, the fields of a symbol): one row for each function of each file that parses.

    texts=False: parameters and docstring are null, since they need not travel.
    """
    src = files.where(F.col(key).isNotNull()).select(key, at, "project", "path", "extension", "content")

    def make():  # noqa: ANN202
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [of_file(c, e, texts) for c, e in zip(b.column(5).to_pylist(), b.column(4).to_pylist())]
            kind = [syntax.LANGUAGE.get((e or "").lower()) for e in b.column(4).to_pylist()]
            return pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(kind, pa.string()), pa.array(found, pa.list_(_TYPE))], names=[key, at, "project", "path", "language", "symbols"])

        return batch

    t = {f.name: f.dataType.simpleString() for f in src.schema}
    rows = map_batches(src, make, f"{key} {t[key]}, {at} {t[at]}, project string, path string, language string, symbols array<{SYMBOL}>")
    cols = ["project", "path", "language", "symbols"]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(at, F.size("symbols"))).alias("_r")).select(key, "_r.*")
    return last.select(key, "project", "path", "language", F.explode("symbols").alias("_s")).select(key, "project", "path", "language", "_s.*")


def documented(files: DataFrame, key: str = "file_id", at: str = "scanned_at") -> DataFrame:
    """(key, line_start, name) of the functions with documentation: where the description of each pair stands."""
    return pairs(files, key, at, texts=False).select(key, "line_start", "name").distinct()


def pairs(files: DataFrame, key: str = "file_id", at: str = "scanned_at", texts: bool = True) -> DataFrame:
    """(key, line_start, name, container, parameters, docstring, defined_in, defined_at): code and description.

    A documented symbol without a body is joined with the definitions of its qualified name in
    its project: with that of its signature, else with the only one there is; where there is
    neither, it stands alone. A definition stands for itself. Each symbol goes one of these ways,
    by inner and anti joins: an outer join would be left out of the plan of documented().
    """
    table = symbol_table(files, key, at, texts)
    names = ["project", "language", "container", "name"]
    bodies = table.where("has_body").groupBy(*names, "signature").agg(F.min(F.struct(F.col(key).alias("k"), F.col("line_start").alias("l"))).alias("d"))
    only = bodies.groupBy(*names).agg(F.count("*").alias("n"), F.min("d").alias("d")).where("n = 1").drop("n")
    said = table.where("not trivial")
    declared = said.where("not has_body")
    unsigned = declared.join(bodies, [*names, "signature"], "left_anti")
    t = dict(table.dtypes)

    def ends(rows: DataFrame, k: Column, line: Column) -> DataFrame:
        return rows.select(key, "line_start", "name", "container", "parameters", "docstring", k.cast(t[key]).alias("defined_in"), line.cast("bigint").alias("defined_at"))

    ways = [
        ends(said.where("has_body"), F.col(key), F.col("line_start")),
        ends(declared.join(bodies, [*names, "signature"]), F.col("d.k"), F.col("d.l")),
        ends(unsigned.join(only, names), F.col("d.k"), F.col("d.l")),
        ends(unsigned.join(only, names, "left_anti"), F.lit(None), F.lit(None)),
    ]
    return functools.reduce(DataFrame.unionByName, ways)


@functools.lru_cache(1)
def languages() -> tuple[str, ...]:
    return tuple(sorted(_LANGUAGES))
