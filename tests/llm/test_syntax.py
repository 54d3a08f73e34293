import ast
import random
from datetime import datetime

import pytest

from siltstone.llm import gll
from siltstone.llm import syntax as S

GOOD = {
    ".js": ["", "// only\n", "a = b\nc()", "if (a) { b() } else if (c) d(); else { e() }", "const f = async (a, {b, c = 1}, ...d) => ({...a, [b]: c})", "for (const [k, v] of Object.entries(x)) { k.y?.z?.(v) }", "class A extends B { static x = 1; get y() { return 1 } async *z() { yield* q } #p = 2 }", "export default function () {}\nimport a, {b as c} from 'm'\nexport * from 'n'", "x = /re[/]g/gi.test(`a ${b}`) ? 1n : .5e3", "switch (a) { case 1: b(); break; default: c() }", "try { a() } catch { b() } finally { c() }", "!function(e,t){var n=e.x||{};e.y=n}(window,document);", "lbl: do { continue lbl } while (0)", "x\n  .map(y => y + 1)\n  .filter(Boolean)", "return_ = a ?? b ** 2, new Foo().bar"],
    ".ts": ["interface A<T> extends B { x?: number; [k: string]: unknown; f(a: T): void }", "type U = 'a' | 1 | { b: string[] } | ((x: number) => Promise<Map<string, number[]>>)", "export abstract class C<T> implements D { private readonly x: T = y as T; constructor(public a: string) { super() } abstract m(): void }", "enum E { A = 1, B }\ndeclare module 'x' { export const y: number }", "function f<T extends object>(this: X, a?: T, ...b: T[]): a is T { return a! }", "const g = <T,>(x: T): T => x satisfies T", "let z: typeof x[number]; @Dec() class K {}"],
    ".java": ["package a.b; import java.util.*; public class A<T extends B> extends C implements D, E { private final List<Map<String, int[]>> x = new ArrayList<>(); @Override public <R> R f(int... a) throws X { for (String s : b) { if (a == null) continue; } return (R) a.stream().map(B::c).collect(d(() -> { return 1; })); } }", "enum E { A(1) { void f() {} }, B; int x; }", "interface I { default void f() {} } record R(int a, String b) {}", "class A { int f(Object o) { return switch (o) { case Integer i when i > 1 -> 1; case null, default -> { yield 2; } }; } static { x = a > b ? c >> 2 : d >>> 3; } }"],
    ".go": ["package a\n\nimport (\n\t\"x\"\n\ty \"z\"\n)\n\ntype T[K any] struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\n\nfunc (t *T[K]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok && v != nil {\n\t\treturn v.(int), nil\n\t} else if x := f(); x {\n\t}\n\tfor i := range a {\n\t\tgo func() { ch <- i }()\n\t}\n\tselect {\n\tcase v := <-ch:\n\t\t_ = v\n\tdefault:\n\t}\n\treturn\n}\n", "package a\nvar x = map[string][]int{\"a\": {1, 2}, \"b\": nil}\nconst (\n\tA = iota\n\tB\n)\n"],
    ".rs": ["use a::{b, c::*};\n#[derive(Debug)]\npub struct A<'a, T: B + 'a> where T: C { pub x: &'a [T], y: Option<Box<dyn Fn(u8) -> u8>> }\nimpl<'a, T> A<'a, T> { pub(crate) async fn f(&mut self, a: u32) -> Result<(), E> { let Some(x) = y else { return Err(z)?; }; match a { 1 | 2 => {} n @ 3..=5 if n > 4 => g(), _ => unreachable!(\"{}\", a), } for i in 0..n { println!(\"{i}\"); } a.b::<C>().await } }", "fn main() { let v = vec![1, 2]; let c = |x: u8| -> u8 { x + 1 }; if let Some(A { b, .. }) = v && true { } 'l: loop { break 'l; } let s = r#\"a\"b\"#; }", "enum E { A(u8), B { c: i32 }, D = 3 } trait T { fn f(); const X: u8 = 1; }"],
    ".c": ["#include <a.h>\n#define X(a) \\\n  (a)\ntypedef struct s { int a : 3, *b; union { float c; } d; } s_t;\nstatic const char *const names[] = { \"a\", [2] = \"b\" };\nint main(int argc, char **argv)\n{\n  unsigned long x = (unsigned)argc << 2, *p = &x;\n  for (int i = 0; i < 3; i++) if (p[i]) continue; else goto end;\n  switch (x) { case 1: break; default: ; }\n  do { x--; } while (x > sizeof(s_t));\nend:\n  return x ? 0 : f((s_t){ .a = 1 });\n}\n", "int (*fp)(void *, ...);\nextern int g(void) __attribute__((noreturn));"],
    ".json": ['{"a": [1, -2.5e3, true, null, {"b": ""}]}', "[]", '"x"', " 1 "],
    ".py": ["", "# c\n", "def f(a, *, b=1, **c) -> int: pass\nasync def g():\n\tasync with a as b, c: return [x async for x in y if x]\n", "x: int = 1; y = lambda a, *b: (yield)\nif a: b\nelif c:\n    d\nelse: e\n", "match x:\n    case [1, *r] if r: pass\n    case {'a': A(b=1)} | None as z: pass\n", "try:\n  a\nexcept* (A, B) as e:\n  b\nfinally:\n  c\n@d(1)\nclass K(B, m=1):\n  '''doc'''\n  a = {**b, 'c': 1}; e[1:2, ...] = f'{g!r}'\n", "print(a,\n  b)  # x\nx = [\n 1,\n]\nwith (a as b, c): pass\nmatch = case = 1\n"],
}
BAD = {
    ".js": ["function f( {", "riturn total;", "a = ;", "if (a) { b() }}", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", 'x = "abc', "class { x( }", "a b", "/* open", "def f():\n  pass", "let = = 1", "for (;;"],
    ".ts": ["let x: = 1;", "interface A { x: }", "type = 1 2", "riturn x;", "a = b c"],
    ".java": ["class A {", "class A { void f() { riturn total x; } }", "import a", "{}", "class A { int f( { } }"],
    ".go": ["package", "package a\nfunc f() {\n\triturn x\n}\n", "package a\nfunc f( {}\n", "x := 1\n", "package a\nvar x = \n"],
    ".rs": ["fn f() { lit x = 1; }", "fn f( {}", "struct A { x }", "fn f() { a b }", "pub"],
    ".c": ["int f(void) {", "int x = ;", "<html>", "int f(void) { if x { } }", "from a import b"],
    ".json": ["", "{", "{a: 1}", "[1,]", "01", '{"a" 1}', "config:\n  - a", "NaN", '"\\x"'],
    ".py": ["def f(:\n  pass", "riturn total", "if a\n  b", "def f():\nx", "  x", "x = (1", "'''open", "a = 1\n  b = 2", "else:\n  a", "<<<<<<< x", "if a:\n    b\n  c\n", "try:\n  a\n", "1abc"],
}


@pytest.mark.parametrize(("e", "text"), [(e, t) for e, ts in GOOD.items() for t in ts])
def test_valid(e, text):
    assert S.valid(text.encode(), e) is True
    assert S.valid(b"\xef\xbb\xbf" + text.replace("\n", "\r\n").encode(), e) is True


@pytest.mark.parametrize(("e", "text"), [(e, t) for e, ts in BAD.items() for t in ts])
def test_invalid(e, text):
    assert S.valid(text.encode(), e) is False


def test_python_grammar_alone_as_its_own_parser():
    """Mutations of a program: what the grammar rejects or accepts, the parser does, but for a few checks beyond syntax."""
    rnd = random.Random(1)
    text = GOOD[".py"][5] + GOOD[".py"][3] + "def f(a, b=2):\n    for x in a:\n        if x > 1:\n            return {x: b}\n    return [y for y in b]\n"
    lang = S.languages()["python"]
    same = total = 0
    for _ in range(400):
        t = list(text)
        for _ in range(rnd.randint(0, 2)):
            i = rnd.randrange(len(t))
            t[i : i + 1] = rnd.choice(["", "(", ")", ":", " ", "\n", "x", "=", ","])
        t = "".join(t)
        try:
            ast.parse(t)
            want = True
        except (SyntaxError, ValueError):
            want = False
        total += 1
        same += S.parses(lang, t) == want
    assert same > 0.93 * total


def test_recogniser_against_enumeration():
    g = gll.Grammar("S = 'a' S 'b' | S S | 'c'? ;", {"a": "a", "b": "b", "c": "c"}, {})

    def derives(s):
        depth = 0
        for c in s:
            depth += (c == "a") - (c == "b")
            if depth < 0:
                return False
        return depth == 0

    rnd = random.Random(3)
    for _ in range(300):
        s = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9)))
        assert g.accepts("S", s) == derives(s)


def test_long_lists_are_fast():
    assert S.valid(("x = [" + "1, " * 60_000 + "]").encode(), ".js")
    assert S.valid(b"int a[] = {" + b"0x1f," * 40_000 + b"0};", ".c")
    assert S.valid(b"(" * 300 + b"1" + b")" * 300, ".js")


NESTED = [
    ("const a = `x ${ f(`y ${ z } w`) } v`;\n", ".js", True),
    ("const a = `x ${ f(`y ${ z  w`) } v`;\n", ".js", False),
    ("const a = `x ${ a b } v`;\n", ".js", False),
    ("const s = html`<p>${x}</p>`; type T = `a${B}`;\n", ".ts", True),
    ("const A = () => <div className=\"a\" x={y > 1}>it's {name} and <b/>{list.map(x => <li key={x}>{x}</li>)}</div>;\n", ".jsx", True),
    ("function f() {\n  return (\n    <>\n      <p>don't</p>\n      {ok && <B {...p} />}\n    </>\n  );\n}\n", ".js", True),
    ("function f() {\n  return (\n    <p>don't</b>\n  );\n}\n", ".jsx", False),
    ("const A = <p>{a b}</p>;\n", ".jsx", False),
    ("const x = <T,>(a: T): T => a;\nconst B = (p: P) => <div onClick={() => p.f<string>(1)}>{p.x as string}</div>;\n", ".tsx", True),
    ("const x = <string>y;\n", ".tsx", True),
    ("const x = <string>y;\n", ".ts", True),
    ("const B = () => <div>a</div>;\n", ".ts", False),
    ("if (a < b) { c(d > e); }\nfor (let i = 0; i < n; i++) {}\n", ".js", True),
    ("int f(int x) { return -(int)x + !(a)b; }\n", ".c", True),
    ("class A { boolean f() { return !(boolean) x; } }\n", ".java", True),
    ("class A extends B.c(d) { }\nclass C extends class {} {}\n", ".js", True),
    ("@a.b(c) class A { @Input() name: string; @a.b(c) f() {} }\n", ".ts", True),
    ('f = f"{x["a"]}" + rf"""{y}"""\n', ".py", True),
    ('f = f"{a!r:>{w}}" f"{{"\n', ".py", True),
    ('f = f"{x["a"]\n', ".py", False),
    ("\x03 = 1\n", ".js", False),
]


@pytest.mark.parametrize(("text", "e", "want"), NESTED)
def test_dialects_and_tokens_that_nest(text, e, want):
    assert S.valid(text.encode(), e) is want


def test_indents_of_any_width():
    for w in (7000, 900_000):
        assert S.valid(f"if x:\n{' ' * w}y = 1\n{' ' * w}z = 2\n".encode(), ".py")
        assert not S.valid(f"if x:\n{' ' * w}y = 1\n{' ' * w} z = 2\n".encode(), ".py")


def test_rules_together_are_as_rules_alone():
    lang = S.languages()["typescript"]
    names = sorted(lang.r.g.wants["p"] | lang.r.g.wants["c"])
    for text in ("a: b = c", "a, b, ...c", "a = b; c()", "get x() {}", "a as b", "type a = b"):
        s = S.kinds(lang, text)
        assert lang.r.g.which(names, s) == {n for n in names if lang.r.g.accepts(n, s)}


SCHEMA = "file_id long, project string, path string, content binary, language string, extension string, scanned_at timestamp, valid string"


def test_table(spark):
    t0, t1 = datetime(2025, 1, 1), datetime(2025, 1, 2)
    rows = [(1, b"{", ".json", t0), (1, b"{}", ".json", t1), (2, b"x = (", ".py", t0), (2, b"x = (", ".py", t0), (3, None, ".py", t0), (4, b"a b", ".md", t0), (5, b"", ".go", t0), (6, b"", ".json", None), (None, b"{", ".json", t0), (7, b"{", None, t0), (8, b"{", ".JSON", t0)]
    d = spark.createDataFrame([(k, None if k == 2 else "p", None, c, None, e, t, "x") for k, c, e, t in rows], SCHEMA)
    assert sorted(r[0] for r in S.invalid(d).collect()) == [2, 6, 8]
    r = {(x.project, x.language): (x.files, x.invalid) for x in S.rates(d).collect()}
    assert r["p", "json"] == (3, 2) and r[None, "python"] == (1, 1)
    assert S.invalid(d.where("false")).collect() == []
