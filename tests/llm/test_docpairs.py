from datetime import datetime

import pytest

from siltstone.llm import docpairs as D

DOC = "Reads the whole cache and counts it."
CASES = [
    ("python", f'def f(a, b=1):\n    """{DOC}"""\n', {("f", 1)}),
    ("python", f'class A:\n    x = 1\n    async def g(self):\n        r\'\'\'{DOC}\n        \'\'\'\n\ndef h():\n    x = 1\n    """{DOC}"""\n', {("g", 3)}),
    ("python", f'if x:\n    def f():\n        """{DOC}"""\ndef g():\n    def h():\n        """{DOC}"""\n    f"""{DOC}"""\n', set()),
    ("python", f'def f(\n    a,\n):\n    # note\n\n    "{DOC}"\n', {("f", 1)}),
    ("javascript", f"/** {DOC} */\nexport async function f(a, {{ b }}) {{ function g() {{}} }}\n", {("f", 2)}),
    ("javascript", f"/**\n * {DOC}\n * @param a x\n */\nconst f = async (a) => a;\n// {DOC}\nfunction g() {{}}\n/* {DOC} */\nfunction h() {{}}\n", {("f", 5)}),
    ("javascript", f"/** {DOC} */\n\nfunction f() {{}}\n/** {DOC} */\nconst x = 1;\nclass A {{\n  /** {DOC} */\n  static async m(a) {{ if (a) {{ }} }}\n  /** {DOC} */\n  p = () => 1;\n}}\n", {("m", 8), ("p", 10)}),
    ("typescript", f"export class A<T> {{\n    /**\n       {DOC}\n     */\n    @Input()\n    private m<K>(a: Map<string, K>): Promise<K> {{ return a; }}\n}}\n/** {DOC} */\n// eslint-disable-next-line\nexport const f = <T,>(x: T): T => x;\n", {("m", 6), ("f", 10)}),
    ("java", f"public class A {{\n    /** {DOC} */\n    @Override\n    public static <T> List<T> f(int a, String... b) throws X {{ }}\n\n    /** {DOC} */\n    A(int x) {{ }}\n    /** {{@inheritDoc}} */\n    void g() {{ }}\n    // {DOC}\n    void h() {{ }}\n}}\n", {("f", 4), ("A", 7)}),
    ("go", f"package a\n\n// F {DOC}\n//\n//go:noinline\nfunc (s *T) F(a int) (int, error) {{\n\treturn 1\n}}\n// {DOC}\n\nfunc g() {{}}\n/* {DOC} */\nfunc h() {{}}\n", {("F", 6)}),
    ("rust", f"/// {DOC}\n#[inline]\npub(crate) fn f<'a>(x: &'a str) -> u8 {{ fn inner() {{}} }}\n// {DOC}\nfn g() {{}}\nimpl A {{\n    /// {DOC}\n    pub async fn m(&self) {{ let c = '{{'; }}\n}}\nmod t {{\n    /// {DOC}\n    fn n() {{}}\n}}\n", {("f", 3), ("m", 8)}),
    ("c", f"/**\n * {DOC}\n */\nstatic const char *f(unsigned a)\n{{\n    report(\"}}\");\n}}\n/** {DOC} */\n#pragma x\nint g(void);\n/* {DOC} */\nint h(void) {{ }}\n", {("f", 4), ("g", 10)}),
]


@pytest.mark.parametrize(("language", "text", "want"), CASES)
def test_documented(language, text, want):
    assert {(s[1], s[2]) for s in D.symbols(language, text) if not D.trivial(s[6], s[1])} == want


@pytest.mark.parametrize(
    ("doc", "name", "dull"),
    [(None, "f", True), ("", "f", True), ("TODO: document", "f", True), ("one two three four", "f", True), ("one two three four five", "f", False), ("@param a one two three four five six", "f", True), ("The load orchard preset of it", "load_orchard_preset_of_it", True), ("loadOrchardPresetOfIt", "loadOrchardPresetOfIt", True), ("- - - - - -", "f", True), ("计算缓存中的条目", "f", False)],
)
def test_trivial(doc, name, dull):
    assert D.trivial(doc, name) is dull


def test_table_and_pairs(spark):
    t0, t1 = datetime(2025, 1, 1), datetime(2025, 1, 2)
    header = f"/** {DOC} */\nint f(int a, char *b);\n/** {DOC} */\nint lone(void);\n".encode()
    source = b"int f(int x, char *y) { return 1; }\n"
    rows = [(1, "p", "a.c", header, ".c", t0), (2, "p", "b.c", source, ".c", t0), (3, "q", "b.c", source, ".c", t0), (4, "p", "c.py", f'def f():\n    """{DOC}"""\n'.encode(), ".py", t0), (4, "p", "c.py", b"def f(:\n", ".py", t1), (5, "p", None, None, ".py", t0), (None, "p", "x.c", header, ".c", t0), (6, None, "d.c", b"/** " + DOC.encode() + b" */\nint f(void) {", ".c", None)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "file_id long, project string, path string, content binary, extension string, scanned_at timestamp, name string")
    assert sorted(tuple(r) for r in D.documented(d).collect()) == [(1, 2, "f"), (1, 4, "lone")]
    got = {r.name: (r.parameters, r.defined_in, r.defined_at) for r in D.pairs(d).collect()}
    assert got == {"f": (["a", "b"], 2, 1), "lone": (["void"], None, None)}
    assert D.documented(d.where("false")).collect() == []


def names(language, text):
    return [(x[1], x[3], x[6]) for x in D.symbols(language, text)]


def test_beyond_former_bounds():
    doc = "/** Says what the function does in enough words. */\n"
    lines = "".join(f'    @Part(name = "a{i}", of = {{X.class}}),\n' for i in range(40))
    java = f"class A {{\n{doc}@Many({{\n{lines}}})\npublic int run(int a) {{ return a; }}\n}}\n"
    assert [(n, bool(d)) for n, _, d in names("java", java)] == [("run", True)]
    deco = "class A {\n" + doc + "@Input({\n" + "  a: [1, (2)],\n" * 60 + "})\nrun(a) { return a }\n}\n"
    assert [(n, bool(d)) for n, _, d in names("typescript", deco)] == [("run", True)]
    rust = "trait T {\n    /// Says what it does in enough words.\n    fn f<A>(&self, a: A) -> A\n    where\n" + "        A: Into<Vec<u8>> + Clone,\n" * 60 + "    ;\n}\n"
    assert names("rust", rust) == [("f", False, "Says what it does in enough words.")]
    deep = doc + "function f(a = g(h(i(j(k(1))))), b) { return a }\n"
    (s,) = D.symbols("javascript", deep)
    assert s[1] == "f" and s[4] == ["a", "b"] and s[6]
    (s,) = D.symbols("python", "def f(a=g(h(i(j(k(1))))), b=2):\n    pass\n")
    assert s[1] == "f" and s[4] == ["a", "b"]
    shrunk = "".join(f"function f{i}(a){{return a+{i}}}" for i in range(20))
    assert len(list(D.symbols("javascript", shrunk))) == 20


def test_flat_keeps_length_and_lines():
    t = "f(a(b(c(d(\ne)))))\n{ g(h(i(j()))) }"
    assert len(D.flat(t)) == len(t) and D.flat(t).count("\n") == 2 and D.flat("f(a(b(c)))") == "f(a(b(c)))"


def test_found_by_the_join(spark):
    """p5_found gives where the descriptions of p5_pairs stand: one table of all symbols, one join with the definitions."""
    t = datetime(2025, 1, 1)
    header = f"/** {DOC} */\nint f(int a);\n/** {DOC} */\nint g(long a);\n/** {DOC} */\nint h(int a);\n/** {DOC} */\nint lone(int a);\n/** {DOC} */\nint own(void) {{ return 1; }}\nint bare(int a);\n".encode()
    source = b"int f(int x) { return x; }\nint g(int x) { return x; }\nint h(char x) { return x; }\nint h(long x) { return x; }\nint bare(int x) { return x; }\n"
    rows = [(1, "p", "a.h", header, ".h", t), (2, "p", "b.c", source, ".c", t), (3, "p", "c.c", b"int lone(int x) { return x; }\nint broken(", ".c", t), (4, None, "a.h", header, ".h", t), (5, None, "b.c", source, ".c", t)]
    # Of two deliveries of one time the one with more symbols counts, documented or not.
    rows += [(6, "p", "d.py", f'def one():\n    """{DOC}"""\n'.encode(), ".py", t), (6, "p", "d.py", b"def two():\n    pass\ndef three():\n    pass\n", ".py", t)]
    d = spark.createDataFrame(rows, "file_id long, project string, path string, content binary, extension string, scanned_at timestamp")
    places = {(2, "f"), (4, "g"), (6, "h"), (8, "lone"), (10, "own")}
    found = D.documented(d)
    assert sorted(tuple(r) for r in found.collect()) == sorted((k, *x) for k in (1, 4) for x in places)
    got = {(r.file_id, r.name): (r.defined_in, r.defined_at, r.parameters, r.docstring) for r in D.pairs(d).collect()}
    a = (["a"], DOC)
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {"f": (2, 1, *a), "g": (2, 2, *a), "h": (None, None, *a), "lone": (None, None, *a), "own": (1, 10, ["void"], DOC)}
    assert {k[1]: v[:2] for k, v in got.items() if k[0] == 4} == {"f": (None, None), "g": (None, None), "h": (None, None), "lone": (None, None), "own": (4, 10)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "Join LeftAnti" in plan
