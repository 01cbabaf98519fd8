"""Functions and their documentation: places, forms, trivial texts."""

import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm.docpairs import extract, functions, informative, pairs

DOC = "Reads every open slot of the given tray and counts them."


def lines(extension, text):
    return [(p.name, p.def_line) for p in pairs(extension, text)]


@pytest.mark.parametrize(
    ("extension", "text", "wanted"),
    [
        ("py", f'def f(a):\n    """{DOC}"""\n    def g():\n        \'\'\'{DOC}\'\'\'\n', [("f", 1), ("g", 3)]),
        ("py", f"# {DOC}\n@wrap(\n  1)\nasync def f(a) -> int:\n    return 1\n", [("f", 4)]),
        ("py", f"# {DOC}\n\ndef f(a):\n    return 1\n", []),
        ("py", f"x = '''\ndef g():\n    \"\"\"{DOC}\"\"\"\n'''\ndef f(): \"{DOC}\"\n", [("f", 5)]),
        ("py", f'def f():\n    f"""{DOC}"""\n', []),
        ("py", f"y = 1  # {DOC}\ndef f():\n    pass\n", []),
        ("js", f"/** {DOC} */\nexport default async function f(a) {{}}\n// {DOC}\nconst g = async (a) => a;\nclass A {{\n  /* {DOC} */\n  static get h() {{ return 1 }}\n  // {DOC}\n  k = () => 1;\n}}\n", [("f", 2), ("g", 4), ("h", 7), ("k", 9)]),
        ("js", f"// {DOC}\nif (a) {{ b() }}\n// {DOC}\nf(a, b);\n// {DOC}\nconst x = 1;\nconst s = `// {DOC}\nfunction f() {{}}`\n", []),
        ("ts", f"/** {DOC} */\nfunction f(a: {{ b: string }}): Promise<Map<string, x[]>> {{ return a }}\nabstract class A {{\n  /** {DOC} */\n  abstract g(): void;\n  /** {DOC} */\n  @dec() private async h<T>(a?: T): Promise<T> {{ return a }}\n}}\n", [("f", 2), ("h", 7)]),
        ("go", f"// {DOC}\nfunc (s *T[K]) F(a int) (n int, err error) {{\n}}\n\n// {DOC}\ntype T struct{{}}\n", [("F", 2)]),
        ("java", f"class A {{\n  /** {DOC} */\n  @Override\n  public <T> List<T> f(int a) throws E {{ if (a) {{ }} return new B() {{ }}; }}\n  // {DOC}\n  A() {{ }}\n  /** {DOC} */\n  void g();\n}}\n", [("f", 4), ("A", 6)]),
        ("rs", f"/// {DOC}\n#[inline]\npub(crate) async fn f<'a, T>(a: &'a T) -> Result<T, E> where T: X {{ }}\ntrait B {{\n    /// {DOC}\n    fn g(&self);\n}}\n", [("f", 3)]),
        ("c", f"/* {DOC} */\nstatic int *f(const char *a,\n  int b)\n{{\n  return 0;\n}}\n// {DOC}\nint g(void);\n// {DOC}\nint x = 1;\n", [("f", 2)]),
        ("cpp", f"class A {{\n public:\n  /// {DOC}\n  explicit A(int a) : b(a) {{ }}\n}};\n// {DOC}\ntemplate <typename T>\nauto A<T>::f(T a) const noexcept -> int {{ return 1; }}\n// {DOC}\nbool A::operator==(const A &o) const {{ return true; }}\n", [("A", 4), ("f", 8), ("operator", 10)]),
    ],
)
def test_places(extension, text, wanted):
    assert lines(extension, text) == wanted
    assert lines(extension, text.replace("\n", "\r\n")) == wanted


@pytest.mark.parametrize(
    ("doc", "name", "least"),
    [
        (f"/** {DOC} */", "f", True), ("// tbd", "f", False), ("/** Fetch the row. */", "fetchRow", False), ("// eslint-disable-next-line no-console because it is fine here", "f", False),
        ("// x = load(2);\n// return x + y;", "f", False), ("/** @param rows\n * @return */", "f", False), ("/** return the newest part of each open row. */", "f", True), ("# ----------", "f", False),
        ("/**\n * @param rows the first part of each row\n */", "f", True), (":param a: \n:return:", "f", False), ("Fetches one two three four", "fetch", True), ("one two three four", "f", False),
    ],
)
def test_trivial(doc, name, least):
    assert (informative(doc, name, {"rows", "a"}, "js") >= 5) == least


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["def a(x, y=1): pass", "class B:\n    def c(self):\n        return 1", "x = [1,\n2]", "s = 'def no(): pass'", "async def d():\n    def e(): pass\n    return e", "# def f(): pass", "@w\ndef g(): ..."]), max_size=8))
def test_python_functions_are_those_of_the_parser(parts):
    text = "\n".join(parts) + "\n"
    wanted = sorted((n.name, n.lineno) for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)))
    assert sorted((f[0], f[1]) for f in functions("py", text)) == wanted


def test_table(spark):
    good = f'def f(a):\n    """{DOC}"""\n'
    rows = [(1, "a.py", good, 0), (1, "a.py", good, 0), (2, "a.py", good + "x = (", 0), (3, "a.md", good, 0), (4, "a.py", None, 0), (5, None, good, 0), (None, "b.py", good, 0), (6, "b.py", "", 0), (7, "c.py", "x = 1\n" * 30_000 + good, 0)]
    df = spark.createDataFrame(rows, "file_id bigint, name string, text string, doc int")
    got = sorted((r.id or 0, r.def_line, r.doc, r.code.startswith("def f")) for r in extract(df).collect())
    assert got == [(0, 1, DOC, True), (1, 1, DOC, True), (1, 1, DOC, True), (7, 30_001, DOC, True)]
    assert extract(df.limit(0)).count() == 0


def test_long_headers_and_deep_margins():
    """Headers of thousands of tokens and margins of any width are read whole."""
    from tesserae.llm.docpairs import pairs

    doc = "/** Adds up every one of the many values that are given. */\n"
    java = "class A {\n" + doc + "int addAll(" + ", ".join(f"int a{i}" for i in range(3000)) + ") { return 1; }\n}\n"
    assert [(p.name, p.def_line) for p in pairs("java", java)] == [("addAll", 3)]
    cpp = doc + "Many::Many() : " + ", ".join(f"a{i}(0)" for i in range(3000)) + " { }\n"
    assert [(p.name, p.def_line) for p in pairs("cpp", cpp)] == [("Many", 2)]
    ts = doc + "function addAll(" + ", ".join(f"a{i}: number" for i in range(3000)) + "): number { return 1 }\n"
    assert [(p.name, p.def_line) for p in pairs("ts", ts)] == [("addAll", 2)]
    deep = "if a:\n" + " " * 5000 + "def shown(b):\n" + " " * 5001 + '"""Shows every one of the many given values."""\n'
    assert [(p.name, p.def_line) for p in pairs("py", deep)] == [("shown", 2)]


def test_comments_without_definitions_stay_cheap():
    """Behind each comment a few tokens are read, not the rest of the text."""
    import time

    from tesserae.llm.docpairs import pairs

    text = "// one more line of plain remarks here\nx = y + z\n" * 6000
    begun = time.process_time()
    assert list(pairs("js", text)) == list(pairs("py", "-" * 300_000)) == []
    assert time.process_time() - begun < 20
