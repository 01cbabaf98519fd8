"""Recognisers: valid and broken texts of each language, the engine against brute force."""

import ast
import io
import itertools
import json
import os
import random
import time
import tokenize
import warnings

import pytest

from tesserae.llm.gll import Grammar
from tesserae.llm.grammars import language
from tesserae.llm.syntax import check, parses

VALID = {
    "py": ["", "x = 1", "def f(a, /, b=1, *c: int, d, **e) -> int:\n    '''doc'''\n    return (yield a)\n", "@d(1)\nclass A(B, metaclass=M):\n    async def f(self): pass\n", "match x:\n    case {'a': [1, *r]} if r: pass\n    case A(b=2) | None: pass\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    del a, b\n", "with (open(a) as f, g as h):\n\tx: int = {k: v for k, v in y if k} | {*a, 1}\n", "print 'old'\n", "f'{a}' 'b' if x else lambda a, *b: a\n", "x[1:2, ::3, ...] @= y\nif (n := 1) > 2: pass\nelif z: pass\n", "s = '''\n<<<<<<< HEAD\n'''\n"],
    "json": ['{"a": [1, -2.5e3, "x\\n", null, true], "b": {}}', "3", " [] "],
    "go": ["package a\n\nimport (\n\t\"x\"\n\ty \"z\"\n)\n\ntype T[K any] struct {\n\ta, b int `t`\n\t*E\n}\n\nfunc (t *T[K]) F(a ...int) (n int, err error) {\n\tfor i := 0; i < 3; i++ {\n\t\tif x, ok := m[a]; ok && x != nil {\n\t\t\tcontinue\n\t\t} else if y {\n\t\t}\n\t}\n\tswitch v := x.(type) {\n\tcase int, string:\n\t\treturn\n\tdefault:\n\t\tgo func() { c <- 1 }()\n\t}\n\tselect {\n\tcase v := <-c:\n\t\t_ = v\n\t}\n\treturn map[string][]int{\"a\": {1, 2}}, T{a: 1}\n}\n"],
    "java": ["package a.b;\nimport static c.D.*;\n@A(x = {1, 2}) public final class C<T extends D & E> implements F<List<Map<K, V>>> {\n  private static final int[] X = {1, 2};\n  static { x(); }\n  C(int a) throws E { super(a); }\n  @Override public <R> R f(final int... a) { for (int i = 0, j = 1; i < j; i++) if (a instanceof B b) continue; else break;\n    var r = switch (x) { case 1, 2 -> 3; default -> { yield 4; } };\n    try (var s = t()) { s.run(() -> x, A::b); } catch (A | B e) { throw e; } finally { }\n    int v = (int) x + (a < b ? c >> 2 : d >>> 1); return (R) y; }\n  record P(int x) {}\n  enum E { A(1) { int f() { return 1; } }, B; int g; }\n}\n"],
    "js": ["import a, { b as c } from 'd'\nexport default class extends A {\n  #p = 1\n  static async *g() { yield* x }\n  get [k]() { return this.#p }\n}\nconst { x = 1, ...r } = y, f = async (a, b = 2) => ({ a })\nlabel: for (const [k, v] of m) { if (!k) continue label }\nvar re = /a[/]b/gi, t = `x${a + `n${b}`}y`\nx = a ? b : c ?? d?.e?.[1]?.(2)\ndo { i++ } while (i < 3)\nswitch (x) { case 1: default: break }\n(function () { return })()\n"],
    "ts": ["export abstract class A<T extends B = C> extends D<T> implements E {\n  constructor(private readonly a?: string, public b = 1) { super() }\n  abstract f(x: number): void\n  private g<U>(this: A<U>, ...r: Array<Map<string, U[]>>): x is string { return (y as any)! }\n}\ninterface I { readonly [k: string]: () => void; m?(a: 'x' | 1): Promise<void> }\ntype M<T> = { [K in keyof T]?: T[K] } & (A | B)[]\nenum E { A = 1, B }\ndeclare module 'x' { export const y: typeof z }\nlet v: [a: string, b?: number] = f<string>(x satisfies Y)\n"],
    "rs": ["#![allow(x)]\nuse a::{b, c as d, *};\n#[derive(Debug)]\npub struct P<'a, T: 'a + B = C>(pub &'a mut T) where T: D;\nimpl<T> fmt::Display for P<'_, T> {\n    pub async fn f(&mut self, (a, b): (u8, i64)) -> Result<Vec<Vec<T>>, Box<dyn E>> {\n        let x = if let Some(y) = z? { y } else { return Err(q) };\n        'o: for i in 0..=9 { match i { 1 | 2 if c => {}, A::B { x, .. } => break 'o, _ => vec![1; 2] } }\n        let f = move |a: i32, _| -> u8 { a as u8 };\n        unsafe { *p = 1u8; }\n        /* a /* nested */ b */\n        Ok(r#\"raw\"#.into::<X>())\n    }\n}\nmacro_rules! m { ($x:expr) => { $x } }\n"],
    "c": ["#include <a.h>\n#define X(a) \\\n  ((a) + 1)\ntypedef struct s { unsigned int a : 3; struct s *next; } s_t;\nstatic const char *names[] = { [0] = \"a\", \"b\" \"c\" };\nint (*fp)(int, void *);\n#if A\nint f(int a, ...) {\n#else\nint f(a) {\n#endif\n  for (int i = 0; i < 3; i++) { switch (i) { case 1: case 2: goto end; default: break; } }\n  do { x->y = (char) *p++; } while (!sizeof(int *));\nend:\n  return a ? b : (struct s){ .a = 1 }.a;\n}\n"],
    "cpp": ["template <typename T, int N = 3>\nclass A : public B<T>, private C {\n public:\n  explicit A(int a) noexcept : b_(a), c_{1} {}\n  virtual ~A() = default;\n  A &operator=(const A &o) & = delete;\n  bool operator<(const A &o) const override { return x < o.x; }\n};\nnamespace n { auto f(std::vector<std::pair<int, T>> &&v) -> decltype(v) { for (const auto &[k, w] : v) { if (auto p = g(k); p) continue; } return static_cast<int>(h([&, this](auto x) mutable { return x; })); } }\nint A<int>::x = 1;\nenum class E : int { A, B };\n"],
}
BROKEN = {
    "py": ["def f(:\n", "x = (1\n", "  x = 1\n", "if a:\nb\n", "<<<<<<< HEAD\n", "class A:\n    def f(self)\n", "x = 'a\n", "package a\n", "a b\n", "'''\n"],
    "json": ["", "{'a': 1}", '{"a": 1,}', '["a" 1]', "[1", "// x\n1", "01", '"a\n"'],
    "go": ["package a\nfunc f( {}\n", "package a\nfunc f() {\n", "package a\nfunc f() { x := }\n", "def f(): pass\n"],
    "java": ["class A { void f() { int x = ; } }", "class A {", "class A { void f( }", "def f(): pass\n"],
    "js": ["const = 1", "function f( {", "x = {a: 1", "<html></html>", "{\"a\": 1, \"b\": 2}", "def f(x):\n    return x\n", "a b c"],
    "ts": ["let x: = 1", "interface { }", "class A { f(: void }"],
    "rs": ["fn f( {}", "fn f() { let = 1; }", "struct S { a: }", "def f(): pass\n"],
    "c": ["int f( {", "int x = ;", "#if A\nint x;\n", "package a;\nimport b.c;\n", "# a heading\n"],
    "cpp": ["class A { int f( };", "template <typename> class", "int main() { return }"],
}


@pytest.mark.parametrize(("extension", "text"), [(e, t) for e, ts in VALID.items() for t in ts])
def test_valid(extension, text):
    assert parses(extension, text)
    assert parses(extension, text.replace("\n", "\r\n"))


@pytest.mark.parametrize(("extension", "text"), [(e, t) for e, ts in BROKEN.items() for t in ts])
def test_broken(extension, text):
    assert not parses(extension, text)


@pytest.mark.parametrize("extension", sorted(set(VALID) - {"json", "py"}))
def test_cut_in_the_middle(extension):
    text = VALID[extension][0]
    at = text.rindex("{") + 1
    assert not parses(extension, text[:at])


def standard(text):
    """Whether the standard parser takes a text for Python 3."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError):
            return False
    return True


@pytest.mark.parametrize("pieces", [["a", "f(", "def f(", ")", ": pass", "=1", ",", "*", "**", "/", "b", "lambda", ":"], ["x", "for", "in", "a", ":=", "[", "]", "(", ")", "if", "yield", "not", "and", "{", "}", ":", "**"]])
def test_short_python_agrees_both_ways(pieces):
    for n in range(1, 5):
        for parts in itertools.product(pieces, repeat=n):
            text = " ".join(parts)
            assert bool(language("py").fits(text) & 1) == standard(text), text


@pytest.mark.parametrize("name", ["json/decoder.py", "textwrap.py", "dataclasses.py", "contextlib.py", "typing.py", "traceback.py", "inspect.py", "statistics.py"])
def test_altered_python_files_agree_both_ways(name):
    """Statements of real files with a token taken out, doubled or replaced, or cut off there."""
    with open(os.path.join(os.path.dirname(ast.__file__), name), encoding="utf-8") as file:
        source = file.read()
    assert language("py").fits(source) & 1
    lines = source.splitlines(keepends=True)
    units = ["".join(lines[s.lineno - 1 : s.end_lineno]) for s in ast.parse(source).body]
    rng = random.Random(name)
    for _ in range(150):
        unit = rng.choice([u for u in units if 20 < len(u) < 6000])
        tokens = [t for t in tokenize.generate_tokens(io.StringIO(unit).readline) if t.string.strip() and t.type != tokenize.COMMENT]
        starts = [0, *itertools.accumulate(map(len, unit.splitlines(keepends=True)))]
        t, other = rng.choice(tokens), rng.choice(tokens).string
        a, b = (starts[row - 1] + column for row, column in (t.start, t.end))
        altered = rng.choice([unit[:a] + unit[b:], unit[:b] + " " + other + unit[b:], unit[:a] + other + unit[b:], unit[:a]])
        assert bool(language("py").fits(altered) & 1) == standard(altered), altered


@pytest.mark.parametrize("text", ["async def f():\n    print 'a'\n", "f'{a b}'", "f(a=1, 2)", "def f(a=1, b): pass", "x = f'{a}' + 0777", "1_000L"])
def test_no_dialect_takes_both(text):
    assert not parses("py", text)


@pytest.mark.parametrize("text", ["f'{a['b']!r:>{w}} {{}} {x=}'", "f'\\\\{6*7}'", "rf'\\d{n}'", "f\"\"\"{\n a:%Y\n}\"\"\"", "exec 'a' in b", "if a:\n\tb\n        c\n", "print >>f, 0777, ur'a'\n"])
def test_one_dialect_suffices(text):
    assert parses("py", text)


@pytest.mark.parametrize(("extension", "text"), [("c", "void f() { %s }"), ("java", "class A { void f() { %s } }"), ("js", "function f() { %s }")])
def test_heads_of_loops_are_counted(extension, text):
    assert parses(extension, text % "for (a(); a(); a()) {}")
    for n in (2, 4, 5, 6, 7, 8, 9):
        assert not parses(extension, text % ("for (" + "a();" * n + "a()) {}" if n > 2 else "for (a(); a()) {}"))


def test_collapse_of_repeats_changes_nothing():
    """Against the recogniser without it, for runs of equal items."""
    for extension, head, tail in (("py", "raise ", ""), ("py", "exec a in ", ""), ("py", "x = (", ")"), ("py", "assert ", ""), ("json", "[", "]"), ("go", "package a\nvar x, y = ", "\n"), ("c", "int x = f(", ");")):
        for n in range(1, 9):
            text = head + ", ".join(["1"] * n) + tail
            got = parses(extension, text)
            g = language(extension).grammar
            kept, g._repeats = g._repeats, None
            g._memo.clear()
            try:
                assert bool(language(extension).fits(text)) == got, text
            finally:
                g._repeats = kept
                g._memo.clear()


def test_tables_of_data_are_read_in_no_time():
    """Equal items of several tokens, in literals of a hundred thousand entries; a fault among them is seen."""
    begun = time.process_time()
    for extension, head, item, tail in (("py", "x = {", "'a': (1, -2), ", "}\n"), ("json", "{", '"a": [1, 2], ', '"b": 1}'), ("js", "x = {", "a: 1, ", "};"), ("c", "struct s x[] = {", "{ .a = 1, 2 }, ", "};"), ("java", "class A { int[] x = {", "1 + 2, ", "}; }"), ("go", "package a\nvar x = []T{", "{a: 1}, ", "}\n")):
        assert parses(extension, head + item * 100_000 + tail), extension
        assert not parses(extension, head + item * 50_000 + "= " + item * 50_000 + tail), extension
    assert time.process_time() - begun < 60


def test_arguments_of_decorators_and_all_branches_are_recognised():
    assert parses("ts", "@A({ a: 1, b: [x] })\nexport class B { @C() d: string; constructor(@E(F) private g: H) {} }")
    assert not parses("ts", "@A({ a: 1, b: [x })\nexport class B { }")
    assert not parses("ts", "@A({ a: 1,, b })\nexport class B { }")
    assert parses("c", "#if A\nint f(int a) {\n#elif B\nint f(long a) {\n#else\nint f(a) {\n#endif\n  return 1; }\n")
    assert not parses("c", "#if A\nint x;\n#else\nint = ;\n#endif\n")
    assert parses("c", "#if 0\nint = ;\n#else\nint x;\n#endif\n#if 0\n ( \n#endif\n")


def test_against_the_real_parsers():
    pieces = ["a", "=", "(", ")", ",", "1", ":", "[", "]", "if", "else", "*"]
    for n in range(1, 5):
        for parts in itertools.product(pieces, repeat=n):
            text = " ".join(parts)
            assert bool(language("py").fits(text) & 1) == standard(text), text
    marks = ["{", "}", "[", "]", ",", ":", '"a"', "1"]
    for n in range(1, 6):
        for parts in itertools.product(marks, repeat=n):
            text = "".join(parts)
            try:
                json.loads(text)
                wanted = True
            except ValueError:
                wanted = False
            assert parses("json", text) == wanted, text


def test_engine_handles_left_recursion_ambiguity_and_dialects():
    g = Grammar("Start : Sum\nSum : Sum '+' Sum | @a 'x' | @b 'y' | 'z' | (:Sum:)\n", ["a", "b"])
    c = g.alphabet.char
    text = lambda s: "".join(c(t) for t in s)
    start = g.names["Start"]
    assert g.recognise(start, text("z+z+z+z")) == 3
    assert g.recognise(start, text("x+z")) == 1 and g.recognise(start, text("y+z")) == 2
    assert g.recognise(start, text("x+y")) == 0 and g.recognise(start, text("z+")) == 0
    nested = "(" + text("x+") + "(" + c("z") + "))"
    assert g.accepts("Start", nested, {"(": ")"}, lambda t: [t]) == 1
    assert g.accepts("Start", nested[:-1], {"(": ")"}, lambda t: [t]) == 0


def test_long_texts():
    assert parses("json", "[" + "1," * 200_000 + "1]")
    assert parses("py", "x = 1\n" * 50_000)
    assert not parses("py", "x = 1\n" * 50_000 + "(")
    assert parses("json", "[" * 300 + "]" * 300)


def test_table(spark):
    rows = [(1, "a.py", "x = 1", 0), (1, "a.py", "x = 1", 0), (2, "a.py", "x = (", 0), (3, "b.md", "(", 0), (4, "c.py", None, 0), (5, None, "(", 0), (6, "d.json", "", 0), (7, "e.PY", "", 0), (None, "f.go", "package", 0), (8, "py", "(", 0), (9, "x/.py", "(", 0)]
    df = spark.createDataFrame(rows, "file_id bigint, name string, text string, valid int")
    got = sorted(((r.id or 0), r.extension, r.valid) for r in check(df).collect())
    assert got == [(0, "go", False), (1, "py", True), (1, "py", True), (2, "py", False), (6, "json", False), (7, "py", True)]
    assert check(df.limit(0)).count() == 0
