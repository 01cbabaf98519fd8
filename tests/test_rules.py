"""Path rules, ignore patterns, secrets and binary content."""

import fnmatch

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import columns as C
from tesserae.operators import rules


def marks(spark, names, column):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, p string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("p"))).collect()]


def test_secret_names(spark):
    secret = [".env", "a/.ENV.local", "id_rsa", "x/server.pem", "a.KEY", ".env.anything", "prod.tfvars", "x.secrets", "secrets.yaml"]
    plain = [".env.example", "key.pem.sample", ".pem", "environment.py", "keys.py", "secrets.json.template", "env"]
    assert marks(spark, secret, rules.is_secret) == [True] * len(secret)
    assert marks(spark, plain, rules.is_secret) == [False] * len(plain)


def test_ignored_directory_is_a_parent(spark):
    names = ["node_modules/a.js", "a/build/b.py", "build", "a/build", "rebuild/a.py", "__pycache__/x.pyc"]
    assert marks(spark, names, rules.in_ignored_directory) == [True, True, False, False, False, True]


@pytest.mark.parametrize(
    ("pattern", "path", "wanted"),
    [
        ("docs/", "docs/a.md", True), ("docs/", "x/docs/a.md", False), ("docs/", "docs", True), ("./docs/", "docs/a", True),
        (".github/", ".github/x", False), (".github/", "github/x", True), ("*.log", "a/b.log", True), ("*.LOG", "a/b.log", False),
        ("tests", "a/tests/b.py", True), ("tests", "a/tests.py", False), ("a?c", "abc", True), ("[!a]b", "cb", True), ("[!a]b", "ab", False),
        ("  ", "x", False), ("a/*.py", "a/b/c.py", True), ("x", "x", True), ("", "x", False), ("a.b", "axb", False),
    ],
)
def test_patterns(spark, pattern, path, wanted):
    assert marks(spark, [path], lambda p: rules.matches_pattern(p, pattern)) == [wanted]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab*?[]!-.c/", min_size=1, max_size=6), st.lists(st.text(alphabet="abc.-/[]!", max_size=6), min_size=1, max_size=8))
def test_globs_match_as_the_shell_does(spark, pattern, names):
    wanted = [fnmatch.fnmatchcase(n, pattern) for n in names]
    assert marks(spark, names, lambda p: p.rlike(rules.glob_regex(pattern))) == wanted


def test_reasons_in_order(spark):
    names = [rules.IGNORE_FILE, "dist/.env", "a.lock", "a.min.js", "yarn.lock", "package-lock.json", ".env", "notes.txt", "a.py"]
    got = marks(spark, names, lambda p: rules.path_skip_reason(p, ["*.txt"]))
    assert got == ["ignore file", "directory", "suffix", "ending", "suffix", "lock file", "secret", "pattern", None]


def test_binary_content(spark):
    contents = [b"", b"plain text\n", b"a\0b", bytes(range(128, 256)), b"abc" + b"\xff", "größe".encode() * 9, b"x" * 9000 + b"\0"]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "i int, c binary")
    assert [r[0] for r in df.orderBy("i").select(C.is_binary(F.col("c"))).collect()] == [False, False, True, True, False, True, False]


def test_blank_and_lines(spark):
    texts = ["", " \n\t", "\x1c\x1f", "a", "a\nb\n", None]
    assert marks(spark, texts, C.is_blank) == [True, True, True, False, False, True]
    assert marks(spark, ["", "a", "a\nb\n"], C.line_count) == [1, 1, 3]


def test_extension(spark):
    assert marks(spark, ["a/b.py", ".gitignore", "Makefile", "a.b.TS", "x/.env.local", "a."], C.extension) == ["py", "", "", "TS", "local", ""]


def test_read_patterns():
    assert rules.read_patterns("# note\n\n *.py \n #kept\n!x\n") == {"*.py", "#kept", "!x"}
