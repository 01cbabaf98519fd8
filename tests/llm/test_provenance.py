"""Origin of files: held-out accuracy on our own samples, masked giveaways, odd tables."""

import random
import re

import numpy as np
import pytest

from tesserae.llm.provenance import BULK, GENERATED, MINIFIED, VENDORED, Example, classify, extension, features, giveaway, masked_text, train, validation

WORDS = "amber beacon candle dial ember flag garden harbour island jade kernel lantern mirror notch orbit panel quarry ribbon saddle tablet".split()


def written(rng, i):
    lines = [f"def {rng.choice(WORDS)}_{rng.choice(WORDS)}(a, b):\n    # {rng.choice(WORDS)} of the {rng.choice(WORDS)}\n    {rng.choice(WORDS)} = a * {rng.randint(2, 99)}\n    if b > {rng.randint(2, 50)}:\n        return {rng.choice(WORDS)}(b)\n    return a - b\n" for _ in range(rng.randint(3, 8))]
    return "\n\n".join(lines)


def generated(rng, i):
    return f"class {rng.choice(WORDS).title()}Message:\n" + "".join(f"    FIELD_{k} = ({k}, '{rng.choice(WORDS)}_{k}', TYPE_{rng.randint(1, 18)})\n" for k in range(rng.randint(8, 20)))


LIBRARY = [written(random.Random(900 + n), n) for n in range(4)]


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(3)
    rows, truth = [], []
    for i in range(500):
        repo, stem = f"r{i % 25}", f"{rng.choice(WORDS)}_{i}"
        kind = rng.choice(["w"] * 6 + ["g", "G", "v", "V", "b", "m"])
        if kind == "g":
            rows.append((repo, f"src/{stem}.py", "# Generated by weaver. DO NOT EDIT.\n" + generated(rng, i)))
        elif kind == "G":  # without its header
            rows.append((repo, f"src/{stem}.py", generated(rng, i)))
        elif kind == "v":
            rows.append((repo, f"vendor/lib/{stem}.py", LIBRARY[i % 4]))
        elif kind == "V":  # somewhere else
            rows.append((repo, f"src/util/{stem}.py", LIBRARY[i % 4].replace("return a - b", "return b - a", 1)))
        elif kind == "b":
            rows.append((repo, f"src/{stem}.py", "DATA = [\n" + "".join(f"    {rng.randint(0, 9999)}, {rng.randint(0, 9999)}, {rng.randint(0, 9999)},\n" for _ in range(60)) + "]\n"))
        elif kind == "m":
            rows.append((repo, f"static/{stem}.min.js", "var q=function(a){return a+" + "".join(f"b{rng.randint(0, 9)}(c[{rng.randint(0, 99)}])+" for _ in range(90)) + "1};"))
        else:
            rows.append((repo, f"src/{stem}.py", written(rng, i)))
        truth.append(kind != "w")
    return rows, truth


def test_held_out_rows(sample):
    rows, truth = sample
    models, report = train([Example(repo, giveaway(name, text), 0, features(name, text)) for repo, name, text in rows[:350]])
    scores = np.array([(models.scores(features(n, t)) + models.shares[:, 0] - models.borders).max() for _, n, t in rows[350:]])
    right = (scores > 0) == np.array(truth[350:])
    assert right.mean() >= 0.93
    assert all(r.found > 0 for r in report)


@pytest.mark.parametrize(
    ("head", "kind"),
    [
        ("// Copyright (c) 2024 Our Company\n", None), ("// SPDX-License-Identifier: MIT\n// see https://intranet.invalid/a\n", None), ("// Speaks to the upstream server; deps are listed elsewhere.\n", None),
        ("/*! pathkit v3.1.2\n * Copyright (c) the pathkit contributors */\n", VENDORED), ("// Vendored copy of pathkit.\n", VENDORED), ("// Upstream: pathkit, revision 12\n", VENDORED), ("/* (c) 2012 A. B., pathkit 1.0.3 */\n", VENDORED),
    ],
)
def test_a_copyright_alone_is_no_giveaway(head, kind):
    assert giveaway("src/a.js", head + "f(1);\n") == kind
    assert giveaway("deps/a.js", "f(1);\n") is None


def test_long_headers_are_read(sample):
    assert giveaway("src/a.js", "// one line of a long head\n" * 600 + "// Code generated by x. DO NOT EDIT.\nf(1);\n") == GENERATED


def test_copies_of_vendored_files_anywhere(spark, monkeypatch):
    """Libraries whose marked copies are not in the sample are known by what the table holds."""
    rng = random.Random(11)
    libraries = [re.sub("|".join(WORDS), lambda m, n=n: m[0][::-1] + "xyz"[n % 3], written(random.Random(2000 + n), n)) for n in range(60)]
    rows = [(n, f"r{n % 9}", f"vendor/x/lib_{n}.py", libraries[n]) for n in range(60)] + [(100 + n, f"r{(n + 4) % 9}", f"vendor/y/own_{n}.py", libraries[n]) for n in range(60)]
    rows += [(200 + n, f"r{(n + 2) % 9}", f"src/util/{rng.choice(WORDS)}_{n}.py", libraries[n]) for n in range(60)]
    rows += [(1000 + n, f"r{n % 9}", f"src/{rng.choice(WORDS)}_{n}.py", written(rng, n)) for n in range(400)]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, name string, text string")
    monkeypatch.setattr("tesserae.llm.provenance.SAMPLE_KIND", 40)
    found = {r.id for r in classify(df).collect() if r.kind == VENDORED}
    assert len(found & set(range(200, 260))) >= 57 and len(found & set(range(1000, 1400))) <= 8
    report = {r.kind: r for r in validation(df).collect()}
    assert report[VENDORED].examples >= 40 and report[VENDORED].found >= 36 and report[BULK].examples == 0
    assert validation(df.limit(0)).count() == 0


def test_giveaways_are_masked():
    assert giveaway("a/x.py", "# Code generated by x. DO NOT EDIT.\nA = 1\n") == GENERATED
    assert giveaway("node_modules/x/y.js", "a") == VENDORED
    assert giveaway("a/x.min.js", "a=b(1);" * 100) == MINIFIED
    assert giveaway("a/x.c", "int a[] = {\n" + "  1, 2, 3,\n" * 40 + "};\n") == BULK
    assert giveaway("a/x.py", 'H = "Code generated by x. DO NOT EDIT."\n') is None
    assert masked_text("# a\n\n/* b */ x") .strip() == "x"
    assert (features("vendor/a/x.py", "# Generated\nA = 1\n") == features("a/x.py", "A = 1\n")).all()
    assert extension("A/B.PY") == "py" and extension(".env") == "" and extension(None) == ""


def test_table(spark, sample):
    rows, truth = sample
    data = [(i, *r, "x") for i, r in enumerate(rows)] + [(900, "r1", "a.py", None, "x"), (901, "r1", None, "a", "x"), (902, "r1", "a.py", "", "x"), (903, "r1", "notes.md", "x" * 900, "x"), (904, None, "q.py", rows[0][2], "x"), (None, "r1", "q.py", rows[0][2], "x")]
    df = spark.createDataFrame(data, "file_id bigint, repo string, name string, text string, kind string")
    found = {r.id for r in classify(df).collect()}
    assert not found & {900, 901, 902, 903}
    right = sum((i in found) == t for i, t in enumerate(truth))
    assert right / len(truth) >= 0.95
    assert classify(df.limit(0)).count() == 0
    assert classify(df.filter("name = 'notes.md'")).count() == 0
