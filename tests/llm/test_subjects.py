"""Subjects: held-out accuracy, stray sentences, data columns, odd tables."""

import random

import pytest

from tesserae.llm.subjects import areas, calibration, sentences, subject_models

TERMS = {
    "law": ["appeal rulings", "contract clauses", "tribunal hearings", "witness lists", "tenancy cases"],
    "music": ["chord changes", "drum loops", "choir tapes", "violin bowing", "song lyrics"],
    "cooking": ["rye starters", "oven heat", "broth colour", "pie crusts", "spice blends"],
}
COLUMNS = {"law": ["case_no", "fine_amt"], "music": ["tempo_bpm", "octave"], "cooking": ["oven_c", "flour_g"]}
FRAMES = ["We compare {a} with {b} over 9 weeks.", "After cleaning, {a} no longer follow {b}.", "The table lists {a} by group.", "Missing values of {a} were filled from {b}.", "A first model of {a} explains {b}."]


def prose(rng, subject, n):
    return " ".join(rng.choice(FRAMES).format(a=rng.choice(TERMS[subject]), b=rng.choice(TERMS[subject])) for _ in range(n))


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(7)
    docs, truth = [], {}
    for i in range(600):
        main, other = rng.sample(sorted(TERMS), 2)
        kind = rng.choice(["one", "stray", "two", "columns", "none"])
        body = prose(rng, main, rng.randint(4, 9))
        truth[i] = {main}
        if kind == "stray":
            body += " " + prose(rng, other, 1)
        elif kind == "two":
            body += "\n\n" + prose(rng, other, rng.randint(4, 8))
            truth[i] = {main, other}
        if kind == "columns":
            text = f"# %%\nframe['{COLUMNS[main][0]}']\n\n# %%\nframe[['{COLUMNS[main][1]}', '{COLUMNS[main][0]}']]\n"
        elif kind == "none":
            text, truth[i] = "# %%\nx = 3\nx\n", set()
        else:
            text = "# %% [markdown]\n# " + body.replace("\n", "\n# ") + "\n\n# %%\nx = 1\n"
        docs.append((i, text))
    labels = [(i, i, rng.choice([str.upper, str.lower, lambda s: f" {s} "])(s)) for i in range(0, 400) for s in truth[i]]
    labels += [(900 + i, i, "cooking") for i in range(0, 400, 40)] + [(950, 1, None), (951, 2, "unknown"), (952, None, "law")]
    return docs, truth, labels


def frames(spark, tables, extra=()):
    docs, _, labels = tables
    return (
        spark.createDataFrame([(*d, "x") for d in [*docs, *extra]], "doc_id bigint, text string, subject string"),
        spark.createDataFrame([(s, "d") for s in TERMS], "subject string, description string"),
        spark.createDataFrame(labels, "label_id bigint, doc_id bigint, subject string"),
    )


def test_held_out_accuracy(spark, tables):
    extra = [(700, None), (701, ""), (702, tables[0][0][1]), (702, tables[0][0][1]), (None, tables[0][0][1])]
    got = {}
    for r in areas(*frames(spark, tables, extra)).collect():
        got.setdefault(r.doc_id, []).append(r.subject)
    held = range(400, 600)
    right = sum(set(got.get(i, [])) == tables[1][i] for i in held)
    assert right / len(held) >= 0.95
    assert 700 not in got and 701 not in got
    assert len(got[702]) == 2 * len(got.get(0, [])) and None in got
    assert all(len(set(v)) <= 2 for v in got.values())


def test_words_seen_once_in_the_sample_are_counted_in_the_corpus(spark, tables):
    rng, rare = random.Random(5), [f"zebra{c}" for c in "abcdefghijkl"]
    docs = [(i, f"# %% [markdown]\n# We compare appeal rulings of {w} with contract clauses.") for i, w in enumerate(rare)]
    docs += [(100 + i, "# %% [markdown]\n# " + prose(rng, s, 6)) for i, s in enumerate(sorted(TERMS) * 10)]
    labels = [(i, i, "law") for i in range(len(rare))] + [(100 + i, 100 + i, s) for i, s in enumerate(sorted(TERMS) * 10)]
    docs += [(1000 + i, f"# %% [markdown]\n# A note on {w}.") for i, w in enumerate(rare * 40)]
    models, *_ = subject_models(*frames(spark, (docs, None, labels)))
    assert all(w in models.rows for w in rare)
    assert models.gains([(w,) for w in rare]).max() < 0


def test_thresholds_are_calibrated_at_any_size(spark, tables):
    docs, _, labels = tables
    for most in (400, 24):
        some = [x for x in labels if x[1] is not None and x[1] < most]
        report = calibration(*frames(spark, (docs, None, some))).collect()
        assert len(report) == 3 and sum(r.documents for r in report) == len({x[1] for x in some if x[2] and x[2].strip().lower() in TERMS})
        assert all(r.precision > 0.5 and r.recall > 0.5 for r in report) or most == 24
    assert calibration(*frames(spark, (docs, None, []))).count() == 0


def test_words_of_the_sample_are_bounded(spark, tables, monkeypatch):
    monkeypatch.setattr("tesserae.llm.subjects.LABELLED_WORDS", 300)
    report = calibration(*frames(spark, tables)).collect()
    assert 1 <= sum(r.documents for r in report) < 20


def test_json_behind_blanks():
    text = '{"cells": [{"cell_type": "markdown", "source": ["One two."]}]}'
    assert sentences("\n" * 500 + text) == sentences(text) == ([("one", "two")], [])


def test_nothing_to_learn_from(spark, tables):
    docs, subjects, labels = frames(spark, tables)
    assert areas(docs, subjects, labels.limit(0)).count() == 0
    assert areas(docs, subjects.limit(0), labels).count() == 0
    assert areas(docs.limit(0), subjects, labels).count() == 0


def test_sentences():
    assert sentences(None) == ([], [])
    prose_, columns = sentences("# %% [markdown]\n# # Title\n#\n# One two. Three!\n\n# %%\nf['a_b']\n\n# out:   a_b  c\n# 0  1 2\n")
    assert prose_ == [("title",), ("one", "two"), ("three",)]
    assert columns[0] == ("=a_b",)


def test_every_header_of_an_output_is_read():
    log = "".join(f"# {i}: 0.{i} of 1.\n" for i in range(400))
    text = f"# %%\nx\n\n# out:   a_b  c\n# 0  1 2\n{log}#    tempo_bpm  octave\n# 0  1 2\n"
    assert sentences(text)[1] == [("=a_b", "=c", "=octave", "=tempo_bpm")]
    assert sentences("# %%\nx\n\n# out: " + log[2:] + "#    tempo_bpm  octave\n# 0  1 2\n")[1] == [("=octave", "=tempo_bpm")]
