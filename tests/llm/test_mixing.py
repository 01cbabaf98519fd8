"""Mixing: weights, budgets, repetition limits and reported shares."""

import math

import pytest
from pyspark.sql import functions as F

from tesserae.llm import mixing
from tesserae.llm.mixing import entropy, exponent_for_entropy, mix, plan, plan_weights, report, sized, tempered


def test_reachability_is_plain_arithmetic():
    made = {r[0]: r for r in plan_weights({"a": 100, "b": 10, "c": 890}, {"a": (0.5, 4), "b": (0.1, 10), "c": (0.35, 1), "d": (0.05, 9)})}
    assert {s: r[5] for s, r in made.items()} == {"a": False, "b": True, "c": True, "d": False}
    assert made["a"][8] == 400 and made["d"][8] == 0  # all they have
    assert made["b"][8] in (99, 100) and made["c"][8] in (499, 500)  # share the rest by one exponent, within the limit of b
    assert made["b"][6] == made["c"][6] and 0 < made["b"][6] < 1 and sum(r[7] for r in made.values()) == pytest.approx(1)


def test_targets_within_limits_are_met_at_exponent_zero():
    made = {r[0]: r for r in plan_weights({"a": 400, "b": 600}, {"a": (0.7, 2), "b": (0.3, 1)})}
    assert made["a"][6] == made["b"][6] == 0 and made["a"][8] == 700 and made["b"][8] == 300


def test_reachable_sources_keep_their_proportions():
    made = {r[0]: r for r in plan_weights({"a": 1, "b": 500, "c": 499}, {"a": (0.1, 2), "b": (0.6, 5), "c": (0.3, 5)})}
    assert not made["a"][5] and made["a"][8] == 2
    assert made["b"][8] / made["c"][8] == pytest.approx(2, rel=0.01) and made["b"][8] + made["c"][8] in (997, 998)


def test_all_sources_at_their_limits():
    made = {r[0]: r for r in plan_weights({"a": 10, "b": 990}, {"a": (0.9, 3), "b": (0.1, 1)})}
    assert made["a"][8] == 30 and made["b"][8] == 970
    made = {r[0]: r for r in plan_weights({"a": 10, "b": 90, "c": 900}, {"a": (0.9, 3), "b": (0.1, 1)})}
    assert made["a"][8] == 30 and made["b"][8] == 90 and not made["b"][5]


def test_entropy_target():
    natural = [0.7, 0.2, 0.1]
    wanted = 1.0
    a = exponent_for_entropy(natural, wanted)
    assert entropy(tempered(natural, [1.0] * 3, a)) == pytest.approx(wanted, abs=1e-6)
    assert sum(r[7] for r in plan_weights({"a": 70, "b": 20, "c": 10}, {}, 1.0)) == pytest.approx(1.0)


def test_limits_that_are_missing():
    made = {r[0]: r for r in plan_weights({"a": 10, "b": 90}, {"a": (0.9, None), "b": (None, 1)})}
    assert made["a"][5] and made["a"][8] == 100 and made["b"][8] == 0
    assert plan_weights({}, {"a": (1.0, 1)})[0][8] == 0


@pytest.fixture
def sizes(spark):
    rows = [(i, "hot" if i % 3 else "small", 10 + i % 7) for i in range(3000)] + [(9000 + i, "tiny", 5) for i in range(3)]
    return spark.createDataFrame(rows, "id bigint, source string, tokens bigint")


def test_mix_meets_budgets(spark, sizes):
    targets = spark.createDataFrame([("hot", 0.3, 1), ("small", 0.69, 5), ("tiny", 0.01, 2)], "source string, target_share double, max_repeats int")
    weights = plan(sizes, targets)
    mixed = mix(sizes, weights).cache()
    uses = {(r.source, r.id): r["count"] for r in mixed.groupBy("source", "id").count().collect()}
    limit = {"hot": 1, "small": 5, "tiny": 2}
    assert all(n <= limit[s] for (s, _), n in uses.items())
    rows = {r.source: r for r in report(mixed, weights).collect()}
    for r in rows.values():
        assert r.planned_tokens - 20 <= r.mixed_tokens <= r.planned_tokens
    assert {s for s, r in rows.items() if not r.reachable} == {"tiny"}
    assert math.isclose(sum(r.reached_share for r in rows.values()), 1.0)
    passes = mixed.groupBy("source", "pass_no").agg({"id": "count", "place": "max"}).collect()
    assert all(r["count(id)"] == 1000 for r in passes if r.source == "small" and r.pass_no < max(x.pass_no for x in passes if x.source == "small"))
    shares = mixed.withColumn("tenth", F.least((mixed["position"] * 10).cast("int"), F.lit(9))).groupBy("tenth", "source").agg({"tokens": "sum"}).collect()
    for source in ("hot", "small"):  # every tenth of the mix holds the sources alike
        parts = [r["sum(tokens)"] for r in shares if r.source == source]
        assert len(parts) == 10 and max(parts) < 2.5 * min(parts)
    again = mix(sizes, weights)
    assert again.exceptAll(mixed).count() == 0


def test_sizes(spark):
    df = spark.createDataFrame([(1, "a", "two words", 0), (2, None, "x", 0), (3, "a", None, 0), (4, "b", "", 0), (1, "a", "two words", 0), (5, "b", "<|endoftext|>", 0)], "doc_id bigint, source string, text string, tokens int")
    got = sorted((r.id, r.source, r.tokens) for r in sized(df).collect())
    assert got[0][2] == got[1][2] == 2 and (3, "a", 0) in got and (4, "b", 0) in got and len(got) == 5
    assert got[-1][2] > 1
    empty = plan(sized(df.limit(0)), spark.createDataFrame([("a", 0.5, 1), ("z", 0.0, 1), (None, 0.5, 1)], "source string, target_share double, max_repeats int"))
    assert {r.source: r.reachable for r in empty.collect()} == {"a": False, "z": True}
    assert mix(sized(df.limit(0)), empty).count() == 0


def test_short_sources_are_read_from_the_mix(spark):
    docs = spark.createDataFrame([(i, "big", "one two three four", 0) for i in range(40)] + [(90, "rare", "one", 0), (91, None, "one two", 0), (92, "spare", None, 0)], "doc_id bigint, source string, text string, capacity int")
    targets = spark.createDataFrame([("big", 0.6, 1), ("rare", 0.2, 5), ("gone", 0.1, 3), ("spare", 0.1, 3)], "source string, target_share double, max_repeats int")
    assert sorted(r.source for r in mixing.short_sources(docs, targets).collect()) == ["gone", "rare", "spare"]
    assert sorted(r.source for r in mixing.short_sources(docs.limit(0), targets).collect()) == ["big", "gone", "rare", "spare"]


def test_repeated_targets_and_skew(spark, sizes):
    targets = spark.createDataFrame([("hot", 0.5, 1), ("hot", 0.4, 1), ("small", 0.5, 3)], "source string, target_share double, max_repeats int")
    made = {r.source: r for r in plan(sizes, targets).collect()}
    assert made["hot"].target_share == 0.5 and made["tiny"].budget == 0
    assert mixing.RANGES == 4096
