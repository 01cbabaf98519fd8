"""Change logs and their application."""

import pytest

from tesserae.operators.index import apply_changes, plan_changes
from tesserae.sources.changes import Change, parse_changes, parse_lines, parse_logs
from tesserae.streaming.feed import ActionTable, counted_by_window, latest_action, read_feed, run_feed


def test_lines():
    assert parse_changes("A\ta.py\nM\tb.py\n\nD\tc d.py\nR100\told\tnew\nC75\tx\ty\n") == [Change("A", "a.py"), Change("M", "b.py"), Change("D", "c d.py"), Change("R", "old", "new"), Change("A", "y")]
    assert parse_changes("") == [] == parse_changes(b"")


def test_records():
    assert parse_changes(b"M\0a [b].py\0R090\0o\0n\0C100\0x\0y\0T\0z\0") == [Change("M", "a [b].py"), Change("R", "o", "n"), Change("A", "y"), Change("T", "z")]
    assert parse_changes(b"A\0\xff.py\0")[0].path.encode("utf-8", "surrogateescape") == b"\xff.py"


@pytest.mark.parametrize("raw", [b"M\0a", b"M\0", b"R1\0a\0", b"Q\0a\0", b"M\0\0", b"R\0a\0b\0"])
def test_malformed_records(raw):
    with pytest.raises(ValueError, match="malformed NUL-delimited diff"):
        parse_changes(raw)


@pytest.mark.parametrize("raw", ["A\n", "R100\told\n", "\tx\n"])
def test_malformed_lines(raw):
    with pytest.raises(ValueError, match="malformed diff line"):
        parse_changes(raw)


def test_logs_of_both_forms_in_a_table(spark):
    logs = [("one", b"M\0a b\0R090\0o\0n\0"), ("two", b"A\tx\nD\ty\n"), ("three", None), ("four", b"")]
    df = spark.createDataFrame(logs, "commit_sha string, raw binary")
    got = [tuple(r) for r in parse_logs(df).orderBy("commit_sha", "ord").collect()]
    assert got == [("one", 0, "M", "a b", None), ("one", 1, "R", "o", "n"), ("two", 0, "A", "x", None), ("two", 1, "D", "y", None)]
    for bad, message in ((b"M\0a", "malformed NUL"), (b"A\0\xff.py\0", "not UTF-8")):
        with pytest.raises(Exception, match=message):
            parse_logs(spark.createDataFrame([("x", bad)], "commit_sha string, raw binary")).collect()


def test_lines_in_spark_agree(spark):
    text = ["A\ta", "R100\to\tn", "C1\tx\ty", "D\td", "", "T\tt"]
    got = parse_lines(spark.createDataFrame(list(enumerate(text)), "ord int, line string")).orderBy("ord").collect()
    assert [Change(r.status, r.path, r.new_path) for r in got] == parse_changes("\n".join(text))


def test_plan(spark):
    rows = [("D", "gone", None), ("R", "old", "new"), ("R", "same", "same"), ("M", "kept", None), ("A", "missing", None), ("X", "odd", None), ("M", "hidden", None), ("M", "kept", None), ("D", "both", None), ("A", "both", None)]
    changes = spark.createDataFrame(rows, "status string, path string, new_path string")
    there = ["new", "same", "kept", "odd", "hidden", "both"]
    present = spark.createDataFrame([(p,) for p in there], "path string")
    plan = {(r.path, r.action) for r in plan_changes(changes, present, present.filter("path <> 'hidden'")).collect()}
    assert plan == {("gone", "delete"), ("old", "delete"), ("hidden", "delete"), ("both", "delete"), ("new", "upsert"), ("same", "upsert"), ("kept", "upsert"), ("odd", "upsert"), ("both", "upsert")}


def test_apply(spark):
    table = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "file string, v int")
    fresh = spark.createDataFrame([("b", 2), ("d", 2), ("c", 2)], "file string, v int")
    deleted = spark.createDataFrame([("a",), ("c",), ("zz",)], "file string")
    assert sorted(map(tuple, apply_changes(table, fresh, deleted).collect())) == [("b", 2), ("c", 2), ("d", 2)]


def test_feed_is_applied_once(spark, tmp_path):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    row = lambda i, s, p, n=None, h=0: (i, "r", 0, s, p, n, "c", at + datetime.timedelta(hours=h), at)
    kind = "change_id bigint, repo string, ord int, status string, path string, new_path string, commit_sha string, committed_at timestamp, received_at timestamp"
    source = str(tmp_path / "in")
    spark.createDataFrame([row(1, "A", "a"), row(2, "D", "a", h=1), row(3, "A", "b"), row(4, "R", "b", "c", 2), row(5, "D", "c", h=0)], kind).write.parquet(source)
    seen = []
    stream = read_feed(spark, source)
    apply = lambda df, n: seen.append(sorted(tuple(r)[:3] for r in latest_action(df).collect()))
    run_feed(stream, apply, "t", str(tmp_path / "offsets"))
    assert seen == [[("r", "a", "delete"), ("r", "b", "delete"), ("r", "c", "upsert")]]
    run_feed(read_feed(spark, source), apply, "t", str(tmp_path / "offsets"))
    assert len(seen) == 1
    spark.createDataFrame([row(6, "M", "a", h=3)], kind).write.mode("append").parquet(source)
    run_feed(read_feed(spark, source), apply, "t", str(tmp_path / "offsets"))
    assert seen[1:] == [[("r", "a", "upsert")]]
    table = ActionTable(spark, str(tmp_path / "table"))
    assert table.rows().count() == 0
    late = spark.createDataFrame([row(7, "D", "c", h=1), row(8, "M", "b", h=9)], kind)  # of an earlier commit than what is known of c
    for n, batch in enumerate((spark.read.schema(kind).parquet(source), late, late)):
        table.apply(batch, n)
    assert sorted(tuple(r)[:3] for r in table.rows().collect()) == [("r", "a", "upsert"), ("r", "b", "upsert"), ("r", "c", "upsert")]
    assert counted_by_window(read_feed(spark, source)).isStreaming
