"""Index, ask, change, reindex and ask again on a real tree."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tesserae import cli
from tesserae.functions.columns import result_key
from tesserae.operators import index
from tesserae.operators.embed import EmbeddingConfig
from tesserae.plans.runtime import global_rank
from tesserae.settings import load_settings
from tesserae.sources.git import commit_state
from tesserae.sources.repo_tree import read_files, read_tree
from tesserae.sources.snapshot import SnapshotStore


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.invalid", *args], check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "pkg/__init__.py").write_text("")
    (root / "pkg/store.py").write_text("def load_rows(path):\n    return open(path).read()\n")
    (root / "pkg/other.py").write_text("class Walker:\n    def step(self):\n        return 1\n")
    (root / ".gitignore").write_text("*.pyc\n.tesserae/\n")
    (root / ".env").write_text("TOKEN=x\n")
    (root / "node_modules/x.js").write_text("x")
    (root / "image.bin").write_bytes(bytes(range(256)))
    (root / ".tesseraeignore").write_text("# none\nskipped.txt\n")
    (root / "skipped.txt").write_text("skip me")
    git(root, "init", "-q")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    return root


def test_tree_reads_hidden_names(spark, repo):
    names = {r.rel_path for r in read_tree(spark, str(repo), 2).collect() if not r.rel_path.startswith(".git/")}
    assert {"pkg/__init__.py", ".gitignore", ".env", "image.bin"} <= names and "node_modules/x.js" not in names


def test_index_ask_reindex(spark, repo):
    settings = load_settings(repo)
    report = cli.run_index(spark, settings)
    assert (report["scanned"], report["to_index"], report["errors"]) == (4, 4, 0)
    store = SnapshotStore(spark, str(settings.index_path))
    files = {r.file for r in store.indexed_files().collect()}
    assert files == {"pkg/__init__.py", "pkg/store.py", "pkg/other.py", ".gitignore"}
    assert "pkg/__init__.py" not in {r.file for r in store.chunks().collect()}
    said = cli.run_ask(spark, settings, "Where is load_rows defined?")
    assert "[1] Source: pkg/store.py:L1-L2 | Symbol: load_rows | Language: py | Match: exact symbol" in said
    again = cli.run_index(spark, settings)
    assert (again["to_index"], again["unchanged"]) == (0, 4)

    (repo / "pkg/store.py").write_text("def load_all(path):\n    return path\n")
    git(repo, "mv", "pkg/other.py", "pkg/moved.py")
    git(repo, "add", "-A")
    git(repo, "commit", "-qm", "two")
    raw = subprocess.run(["git", "-C", str(repo), "diff", "--name-status", "-z", "-M", "HEAD^", "HEAD"], capture_output=True, check=True).stdout
    report = cli.run_reindex(spark, settings, raw)
    assert (report["deleted"], report["reindexed"]) == (1, 2)
    assert {r.file for r in store.indexed_files().collect()} == {"pkg/__init__.py", "pkg/store.py", "pkg/moved.py", ".gitignore"}
    assert store.meta()["commit_sha"] == commit_state(str(repo))[0]
    assert "load_all" in cli.run_ask(spark, settings, "Where is load_all defined?")
    with pytest.raises(ValueError, match="base commit mismatch"):
        cli.run_reindex(spark, settings, raw)


def test_a_change_writes_only_its_buckets(spark, repo):
    settings = load_settings(repo)
    cli.run_index(spark, settings)
    (repo / "pkg/store.py").write_text("def load_all(path):\n    return path\n")
    cli.run_index(spark, settings)
    store = SnapshotStore(spark, str(settings.index_path))
    placed = store._manifest()["tables"]["file_hashes"]
    assert list(placed.values()).count(2) == 1 and list(placed.values()).count(1) == len(placed) - 1
    assert {r.file for r in store.chunks().collect()} == {"pkg/store.py", "pkg/other.py", ".gitignore"}


def test_only_changed_paths_are_read(spark, repo, monkeypatch):
    settings = load_settings(repo)
    cli.run_index(spark, settings)
    (repo / "pkg/store.py").write_text("def load_all(path):\n    return path\n")
    (repo / "dist").mkdir()
    (repo / "dist/made.js").write_text("x()")
    git(repo, "add", "-A")
    git(repo, "commit", "-qm", "two")
    monkeypatch.setattr(cli, "read_tree", None)
    report = cli.run_reindex(spark, settings, b"M\tpkg/store.py\nA\tdist/made.js\nM\tnot/there.py\nD\tpkg/other.py\nD\ta.py\n")
    assert (report["upserts"], report["reindexed"]) == (1, 1)
    assert [r.file for r in report["removed"].collect()] == ["a.py", "dist/made.js", "pkg/other.py"]


def test_head_that_moves_meanwhile(spark, repo, monkeypatch):
    settings = load_settings(repo)
    head = commit_state(str(repo))[0]
    states = iter([(head, None), ("other", None)])
    monkeypatch.setattr(cli, "commit_state", lambda root: next(states))
    report = cli.run_index(spark, settings)
    store = SnapshotStore(spark, str(settings.index_path))
    assert not report["commit_moved"] and report["errors"] == 0 and store.meta()["commit_sha"] is None and store.version() == 1
    monkeypatch.undo()
    cli.run_index(spark, settings)
    assert store.meta()["commit_sha"] == head
    before = store.version()
    states = iter([("next", head), ("another", head)])
    monkeypatch.setattr(cli, "commit_state", lambda root: next(states))
    with pytest.raises(RuntimeError, match="HEAD changed"):
        cli.run_reindex(spark, settings, b"D\tpkg/store.py\n")
    assert store.version() == before


def test_files_that_vanish_meanwhile(spark, repo):
    settings = load_settings(repo)
    cli.run_index(spark, settings)
    store = SnapshotStore(spark, str(settings.index_path))
    (repo / "pkg/fresh.py").write_text("def fresh():\n    return 1\n")
    root = str(repo)

    def relist():
        return read_tree(spark, root, contents=False).filter("rel_path not in ('pkg/other.py', 'pkg/fresh.py')")

    report = index.index_tree(store, read_tree(spark, root), ["skipped.txt"], settings.embedding, "c", lambda paths: read_files(paths, root), relist)
    assert report["vanished"] == 2
    assert {r.file for r in store.indexed_files().collect()} == {"pkg/__init__.py", "pkg/store.py", ".gitignore"}


def test_a_failed_embedding_stays_with_its_file(spark, repo, monkeypatch):
    """Of files embedded together, one whose text is refused keeps what the index has; the others go on."""
    from tesserae.operators import embed

    settings = load_settings(repo)
    cli.run_index(spark, settings)
    store = SnapshotStore(spark, str(settings.index_path))
    (repo / "pkg/store.py").write_text("def load_all(path):\n    return path\n")
    (repo / "pkg/other.py").write_text("REFUSED = 1\n")
    config = EmbeddingConfig(provider="picky", dim=settings.embedding.dim, model=settings.embedding.model)

    def picky(config):
        class Picky(embed.HashedProvider):
            def embed_batch(self, texts):
                if any("REFUSED" in t for t in texts):
                    raise embed.EmbeddingError("refused")
                return super().embed_batch(texts)

        return Picky(config.dim)

    monkeypatch.setattr(embed, "get_provider", picky)
    head = commit_state(str(repo))[0]
    report = index.index_tree(store, read_tree(spark, str(repo)), ["skipped.txt"], config, head)
    assert report["errors"] == 1
    kept = {r.file: r.symbol for r in store.chunks().collect()}
    assert kept["pkg/other.py"] == "Walker" and kept["pkg/store.py"] == "load_all"
    vectors, errors = embed._by_group(["a", "REFUSED", "b"], ["x", "y", "x"], config, picky(config))
    assert [v is None for v in vectors] == [False, True, False] and errors == [None, "refused", None]
    changes = spark.createDataFrame([(0, "M", "pkg/other.py", None)], "ord int, status string, path string, new_path string")
    before = store.version()
    with pytest.raises(embed.EmbeddingError, match="pkg/other.py: refused"):
        index.reindex(store, changes, lambda paths: read_files(paths, str(repo)), [], config, None, None)
    assert store.version() == before


def test_results_without_an_id(spark):
    rows = [("7", "a", 1, 2, None, "x"), (None, "a", 1, 2, None, "x"), ("", "a", 1, 2, None, "x"), (None, "a", 1, 3, None, "x"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "chunk_id string, file string, start_line int, end_line int, symbol string, text string")
    keys = [r[0] for r in df.select(result_key(*(F.col(c) for c in df.columns))).collect()]
    assert keys[0] == "7" and keys[1] == keys[2] and len(set(keys)) == 4 and all(keys)


def test_gone_files_leave_the_index(spark, repo):
    settings = load_settings(repo)
    cli.run_index(spark, settings)
    os.remove(repo / "pkg/other.py")
    assert cli.run_index(spark, settings)["stale"] == 1
    store = SnapshotStore(spark, str(settings.index_path))
    assert "pkg/other.py" not in {r.file for r in store.indexed_files().collect()}
    assert store.version() == 2 and (settings.index_path / "v=00000001").exists()


def test_another_model_embeds_again(spark, repo):
    settings = load_settings(repo)
    cli.run_index(spark, settings)
    other = settings.__class__(**{**settings.__dict__, "embedding": EmbeddingConfig(dim=16, model="other")})
    report = cli.run_index(spark, other)
    assert report["to_index"] == 4
    assert {len(r.vector) for r in SnapshotStore(spark, str(settings.index_path)).chunks().collect()} == {16}


def test_missing_index_and_bad_pointer(spark, repo):
    settings = load_settings(repo)
    with pytest.raises(ValueError, match="no index"):
        cli.run_ask(spark, settings, "x")
    cli.run_index(spark, settings)
    (settings.index_path / "CURRENT").write_text("zero")
    with pytest.raises(ValueError, match="damaged"):
        SnapshotStore(spark, str(settings.index_path)).chunks()


def test_mixed_dimensions_are_refused(spark, repo):
    settings = load_settings(repo)
    cli.run_index(spark, settings)
    store = SnapshotStore(spark, str(settings.index_path))
    with pytest.raises(ValueError, match="dimension mismatch"):
        store.commit(store.chunks(), store.file_hashes(), store.meta() | {"dim": 5})
    assert store.version() == 1


def test_command_line(repo, capsys):
    assert cli.main(["ask", "x", "--repo", str(repo / "none")]) == 2
    assert "no such directory" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.build_parser().parse_args(["ask", "x", "--top-k", "0"])


def test_global_rank(spark):
    df = spark.range(1000).selectExpr("id", "pmod(hash(id), 50) as k")
    got = [(r.k, r.id, r.place) for r in global_rank(df, [F.col("k"), F.col("id")], "place").orderBy("place").collect()]
    assert [g[:2] for g in got] == sorted(g[:2] for g in got) and [g[2] for g in got] == list(range(1, 1001))
