"""Trees and histories as executors read them."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from codestrata.plans import analyze
from codestrata.sources import files, git_log, manifests


def walked(root):
    """The discovery rules again, by a plain walk."""
    ignored = {"node_modules", "dist", "build", ".next", "out", "coverage", ".git"}
    for here, folders, names in os.walk(root):
        folders[:] = [f for f in folders if f not in ignored and not f.startswith(".")]
        yield from (os.path.relpath(os.path.join(here, n), root) for n in names if n.endswith((".ts", ".tsx")) and not n.startswith("."))


def tree(root, n=120):
    for k in range(n):
        folder = root.joinpath(*(["src", "lib", "node_modules", "deep", ".hid", "__tests__"][(k // 7**i) % 6] for i in range(1 + k % 5)))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{'_' * (k % 3)}f{k}.{('ts', 'tsx', 'js', 'd.ts')[k % 4]}").write_text("x" * k)
    os.symlink(root / "src", root / "linked")
    return str(root)


@pytest.mark.parametrize("listed", [1, 7, files.LISTED])
def test_discovery_in_rounds(spark, tmp_path, listed):
    roots = [("a", tree(tmp_path / "a")), ("b", tree(tmp_path / "b", 9)), ("none", str(tmp_path / "none"))]
    os.mkdir(roots[2][1])
    got = sorted((r["repo_id"], r["path"], r["bytes"]) for r in files.source_paths(spark, roots, listed).collect())
    assert got == sorted((n, p, os.path.getsize(os.path.join(root, p))) for n, root in roots for p in walked(root)) and len(got) > 40


def test_contents_and_files_that_cannot_be_read(spark, tmp_path):
    root = tree(tmp_path / "a", 30)
    os.symlink(tmp_path / "gone.ts", tmp_path / "a" / "gone.ts")
    got = {r["file"]: r["content"] for r in files.read_source_trees(spark, [("a", root)], 64).collect()}
    assert got == {p: open(os.path.join(root, p)).read() for p in walked(root) if p != "gone.ts"}


def test_a_tree_that_is_not_seen_fails(spark, tmp_path):
    gone = [("a", str(tmp_path / "gone"))]
    for read in (files.read_source_trees, manifests.read_manifests, git_log.read_logs):
        with pytest.raises(Exception, match="not to be seen"):
            read(spark, gone).count()


def test_clusters_must_name_a_shared_cache(spark, monkeypatch, tmp_path):
    assert analyze.cache_folder(spark) == os.path.abspath(os.path.join(".cache", "repos"))
    monkeypatch.setattr(analyze, "is_local", lambda s: False)
    with pytest.raises(ValueError, match="share"):
        analyze.cache_folder(spark)
    spark.conf.set(analyze.CACHE_SETTING, str(tmp_path))
    try:
        assert analyze.cache_folder(spark) == str(tmp_path)
    finally:
        spark.conf.unset(analyze.CACHE_SETTING)


def history(root, commits, branches=()):
    """A repository with many commits, by one run of fast-import."""
    root.mkdir()
    lines = []
    for name, first, n in (("main", 0, commits), *branches):
        for k in range(first, first + n):
            text = f"line {k}\n" * (k % 4 + 1)
            lines.append(f"commit refs/heads/{name}\nmark :{k + 1}\ncommitter a <a@b> {1_600_000_000 + k * 60} +0000\ndata {len(f'fix: {k}')}\nfix: {k}\nM 100644 inline src/f{k % 9}.ts\ndata {len(text)}\n{text}")
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    if lines:
        subprocess.run(["git", "-C", str(root), "fast-import", "--quiet"], input="\n".join(lines) + "\n", text=True, check=True, capture_output=True)
    return str(root)


def commits_of(d):
    return sorted((r["repo_id"], r["hash"], r["ts"], r["subject"], r["total_lines"], [tuple(f) for f in r["files"]]) for r in d.collect())


def whole_log(spark, repo, path):
    log = subprocess.run(["git", "-C", path, "log", "--all", "--numstat", f"--format={git_log.FORMAT}"], capture_output=True, text=True, check=True).stdout
    return commits_of(git_log.parse_blocks(spark.createDataFrame([(repo, b) for b in log.split(git_log.SEPARATOR)], "repo_id string, value string")))


def test_a_history_in_ranges(spark, tmp_path):
    one, two = history(tmp_path / "one", 500, (("side", 1000, 60),)), history(tmp_path / "two", 3)
    (tmp_path / "plain").mkdir()
    history(tmp_path / "empty", 0)
    repos = [("one", one), ("two", two), ("plain", str(tmp_path / "plain")), ("empty", str(tmp_path / "empty"))]
    want = whole_log(spark, "one", one) + whole_log(spark, "two", two)
    assert len(want) == 563
    for most in (40, 5000):
        assert commits_of(git_log.read_logs(spark, repos, most)) == sorted(want)


def test_a_long_history_is_read_by_several_tasks(spark, tmp_path):
    path = history(tmp_path / "long", 100_000)
    rows = git_log.read_logs(spark, [("long", path)], 10_000)
    assert rows.count() == 100_000 and rows.select("hash").distinct().count() == 100_000
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_a_git_that_breaks_off(spark, tmp_path, caplog):
    """A history of which git gives only a part, since an object is missing, is no history; others stay."""
    one, two = history(tmp_path / "one", 50), history(tmp_path / "two", 50)
    pack = next((tmp_path / "one" / ".git" / "objects" / "pack").glob("*.pack"))
    aside = pack.rename(tmp_path / "aside.pack")
    for rest in pack.parent.iterdir():
        rest.unlink()
    with open(aside, "rb") as f:
        subprocess.run(["git", "-C", one, "unpack-objects", "-q"], stdin=f, check=True)
    assert len(commits_of(git_log.read_logs(spark, [("one", one)], 10))) == 50
    bad = subprocess.run(["git", "-C", one, "rev-parse", "main~20^{tree}"], capture_output=True, text=True, check=True).stdout.strip()
    (tmp_path / "one" / ".git" / "objects" / bad[:2] / bad[2:]).unlink()
    assert subprocess.run(git_log.log_command(one), input="main", text=True, capture_output=True).returncode != 0
    got = {r["repo_id"]: r["count"] for r in git_log.read_logs(spark, [("one", one), ("two", two)], 10).groupBy("repo_id").count().collect()}
    assert got == {"two": 50} and "one" in caplog.text and bad in caplog.text
