"""Clones against a version that compares the tokens themselves, and what moves."""

import random
from collections import Counter

import numpy as np
import pytest

from codestrata.operators import duplication as D


def brute(files, size, lines):
    """Windows as tuples of token texts: repository -> (lines covered, different starts)."""
    windows = {}
    for i, (repo, _, content) in enumerate(files):
        tokens, line = [], 0
        for m in D._LEXEME.finditer(content):
            start, line = line, line + m[0].count("\n")
            if m[1] is not None:
                tokens.append((m[0], start, line))
        windows[i] = [(tuple(t[0] for t in tokens[k : k + size]), tokens[k][1], tokens[k + size - 1][2]) for k in range(len(tokens) - size + 1)]
    out = {}
    for repo in {f[0] for f in files}:
        mine = [i for i, f in enumerate(files) if f[0] == repo]
        times = Counter(w for i in mine for w, _, _ in windows[i])
        covered, starts = 0, set()
        for i in mine:
            seen, k = set(), 0
            while k < len(windows[i]):
                stop = k
                while stop < len(windows[i]) and times[windows[i][stop][0]] > 1:
                    stop += 1
                if stop > k:
                    a, b = windows[i][k][1], windows[i][stop - 1][2]
                    if b - a + 1 >= lines:
                        seen |= set(range(a, b + 1))
                        starts.add(windows[i][k][0])
                k = stop + 1
            covered += len(seen)
        out[repo] = (covered, len(starts))
    return out


def corpus(seed):
    r = random.Random(seed)
    pieces = ["\n".join(" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5))) for _ in range(12)) for _ in range(6)]
    files = []
    for i in range(40):
        own = "\n".join(" ".join(r.choice("pqrstuvw") + str(r.randint(0, 9)) for _ in range(4)) for _ in range(r.randint(0, 12)))
        files.append((r.choice(["x", "y", None]), f"f{i % 30}.ts", "\n".join([own, r.choice(pieces), r.choice(["", "/* a\nb */", "'q r'", "x x x x x x x x x x x x x x x x x x x x x x x x"]), r.choice(pieces[:3])])))
    return [*files, ("x", "empty.ts", ""), ("x", "e2.ts", "// only\n"), ("z", "one.ts", "a b c"), ("w", "long.ts", "a b\n" * 400)]


@pytest.mark.parametrize("seed,size,lines", [(1, 12, 3), (2, 20, 5), (3, 5, 2)])
def test_like_tokens_compared(spark, seed, size, lines):
    files = corpus(seed)
    d = D.duplication(spark.createDataFrame([*files, ("z", "none.ts", None)], "repo_id string, file string, content string"), size, lines)
    got = {r["repo_id"]: (r["duplication"]["duplicateLines"], r["duplication"]["cloneClusters"]) for r in d.collect()}
    assert got == brute(files, size, lines)
    assert sum(n for n, _ in got.values()) > 0


def test_no_files(spark):
    assert D.duplication(spark.createDataFrame([], "repo_id string, file string, content string")).count() == 0


def test_content_is_cut_once(spark, monkeypatch):
    """A file's content goes into one step of the plan; what comes after reads the tokens that were kept."""
    calls = spark.sparkContext.accumulator(0)
    whole = D._lex

    def counted(repo, content, total):
        calls.add(1)
        return whole(repo, content, total)

    monkeypatch.setattr(D, "_lex", counted)
    files = corpus(4)
    d = D.duplication(spark.createDataFrame(files, "repo_id string, file string, content string"), 12, 3)
    d.collect()
    d.collect()
    assert calls.value == len(files)


def test_few_hashes_move():
    """Of random tokens about two in ``size - GRAM + 2`` windows choose a new minimiser; equal windows choose at equal offsets."""
    tokens = np.random.default_rng(5).integers(0, 2**63, (20_000, 2)).astype(np.uint64)
    tokens[10_000:10_100] = tokens[500:600]
    _, least = D.minimisers(tokens, 50)
    assert len(np.unique(least)) < len(tokens) * 2.5 / (50 - D.GRAM + 2)
    same = D.identities(tokens, 50)
    assert (same[500:551] == same[10_000:10_051]).all() and len(np.unique(same)) == len(same) - 51
    assert (least[500:551] - 500 == least[10_000:10_051] - 10_000).all()


def test_files_are_looked_at_once_and_copies_not_at_all(spark, monkeypatch):
    """Windows of a file are counted by one pass that is not made again for the join; files with equal tokens on equal lines share it."""
    calls = spark.sparkContext.accumulator(0)
    whole = D._counted

    def counted(size):
        rows = whole(size)

        def run(*row):
            calls.add(1)
            return rows(*row)

        return run

    monkeypatch.setattr(D, "_counted", counted)
    files = corpus(6)
    copies = [*files, *[(repo, f"copy{i}-{name}", content + "// end\n" * (i % 2)) for i in range(3) for repo, name, content in files[:20]]]
    d = D.duplication(spark.createDataFrame(copies, "repo_id string, file string, content string"), 12, 3)
    got = {r["repo_id"]: (r["duplication"]["duplicateLines"], r["duplication"]["cloneClusters"]) for r in d.collect()}
    assert got == brute(copies, 12, 3)
    assert 0 < calls.value <= len(files)


def test_one_partition_is_dealt_to_all_cores(spark):
    """A table of one split is cut and parsed by more than one task."""
    from codestrata.queries import dealt

    files = spark.createDataFrame(corpus(7), "repo_id string, file string, content string").coalesce(1)
    used = {r[0] for r in dealt(spark, files).selectExpr("spark_partition_id()").distinct().collect()}
    assert len(used) >= spark.sparkContext.defaultParallelism


def test_few_compressed_bytes_are_dealt_to_many_tasks(spark, monkeypatch, tmp_path):
    """Spark merges partitions of few bytes; tokens are few bytes and much work."""
    from pyspark import TaskContext

    def marked(name):
        whole, folder = getattr(D, name), tmp_path / name
        folder.mkdir()

        def of(*sizes):
            rows = whole(*sizes)

            def run(*row):
                (folder / str(TaskContext.get().partitionId())).touch()
                return rows(*row)

            return run

        monkeypatch.setattr(D, name, of)
        return folder

    folders = [marked("_counted"), marked("_stretches")]
    files = corpus(6)
    d = D.duplication(spark.createDataFrame(files, "repo_id string, file string, content string"), 12, 3)
    got = {r["repo_id"]: (r["duplication"]["duplicateLines"], r["duplication"]["cloneClusters"]) for r in d.collect()}
    assert got == brute(files, 12, 3)
    assert all(len(list(f.iterdir())) > 1 for f in folders)
