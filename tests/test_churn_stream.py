"""Churn that is carried on against churn counted anew."""

import random

import pytest
from pyspark.sql import functions as F

from codestrata import schema
from codestrata.operators.commits import churn_hotspots, commit_files, file_churn
from codestrata.streaming import churn as S

FILES = [f"f{i}.ts" for i in range(40)]


def pages(seed, n):
    """Pages of commits, out of order, of which some hold commits of earlier pages again."""
    r = random.Random(seed)
    out = []
    for p in range(n):
        page = []
        for i in range(12):
            ts = 1_700_000_000 + r.randint(-10**7, 10**7)
            changes = [(f, r.randint(0, 9), r.randint(0, 9)) for f in r.sample(FILES, r.randint(0, 5))]
            page.append((r.choice("xyz"), f"{p}-{i}", ts, "s", changes, 0))
        page += r.sample(out[-1], 4) if out else [(None, "h", 1, "s", [("a", 1, 1)], 2), ("x", None, 1, "s", [("a", 1, 1)], 2), ("x", "e", 1, "s", None, 0), ("x", "n", 1, "s", [(None, 1, 1)], 2)]
        out.append(page)
    return out


def counted(spark, rows):
    seen = {(c[0], c[1]): c for c in rows if c[0] and c[1]}
    return file_churn(commit_files(spark.createDataFrame(list(seen.values()), schema.COMMITS)).where("path is not null"))


def tops(churn):
    return sorted((r["repo_id"], by, r["rank"], r["file"], r["modifications"], r["linesChanged"]) for by in S.TOPS.values() for r in churn_hotspots(churn, by).collect())


def rows(d):
    return sorted(map(tuple, d.collect()))


def test_like_counted_anew(spark, tmp_path):
    data, path, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    every = []
    for page in pages(7, 3):
        spark.createDataFrame(page, schema.COMMITS).coalesce(1).write.mode("append").parquet(data)
        every += page
        stream = spark.readStream.schema(schema.COMMITS).parquet(data)
        q = S.follow_churn(stream, path, state, availableNow=True)  # each time a query that goes on from the state before
        assert q.awaitTermination(120) and q.exception() is None
        want, tables = counted(spark, every), S.ChurnTables(spark, path)
        assert rows(tables.sums.read().select("repo_id", "file", "modifications", "linesChanged")) == rows(want)
        assert rows(S.top_rows(tables.tops.read())) == tops(want)
    assert rows(tables.of_repository("y")) == rows(want.where("repo_id = 'y'"))
    tables.compact()
    assert rows(S.top_rows(tables.tops.read())) == tops(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_batch_again_changes_nothing(spark, tmp_path, seed):
    """Sums of ever more commits, each batch taken twice; the first ten never look at files that a batch leaves alone."""
    tables, every = S.ChurnTables(spark, str(tmp_path)), []
    for page in pages(seed, 3):
        every += page
        touched = {(c[0], f[0]) for c in page for f in c[4] or [] if c[0] and f[0]}
        keys = spark.createDataFrame(sorted(touched), "repo_id string, file string")
        now = counted(spark, every).join(keys, ["repo_id", "file"], "left_semi")
        tables.take(now)
        tables.take(now)
        assert rows(S.top_rows(tables.tops.read())) == tops(counted(spark, every))
    tables.take(now.limit(0))
    assert rows(S.top_rows(tables.tops.read())) == tops(counted(spark, every))


def test_nothing_came(spark, tmp_path):
    tables = S.ChurnTables(spark, str(tmp_path))
    tables.take(spark.createDataFrame([], "repo_id string, file string, modifications long, linesChanged long"))
    assert tables.tops.read().count() == 0 and tables.of_repository("x").count() == 0
    assert S.top_rows(tables.tops.read()).select(F.max("rank")).first()[0] is None
