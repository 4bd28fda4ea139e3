import random

import pytest
from pyspark.sql import functions as F

from codestrata import schema
from codestrata.operators import commits as M
from codestrata.sources.git_log import parse_blocks, read_git_log

T0 = 1_700_000_000
LOG = f"""COMMIT_END
abc1
{T0}
feat: add foo

10\t5\tsrc/foo.ts
20\t0\tsrc/bar.test.ts

COMMIT_END
abc2
{T0 + 300}
fix: bar

5\t2\tsrc/foo.ts

COMMIT_END
abc3
{T0 + 600}
refactor: extract helper

100\t50\tsrc/baz.ts
0\t0\tsrc/foo.test.ts

COMMIT_END
abc4
{T0 + 7200}
feat: big change

600\t200\tsrc/foo.ts

COMMIT_END
abc5
{T0 + 7500}
chore: cleanup

2\t1\tsrc/foo.ts
"""


@pytest.fixture
def log(spark, tmp_path):
    (tmp_path / "demo.log").write_text(LOG)
    return read_git_log(spark, str(tmp_path)).cache()


def test_vector(log):
    assert log.where("repo_id = 'demo'").count() == 5
    v = M.history_v2(log).first()["gitMetricsV2"].asDict(recursive=True)
    assert v["commitStats"] == {"medianCommitSize": 35.0, "p90CommitSize": 800.0, "pctOver500Loc": 20.0, "pctOver1000Loc": 0.0}
    assert v["burstStats"] == {"burstCount": 1, "burstRatio": 60.0}
    assert v["entropy"] == {"stdDevTimeBetweenCommits": 2727980.0}
    assert v["testCoupling"] == {"pctCommitsTouchingTests": 40.0, "testToFeatureCommitRatio": 0.67}
    assert v["refactorBehavior"] == {"refactorCommitRatio": 40.0}
    top = v["churn"]["topByModifications"]
    assert top[0] == {"file": "src/foo.ts", "modifications": 4, "linesChanged": 825} and [x["file"] for x in top[1:]] == ["src/bar.test.ts", "src/baz.ts", "src/foo.test.ts"]
    assert [x["linesChanged"] for x in v["churn"]["topByLinesChanged"]] == [825, 150, 20, 0]


def test_odd_blocks(spark):
    blocks = ["h1\n5\nbinary\n\n-\t-\ta.png\n3\t4\tb\tc.ts\n1\t1\t-\n1\t1\t \nnonsense\n", "h2\n6\nno files\n", "h3\n7\n\n\n", "h4\nnever\nsubject", "", "h5\n-5\nold\n"]
    got = {r["hash"]: r for r in parse_blocks(spark.createDataFrame([("r", b) for b in blocks], "repo_id string, value string")).collect()}
    assert set(got) == {"h1", "h2", "h5"}
    assert [(f["path"], f["add"], f["del"]) for f in got["h1"]["files"]] == [("a.png", 0, 0), ("b\tc.ts", 3, 4)] and got["h1"]["total_lines"] == 7
    assert got["h2"]["files"] == [] and got["h2"]["total_lines"] == 0


def test_first_history(spark, log):
    extra = spark.createDataFrame([("demo", "x", T0, "empty", [], 0)], schema.COMMITS)
    g = M.history_v1(log.unionByName(extra), T0 + 8000).first()["git"]
    assert (g["totalCommits"], g["medianCommitSize"], g["avgLinesPerCommit"], g["largeCommitRatio"], g["commitsPerWeek"], g["mode"]) == (6, 35.0, 199.0, 20.0, 0.5, None)
    only = M.history_v1(extra, T0).first()["git"]
    assert (only["totalCommits"], only["medianCommitSize"], only["commitsPerWeek"]) == (1, 0.0, 0.0)


def test_api_history(spark):
    rows = [("r", "1", "a😀", "2024-01-01T00:00:00Z", None), ("r", "2", None, None, "2024-01-01T00:30:00Z"), ("r", "3", "four", "", None), ("r", "4", "xx", "2024-01-02T00:30:00Z", "2020-01-01T00:00:00Z"), ("e", "5", "m", None, None)]
    got = {r["repo_id"]: r["git"] for r in M.history_api(spark.createDataFrame(rows, schema.API_COMMITS)).collect()}
    g = got["r"]
    assert (g["mode"], g["totalCommits"], g["commitsPerWeek"], g["activeDaysLast90Days"]) == ("api", 4, 0.3, 2)
    assert (g["medianInterCommitHours"], g["burstRatio"], g["medianCommitMessageLength"], g["medianCommitSize"]) == (12.3, 50.0, 2.5, 0.0)
    assert got["e"]["medianInterCommitHours"] == 0.0 and got["e"]["activeDaysLast90Days"] == 0


def test_bursts_and_gaps_like_a_loop(spark):
    dice = random.Random(3)
    rows = [(f"r{r}", T0 + dice.randrange(40_000)) for r in range(6) for _ in range(dice.randrange(1, 40))] + [("edge", T0), ("edge", T0 + 1800), ("edge", T0 + 3600), ("edge", T0 + 5401)]
    d = spark.createDataFrame(rows, "repo_id string, ts long")
    bursts = {r["repo_id"]: (r["burstCount"], r["burstRatio"]) for r in M.burst_stats(d, time=F.timestamp_seconds("ts")).collect()}
    spread = {r["repo_id"]: r["stdDevTimeBetweenCommits"] for r in M.gap_dispersion(d).collect()}
    for repo in bursts:
        times = sorted(t for r, t in rows if r == repo)
        sessions = [[times[0]]]
        for t in times[1:]:
            sessions.append([t]) if t - sessions[-1][-1] > 1800 else sessions[-1].append(t)
        inside = sum(len(s) for s in sessions if len(s) >= 3)
        assert bursts[repo] == (sum(len(s) >= 3 for s in sessions), int(inside / len(times) * 1000 + 0.5) / 10)
        gaps = [(b - a) * 1000 for a, b in zip(times, times[1:], strict=False)]
        want = (sum((g - sum(gaps) / len(gaps)) ** 2 for g in gaps) / len(gaps)) ** 0.5 if gaps else 0
        assert spread[repo] == pytest.approx(want, abs=0.06)


def test_streaming_bursts(spark, tmp_path):
    from codestrata.streaming.bursts import streaming_bursts

    rows = [("r", T0 + s) for s in (0, 600, 1200, 90_000, 180_000)]
    spark.createDataFrame(rows, "repo_id string, s long").select("repo_id", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("repo_id string, ts timestamp").parquet(str(tmp_path / "in"))
    q = streaming_bursts(stream).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["repo_id"], r["n"]) for r in spark.table("bursts").collect()] == [("r", 3)]
