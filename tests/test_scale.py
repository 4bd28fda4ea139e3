"""What keeps groups, pages and histories from ending in one task."""

import math
import os
import random
import statistics
import time
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from codestrata import schema
from codestrata.operators import commits, distributions, duplication, ranges, views
from codestrata.plans.report import Inputs, build_reports
from codestrata.sources import scratch


def concentration(rows, share=0.1):
    """(weight, high, tie) rows."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2], -(r[1] or 0)))
    top = order[: max(1, math.ceil(len(rows) * share))]
    part, whole = sum(h or 0 for _, h, _ in top), sum(h or 0 for _, h, _ in rows)
    return math.floor(part / whole * 1000 + 0.5) / 10 if whole else 0.0


@pytest.mark.parametrize("tied_rows", [1_000_000, 0])
def test_top_share_against_sorting(spark, tied_rows):
    dice = random.Random(4)
    groups = {
        "ties": [(dice.choice((0, 0, 0, 1, 7)), dice.randrange(3), f"f{i}") for i in range(400)],
        "few": [(5, 1, "a")], "zero": [(0, 0, f"f{i}") for i in range(50)], "one": [(3, 1, f"f{i:03}") for i in range(95)],
        "wide": [(dice.randrange(-10, 10**dice.randrange(1, 12)), dice.randrange(5), f"f{i}") for i in range(900)],
        "null": [(None, 2, f"n{i}") for i in range(30)] + [(1, None, "x"), (2, 1, "y")], None: [(9, None, "a"), (9, 4, "b"), (9, 1, "c")] + [(1, 1, f"d{i}") for i in range(9)],
    }
    d = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "g string, w long, h long, t string")
    got = {r["g"]: r["concentration"] for r in distributions.top_share_concentration(d, ("g",), "w", "h", "t", tied_rows=tied_rows).collect()}
    assert got == {g: concentration(rows) for g, rows in groups.items()}
    every = distributions.top_share_concentration(d.withColumn("t", F.concat_ws("/", "t", "g")), (), "w", "h", "t", tied_rows=tied_rows).collect()
    assert [r["concentration"] for r in every] == [concentration([(w, h, "/".join(x for x in (t, g) if x)) for g, rows in groups.items() for w, h, t in rows])]
    assert distributions.top_share_concentration(d.limit(0), ("g",), "w", "h", "t").count() == 0


def test_top_share_of_fractions(spark):
    dice = random.Random(6)
    rows = [(dice.choice((dice.random(), 0.5, -dice.random(), 1e-9, 1e300)), dice.randrange(3), i) for i in range(500)]
    d = spark.createDataFrame([("g", *r) for r in rows], "g string, w double, h long, t long")
    assert distributions.top_share_concentration(d, ("g",), "w", "h", "t").first()["concentration"] == concentration(rows)


def test_top_share_of_one_group_of_millions(spark):
    """No plan orders the group: what windows see are counts."""
    n = 3_000_000
    d = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") % 1000).alias("w"), (F.col("id") % 7).alias("h"), F.col("id").alias("t"))
    got = distributions.top_share_concentration(d, ("g",), "w", "h", "t").first()["concentration"]
    top = sum(i % 7 for i in range(n) if i % 1000 >= 900)
    assert got == math.floor(top / sum(i % 7 for i in range(n)) * 1000 + 0.5) / 10


def test_pages_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SHALLOW", 100)
    d = spark.range(20_000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), (F.col("id") % 50).alias("v"))
    rows = sorted((i % 50, f"f{i}") for i in range(20_000))
    held = ranges.in_ranges(d, [F.asc("v"), F.asc("file")], 16)
    assert sum(n for _, n in held.sizes) == 20_000 and len(held.sizes) > 8
    for page in (0, 1, 7, 199, 399, 400, 1000):
        want = [f for _, f in rows[page * 50 : page * 50 + 50]]
        for got in (views.file_table(d, by="v", page=page), held.page(page * 50, 50)):
            assert [r["file"] for r in got.collect()] == want
    deep = held.page(10_000, 50)
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and ranges.RANGE in plan.split("PartitionFilters: [")[1].split("]")[0]
    down = [r["file"] for r in views.file_table(d, by="v", descending=True, page=300).collect()]
    assert down == [f for _, f in sorted(((-v, f) for v, f in rows))[15_000:15_050]]
    assert [r["file"] for r in views.file_table(d, search="F1999", by="v", page=0).collect()] == [f for _, f in rows if "f1999" in f]


def test_ranks_over_ranges(spark):
    dice = random.Random(2)
    rows = [(dice.choice(("a", "a", "a", None)), i, dice.randrange(100)) for i in range(3000)]
    d = spark.createDataFrame(rows, "g string, i int, x int")
    got = {r["i"]: r["rank"] for r in ranges.ranked(d, ("g",), [F.desc("x"), F.asc("i")], parts=7).collect()}
    for g in ("a", None):
        order = sorted((-x, i) for h, i, x in rows if h == g)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))


def test_dispersion_of_gaps(spark):
    dice = random.Random(9)
    groups = {"a": [0], "b": [5, 5, 5], None: [dice.randrange(10**13) for _ in range(300)], "steady": [k * 86_400_000 for k in range(400)], "near": [10**12 + k * 60_000 + (k % 7 == 0) for k in range(500)], "none": [None], "some": [None, 1000, 4000], "far": [-(10**15), 0, 10**15, 10**15 + 1]}
    d = spark.createDataFrame([(g, t) for g, ts in groups.items() for t in ts], "g string, ms long").repartition(3)
    got = {r["g"]: r["stdDevTimeBetweenCommits"] for r in commits.gap_dispersion(d, ("g",), "ms").collect()}
    for g, ts in groups.items():
        ts = sorted(t for t in ts if t is not None)
        gaps = [b - a for a, b in zip(ts, ts[1:], strict=False)]
        assert got[g] == pytest.approx(math.floor(statistics.pstdev(gaps) * 10 + 0.5) / 10 if gaps else 0.0, rel=1e-12, abs=0.051)
    plan = commits.gap_dispersion(d, ("g",), "ms")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3


@pytest.mark.parametrize("keys", [("k",), ()])
def test_percentiles_over_ranges(spark, keys):
    """Values that hardly repeat, in one large group, small ones and one without a key: the same with and without ranges, and by sorting."""
    from codestrata.operators.distributions import floor_percentiles

    k = F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 7 == 0, (F.col("id") % 4).cast("string")).otherwise(F.lit("hot"))
    d = spark.range(0, 20_000, 1, 4).select(k.alias("k"), F.when(F.col("id") % 90 != 0, F.pmod(F.xxhash64("id"), F.lit(15_000)) / 7.0).alias("x"), (F.col("id") % 3 + 1).alias("w"))
    for weight in (None, "w"):
        ask = lambda wide: {tuple(r)[: len(keys)]: tuple(r) for r in floor_percentiles(d, keys, {"x": "x"}, median=True, weight=weight, wide=wide).collect()}  # noqa: B023, E731
        got = ask(True)
        assert got == ask(False)
        values = {}
        for r in d.where("x is not null").collect():
            values.setdefault((r["k"],) if keys else (), []).extend([r["x"]] * (r["w"] if weight else 1))
        for key, xs in values.items():
            xs.sort()
            n = len(xs)
            want = (*[xs[min(int(p * n), n - 1)] for p in (0.5, 0.75, 0.9)], (xs[(n - 1) // 2] + xs[n // 2]) / 2)
            assert got[key][len(keys) :] == pytest.approx(want)
        assert len(got) == len(values)


def on_disk(spark):
    """Bytes of shuffle files, and of the shared folder."""
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda folder: [os.path.join(at, name) for at, _, names in os.walk(folder) for name in names]
    size = lambda paths: sum(os.path.getsize(p) for p in paths if os.path.exists(p))
    return size(p for folder in local for p in files(folder) if os.path.basename(p).startswith("shuffle_")), size(files(urlparse(scratch.shared_folder(spark)).path))


def left(spark, before, most):
    """What is on disk beyond ``before``; shuffle files are deleted a little later."""
    for _ in range(50):
        more = [now - b for now, b in zip(on_disk(spark), before, strict=True)]
        if max(more) < most:
            break
        time.sleep(0.2)
    return more


def test_cut_lineage_leaves_no_shuffle_files(spark):
    d = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    setting = spark.conf.get(scratch._SWEEP, None)
    before = on_disk(spark)
    got = scratch.cut_lineage(d)
    assert left(spark, (before[0], on_disk(spark)[1]), 10_000)[0] < 10_000 and spark.conf.get(scratch._SWEEP, None) == setting
    assert got.agg(F.sum("n")).first()[0] == 40_000 and len(d.collect()) == len(d.collect()) == 40_000  # both can be run again


def test_passing_rows_are_deleted(spark):
    before = on_disk(spark)[1]
    d = spark.createDataFrame([("a", None, [1, 2]), (None, "x", None)], "k string, v string, n array<int>")
    with pytest.raises(ZeroDivisionError), scratch.passing(spark) as keep:
        rows = keep(d)
        assert rows.schema == d.schema and sorted(rows.collect(), key=str) == sorted(d.collect(), key=str) and on_disk(spark)[1] > before
        raise ZeroDivisionError
    assert on_disk(spark)[1] == before


def test_sections_leave_no_rows_behind(spark):
    dice = random.Random(9)
    text = ["\n".join(" ".join(f"w{dice.randrange(50_000)}" for _ in range(8)) for _ in range(100)) for _ in range(200)]
    files = spark.createDataFrame([(f"r{i % 3}", f"f{i}.ts", text[i % 150 if i % 2 else i], None) for i in range(200)], "repo_id string, file string, content string, error string")
    repos = files.select("repo_id", F.col("repo_id").alias("repo_path"), F.lit(None).cast("struct<type: string, url: string, commit: string, branch: string>").alias("source")).distinct()
    n = F.col("id")
    path = F.concat(F.lit("src/"), F.md5(n.cast("string")), F.lit(".ts"))
    history = spark.range(20_000).select(F.concat(F.lit("r"), n % 3).alias("repo_id"), F.md5(n.cast("string")).alias("hash"), n.alias("ts"), F.lit("fix").alias("subject"), F.array(F.struct(path.alias("path"), n.alias("add"), n.alias("del"))).alias("files"), (2 * n).alias("total_lines"))
    f = lambda x: F.struct(x.alias("visit_ord"), F.lit("f").alias("name"), F.lit("arrow_function").alias("type"), x.alias("startLine"), x.alias("lines"), x.alias("maxNestingDepth"), x.alias("parameterCount"), x.alias("complexity"))
    numbers = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda x: F.pmod(F.hash(n, x), F.lit(1000)))
    measures = spark.range(5000).select(F.concat(F.lit("r"), n % 3).alias("repo_id"), F.concat(F.lit("m"), n).alias("file"), F.lit(None).cast("string").alias("error"), F.lit(20).cast("long").alias("total"), F.lit(None).cast("map<string, long>").alias("by_type"), F.transform(numbers, f).cast(schema.FUNCTIONS).alias("functions"), n.alias("empty_catches"), n.alias("console_logs"))
    before = on_disk(spark)
    reports = build_reports(Inputs(repos, files, history, measures=measures, dealt=files.repartition(4, "file")), 0, per_file=False)
    assert max(left(spark, before, 100_000)) < 100_000  # 1.2 MB of texts, 20,000 commits and 100,000 functions
    got = {r["repo_id"]: r["report"] for r in reports.collect()}
    assert {k: v["totals"]["functions"] for k, v in got.items()} == {"r0": 33_340, "r1": 33_340, "r2": 33_320}
    assert {k: v["git"]["totalCommits"] for k, v in got.items()} == {"r0": 6667, "r1": 6667, "r2": 6666}
    assert {k: v["duplication"]["percentage"] for k, v in got.items()} == {r["repo_id"]: r["duplication"]["percentage"] for r in duplication.duplication(files).collect()}
