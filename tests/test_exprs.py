import pytest
from pyspark.sql import functions as F

from codestrata.functions import exprs as X


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def values(spark, rows, kind, c):
    return [r["v"] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}").select("i", c.alias("v")).orderBy("i").collect()]


def test_rounding_is_half_up_on_the_binary_product(spark):
    assert values(spark, [1.005, 2.5, -2.5, 1.25, 0.0], "double", X.round_js("x", 2)) == [1.0, 2.5, -2.5, 1.25, 0.0]
    assert values(spark, [2.5, -2.5, 3.4], "double", X.round_js("x")) == [3.0, -2.0, 3.0]
    assert value(spark, X.pct1(F.lit(1), F.lit(3))) == 33.3 and value(spark, X.pct1(F.lit(1), F.lit(0))) == 0.0


@pytest.mark.parametrize(("rows", "want"), [([], 0), ([42], 42), ([1, 2, 3, 4, 5], 3), ([1, 2, 3, 4], 2.5), ([10, 20], 15)])
def test_median(spark, rows, want):
    assert spark.createDataFrame([(r,) for r in rows], "x int").agg(X.median0("x").alias("m")).first()["m"] == want


@pytest.mark.parametrize(("rows", "want"), [([5, 10, 15, 20, 25], (15, 20, 25)), ([1, 2, 3, 4, 5], (3, 4, 5)), ([1, 2, 3, 4], (3, 4, 4)), ([], (0, 0, 0))])
def test_floor_percentiles(spark, rows, want):
    d = spark.createDataFrame([(0, r) for r in rows], "k int, x int")
    assert tuple(d.agg(*[X.pctl_floor("x", p) for p in (0.5, 0.75, 0.9)]).first()) == want
    from codestrata.operators.distributions import floor_percentiles

    got = floor_percentiles(d, ("k",), {"x": "x"}).collect()
    assert [tuple(r)[1:] for r in got] == ([want] if rows else [])


def test_count_lines(spark):
    texts = ["", "hello", "hello\n", "line1\nline2", "line1\nline2\n", "a\nb\nc", "a\r\nb\r\n", None]
    assert values(spark, texts, "string", X.count_lines("x")) == [0, 1, 1, 2, 2, 3, 2, 0]


def test_lengths_and_numbers(spark):
    assert values(spark, ["a😀", "", "é"], "string", X.utf16_length("x")) == [3, 0, 1]
    assert values(spark, ["12abc", "-", "", None, " 7", "-3"], "string", X.leading_int("x")) == [12, 0, 0, 0, 7, -3]


def test_paths(spark):
    paths = ["a.ts", "a.tsx", "src/a.test.ts", "b.spec.tsx", "dist/a.ts", "x/node_modules/y/a.ts", "src/build.ts", "a.js", "test.ts"]
    assert values(spark, paths, "string", X.is_source_file("x")) == [True, True, True, True, False, False, True, False, True]
    assert values(spark, paths, "string", X.is_test_file("x"))[:4] == [False, False, True, True]


def test_refactor_words(spark):
    assert values(spark, ["refactor: x", "Cleanup", "refactored", "no", None, "fix rename bug"], "string", X.is_refactor_subject("x")) == [True, True, False, False, False, True]


def test_repo_urls(spark):
    urls = ["https://github.com/o/r", "https://github.com/o/r/", "https://github.com/o/r.git", " https://github.com/my-org/my_repo.js ", "http://github.com/o/r", "https://gitlab.com/o/r", "https://github.com/o", "nonsense", "", None]
    got = values(spark, urls, "string", X.parse_repo_url("x"))
    assert [(g["owner"], g["repo"]) if g else None for g in got] == [("o", "r"), ("o", "r"), ("o", "r"), ("my-org", "my_repo.js"), None, None, None, None, None, None]
    assert values(spark, ["o/r", "https://a", "github.com/o/r"], "string", X.normalise_repo_url("x")) == ["https://github.com/o/r", "https://a", "https://github.com/o/r"]
    assert values(spark, ["o/r", "www.github.com/o/r", "", "x y"], "string", X.is_valid_repo_input("x")) == [True, True, False, False]
    assert values(spark, ["HTTPS://GitHub.com/x", "o/r"], "string", X.looks_like_repo_url("x")) == [True, False]


def test_presentation(spark):
    assert values(spark, [3.0, 2.345, None], "double", X.display_number("x")) == ["3", "2.35", None]
    assert value(spark, X.result_id(F.lit("o"), F.lit("r"), F.lit("0123456789abcdef"))) == "o-r-0123456789ab"
    assert len(value(spark, X.result_id(F.lit("o"), F.lit("r"), F.lit("")))) == 16
    assert value(spark, X.short_commit(F.lit("0123456789"))) == "0123456"
    assert value(spark, X.export_name(F.lit("a/b"), F.lit("0123456789"), F.lit("2024-01-02 03:04:05").cast("timestamp"))) == "a_b_0123456_2024-01-02T03-04-05"
    assert value(spark, X.badges(F.lit(10), F.lit(49))) == ["High"]
    assert value(spark, X.repo_label(F.lit("git"), F.lit("u"), F.lit("p"))) == "u"
    assert X.is_git_unavailable("x", "ENOENT") and X.is_git_unavailable("spawn git ENOENT") and not X.is_git_unavailable("denied")
