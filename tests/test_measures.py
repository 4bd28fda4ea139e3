"""Measures kept by content, sections on demand, saved pages."""

import json

import pytest
from pyspark.sql import functions as F

from codestrata import schema
from codestrata.plans import export
from codestrata.plans.measures import cached_measures, file_entries, function_rows, measure_files
from codestrata.plans.report import Inputs, build_reports, report_json
from codestrata.sources.api import parse_commit_pages

CODE = {
    "a.ts": "function f(a, b) { if (a) { return b; } }\nconsole.log(f);\n", "b.tsx": "const v = () => <b/>;\ntry { v(); } catch (e) {}\n", "c.ts": "", "copy.ts": "function f(a, b) { if (a) { return b; } }\nconsole.log(f);\n",
    "same.tsx": "function f(a, b) { if (a) { return b; } }\nconsole.log(f);\n",
}


def files_of(spark, code, repo="r"):
    return spark.createDataFrame([(repo, f, c, None) for f, c in code.items()] + [(repo, "gone.ts", None, "OSError")], schema.FILES)


def plain(measures):
    return {(r["repo_id"], r["file"]): r.asDict(recursive=True) for r in measures.collect()}


def test_only_new_contents_are_measured(spark, tmp_path):
    path, code = str(tmp_path / "measures"), dict(CODE)
    want = plain(measure_files(files_of(spark, code)))
    assert want["r", "a.ts"]["console_logs"] == 1 and want["r", "b.tsx"]["empty_catches"] == 1 and want["r", "c.ts"]["functions"] == []
    got, n = cached_measures(spark, files_of(spark, code), path)
    assert n == 4 and plain(got) == want  # a copy is the same content; the same text in the other dialect is not
    got, n = cached_measures(spark, files_of(spark, code), path)
    assert n == 0 and plain(got) == want
    code["a.ts"] += "// more\nfunction g() {}\n"
    code["moved.ts"] = code.pop("c.ts")
    got, n = cached_measures(spark, files_of(spark, code), path)
    assert n == 1 and plain(got) == plain(measure_files(files_of(spark, code)))
    other, n = cached_measures(spark, files_of(spark, CODE, "other"), path)
    assert n == 0 and set(plain(other)) == {("other", f) for f in CODE}
    assert cached_measures(spark, files_of(spark, code), path, function_expressions=True)[1] == 5
    assert sorted((r["file"], r["name"], r["complexity"]) for r in function_rows(got).where("file in ('a.ts', 'b.tsx')").collect()) == [("a.ts", "f", 2), ("a.ts", "g", 1), ("b.tsx", "v", 1)]
    assert [r["entry"]["functionsByType"]["function_declaration"] for r in file_entries(got).where("file = 'a.ts'").collect()] == [2]


@pytest.mark.parametrize("sections", [("code", "duplication"), ("duplication",), ()])
def test_sections_on_demand(spark, sections):
    files, repos = files_of(spark, CODE), spark.createDataFrame([("r", "/r", None)], schema.REPOS)
    reports = build_reports(Inputs(repos, files), 0, sections=sections)
    r = json.loads(reports.select(report_json()).first()[0])
    assert r["profile"]["totalFiles"] == r["filesAnalyzed"] == 5 and r["filesSkipped"] == 1
    assert r["totals"]["functions"] == (4 if "code" in sections else 0) and r["smells"]["consoleLogs"] == (3 if "code" in sections else 0) and len(r["perFile"]) == (5 if "code" in sections else 0)
    plan = reports.select(export.structured_json().alias("s"), report_json().alias("j"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") < 40


def test_saved_pages(spark):
    commit = lambda k, day=1: {"sha": str(k), "commit": {"message": "m", "author": {"date": "2024-03-01T00:00:00Z"}, "committer": {"date": f"2024-01-{day:02d}T00:00:00Z"} if day else None}}
    pages = lambda *sizes: [json.dumps([commit(f"{p}-{k}", k % 28 + 1) for k in range(n)]) for p, n in enumerate(sizes)]
    rows = [("order", f"page-{n}.json", x) for n, x in zip((9, 10, 11), pages(100, 100, 100), strict=True)] + [("short", f"{n}", x) for n, x in enumerate(pages(100, 30, 100))] + [("empty", f"{n}", x) for n, x in enumerate(pages(100, 0, 100))]
    rows += [("few", "1", pages(7)[0]), ("no", "1", "[]"), ("bad", "1", "{nope"), ("none", "1", None)]
    d = spark.createDataFrame(rows, "repo_id string, page string, value string")
    got = {}
    for r in parse_commit_pages(d).collect():
        got.setdefault(r["repo_id"], []).append(r["sha"])
    assert {k: len(v) for k, v in got.items()} == {"order": 200, "short": 130, "empty": 100, "few": 7}
    assert {s.split("-")[0] for s in got["order"]} == {"0", "1"} and {s.split("-")[0] for s in got["short"]} == {"0", "1"}
    since = int(spark.range(1).select(F.unix_seconds(F.lit("2024-01-20 00:00:00").cast("timestamp"))).first()[0])
    late = parse_commit_pages(d, since=since).where("repo_id = 'few' or repo_id = 'short'").groupBy("repo_id").count().collect()
    assert {r["repo_id"]: r["count"] for r in late} == {"short": sum(k % 28 + 1 >= 20 for k in range(100)) + sum(k % 28 + 1 >= 20 for k in range(30))}
