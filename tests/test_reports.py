import json
import os
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from codestrata import constants as C
from codestrata import schema
from codestrata.operators import distributions, duplication, features, functions, profile, store, views
from codestrata.plans import analyze, export
from codestrata.plans.report import Inputs, build_reports, report_json
from codestrata.sources.api import api_metadata, cached_checkout, git_clone, read_commit_pages, unpack_archive
from codestrata.sources.files import files_from_table, list_repos, read_source_trees
from codestrata.sources.manifests import parse_manifests
from codestrata.syntax.nodes import analysed, parse_files

INDEX = "/**\n * Greets\n */\n\nexport function greet(name: string): string {\n  return `hi ${name}`;\n}\n\nexport function add(a: number, b: number): number {\n  return a + b;\n}\n"
UTILS = "/**\n * Text\n */\n\nexport function capitalize(s: string): string {\n  if (!s) return s;\n  return s[0];\n}\n\nexport function isEven(n: number): boolean {\n  return n % 2 === 0;\n}\n"


def tree(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


@pytest.fixture
def golden(tmp_path):
    return tree(tmp_path / "golden", {"index.ts": INDEX, "utils.ts": UTILS})


def test_golden_report(spark, golden):
    r = analyze.analyze_repo(spark, golden, {"type": "local", "url": "", "commit": "c", "branch": "b"}, as_of=1_700_000_000)
    assert r["filesAnalyzed"] == 2 and "filesSkipped" not in r and r["totals"] == {"functions": 4}
    assert r["profile"] == {"totalFiles": 2, "tsFiles": 2, "tsxFiles": 0, "testFiles": 0, "totalLOC": 23, "sourceLOC": 23, "testLOC": 0}
    assert r["functionMetricsSummary"] == {"totalFunctions": 4, "averageLength": 3.3, "medianLength": 3, "maxNestingDepth": 1, "longFunctionPercentage": 0}
    assert r["complexity"] == {"average": 1.3, "max": 2, "highComplexityFunctions": 0}
    assert r["distributions"] == {"p50_function_length": 3, "p75_function_length": 4, "p90_function_length": 4, "p50_complexity": 1, "p75_complexity": 2, "p90_complexity": 2, "percent_high_complexity_in_top_10_percent_files": 0}
    assert r["maintainability"] == {"score": 87.5, "classification": "high"} and r["testCoverageProxy"] == {"ratio": 0, "classification": "low"}
    assert r["duplication"] == {"percentage": 0, "duplicateLines": 0, "cloneClusters": 0} and set(r["smells"].values()) == {0}
    assert all(r[k] is None for k in ("framework", "git", "gitMetricsV2")) and r["analysis_timestamp"] == "2023-11-14T22:13:20.000Z"
    index, utils = r["perFile"]
    assert [(f["name"], f["startLine"], f["lines"], f["parameterCount"]) for f in index["functionMetrics"]] == [("add", 9, 3, 2), ("greet", 5, 3, 1)]
    assert [(f["name"], f["complexity"]) for f in utils["complexity"]] == [("isEven", 1), ("capitalize", 2)]
    assert index["functionsByType"] == {t: 2 * (t == "function_declaration") for t in C.FUNCTION_TYPES}


def test_loc_fixture_and_discovery(spark, tmp_path):
    root = tree(tmp_path, {"crlf.ts": "const a = 1;\r\nconst b = 2;\r\n", "trailing-newline.ts": "const a = 1;\nconst b = 2;\n", "one-line.ts": "const a = 1;\n", "foo.test.ts": "a();\nb();\n", "empty.ts": "",
                           "build/ignored.ts": "x", "a/node_modules/b.ts": "x", ".hid/x.ts": "x", "README.md": "x"})
    p = profile.loc_profile(read_source_trees(spark, [("r", root)])).first().asDict()
    assert p == {"repo_id": "r", "totalFiles": 5, "tsFiles": 5, "tsxFiles": 0, "testFiles": 1, "totalLOC": 7, "sourceLOC": 5, "testLOC": 2}
    tree(tmp_path, {"_app.tsx": "x", "src/__tests__/q.ts": b"\xff\xfe"})
    got = {r["file"]: r["content"] for r in read_source_trees(spark, [("r", root)], 64).collect()}
    assert set(got) == {"crlf.ts", "trailing-newline.ts", "one-line.ts", "foo.test.ts", "empty.ts", "_app.tsx", "src/__tests__/q.ts"} and got["src/__tests__/q.ts"] == "��" and got["empty.ts"] == ""
    assert read_source_trees(spark, []).count() == 0
    table = spark.createDataFrame([("r", "dist/a.ts", "x"), ("r", "a.ts", "y")], "repo_id string, file string, content string")
    assert [r["file"] for r in files_from_table(table).collect()] == ["a.ts"]


def git(path, *args):
    env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "GIT_AUTHOR_DATE": "1700000000 +0000", "GIT_COMMITTER_DATE": "1700000000 +0000"}
    subprocess.run(["git", "-C", path, *args], check=True, capture_output=True, env=env)


def test_batch_with_history(spark, tmp_path, capsys):
    one = tree(tmp_path / "one", {"package.json": '{"dependencies": {"react": "1"}, "devDependencies": {"next": "2"}}', "a.ts": INDEX})
    tree(tmp_path / "two", {"package.json": "{bad", "b.tsx": "const x = () => <a/>;"})
    tree(tmp_path / "not", {"c.ts": "x"})
    git(one, "init", "-q")
    git(one, "add", ".")
    git(one, "commit", "-qm", "refactor: all")
    assert [n for n, _ in list_repos(str(tmp_path))] == ["one", "two"]
    reports = analyze.analyze_batch(spark, list_repos(str(tmp_path)), as_of=1_700_000_100).cache()
    by = {r["repo_id"]: json.loads(r["j"]) for r in reports.select("repo_id", report_json().alias("j")).collect()}
    assert by["one"]["framework"] == {"type": "Next", "hasReact": True, "hasBackend": True} and by["two"]["framework"] is None
    assert by["one"]["git"] == {"totalCommits": 1, "medianCommitSize": 12, "avgLinesPerCommit": 12, "largeCommitRatio": 0, "commitsPerWeek": 0.1} and by["two"]["git"] is None
    assert by["one"]["gitMetricsV2"]["refactorBehavior"] == {"refactorCommitRatio": 100} and len(by["one"]["source"]["commit"]) == 40
    out = str(tmp_path / "out")
    assert export.write_report_files(reports, out) == 2 and json.load(open(f"{out}/one.json"))["totals"]["functions"] == 2
    export.write_summary_csv(reports, f"{out}/csv")
    lines = [x for f in sorted(os.listdir(f"{out}/csv")) if f.endswith(".csv") for x in open(f"{out}/csv/{f}").read().splitlines()]
    assert lines[0].startswith("repo,files,totalLOC") and lines[0].count(",") == 17
    export.write_reports(reports, f"{out}/json")
    assert sorted(x for x in os.listdir(f"{out}/json") if x.startswith("repo_id")) == ["repo_id=one", "repo_id=two"]
    export.write_feature_csv(reports, f"{out}/features")
    s = {r["repo_id"]: json.loads(r["json"]) for r in export.structured(reports).collect()}["one"]
    assert s["schema_version"] == 1 and s["features_by_category"] == {"Behavioral": 12, "Distribution": 7, "Structural": 16, "Verification": 7} and s["per_file_summaries"] == [{"file": "a.ts", "functions": 2, "totalComplexity": 2}]
    analyses = reports.select(F.concat("repo_id", F.lit("-x")).alias("result_id"), F.lit("u").alias("repo_url"), F.lit("c").alias("commit_sha"), F.lit("2024-01-01").cast("timestamp").alias("analyzed_at"), report_json().alias("report_json"))
    for _ in range(2):
        analyze.store_reports(spark, analyses, str(tmp_path / "store"))
    assert store.Store(spark, str(tmp_path / "store")).table.read().count() == 2
    assert analyze.get_report(spark, str(tmp_path / "store"), " one")["totals"]["functions"] == 2 and analyze.get_report(spark, str(tmp_path / "store"), "%") is None


def test_archives_and_saved_pages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("o-r-1/a.ts", INDEX)
    pages = tmp_path / "pages" / "o-r"
    pages.mkdir(parents=True)
    commit = lambda k: {"sha": str(k), "commit": {"message": "m", "author": {"date": f"2024-01-01T00:{k % 60:02d}:00Z"}, "committer": None}}
    (pages / "1.json").write_text(json.dumps([commit(k) for k in range(150)]))
    (pages / "2.json").write_text(json.dumps([commit(k) for k in range(150)]))
    assert read_commit_pages(spark, str(pages)).count() == 200

    def no_git(url, folder):
        raise FileNotFoundError("spawn git ENOENT")

    r = analyze.analyze_url(spark, "o/r", str(tmp_path / "cache"), no_git, str(tmp_path / "r.zip"), '{"default_branch": "dev"}', '{"sha": "abc"}', str(pages))
    assert r["git"]["mode"] == "api" and r["git"]["totalCommits"] == 200 and r["source"] == {"type": "git", "url": "https://github.com/o/r", "commit": "abc", "branch": "dev"} and r["totals"]["functions"] == 2
    r = analyze.analyze_url(spark, "o/r", str(tmp_path / "cache"), no_git, str(tmp_path / "r.zip"))
    assert r["git"]["mode"] == "none" and r["git"]["unavailable"] is True and r["git"]["totalCommits"] == 0
    with pytest.raises(ValueError):
        analyze.analyze_url(spark, "https://gitlab.com/o/r", str(tmp_path), no_git)
    assert api_metadata("u", "{}", None)["branch"] == "main"
    made = []
    for _ in range(2):
        cached_checkout("a", "b", str(tmp_path / "c"), lambda f: (made.append(f), os.makedirs(f)))
    assert len(made) == 1
    cached_checkout("a", "b", str(tmp_path / "c"), lambda f: (made.append(f), os.makedirs(f)), use_cache=False)
    assert len(made) == 2 and os.listdir(tmp_path / "c") == ["a-b"]
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("x/a.ts", "")
        z.writestr("y/a.ts", "")
    with pytest.raises(ValueError):
        unpack_archive(str(tmp_path / "two.zip"), str(tmp_path / "two"))


def test_requests(spark, tmp_path, capsys):
    origin = tree(tmp_path / "origin", {"a.ts": INDEX})
    git(origin, "init", "-q")
    git(origin, "add", ".")
    git(origin, "commit", "-qm", "all")
    cache, path = str(tmp_path / "cache"), str(tmp_path / "store")
    options = {"base": cache, "clone": lambda url, folder: git_clone(origin, folder)}
    assert [analyze.post_analysis(spark, b, path, **options)[0] for b in ({}, {"url": "  "}, {"url": "https://example.org/x"})] == [400] * 3
    assert analyze.get_result(spark, "o-r", path)[0] == 404
    status, answer = analyze.post_analysis(spark, {"url": "o/r"}, path, **options)
    assert status == 200 and answer["status"] == "done" and answer["resultId"].startswith("o-r-") and len(answer["resultId"]) == 16
    assert answer["report"]["git"]["totalCommits"] == 1 and answer["report"]["source"]["url"] == "https://github.com/o/r"
    assert analyze.get_result(spark, answer["resultId"], path) == (200, answer["report"]) == analyze.get_result(spark, " o-r", path)
    status, missing = analyze.get_result(spark, "zzz ", path)
    assert status == 404 and missing["debug"] == {"searched": "zzz", "available": [answer["resultId"]]}
    other = {"base": cache, "clone": lambda url, folder: (_ for _ in ()).throw(RuntimeError("no way"))}
    assert analyze.post_analysis(spark, {"url": "o/r"}, path, **other)[0] == 200  # from the cache
    assert analyze.post_analysis(spark, {"url": "o/r"}, path, use_cache=False, **other) == (500, {"error": "no way", "status": "failed"})
    assert os.listdir(cache) == ["o-r"] and store.Store(spark, path).table.read().count() == 1


def test_command_line_takes_addresses(spark, tmp_path, monkeypatch, capsys):
    asked = []
    monkeypatch.setattr(analyze, "analyze_url", lambda spark, url, **k: asked.append((url, k["use_cache"])) or {"ok": 1})
    monkeypatch.setattr(analyze.SparkSession, "builder", type("B", (), {"appName": lambda s, n: s, "config": lambda s, *a: s, "getOrCreate": lambda s: spark})())
    assert analyze.main(["analyze", "https://github.com/o/r", "--no-cache"]) == 0 and analyze.main(["analyze", "http://github.com/o/r"]) == 0
    assert asked == [("https://github.com/o/r", False), ("http://github.com/o/r", True)] and json.loads(capsys.readouterr().out.split("}")[0] + "}") == {"ok": 1}


def test_commit_metrics_of_the_first_question(spark):
    row = lambda git, v2: (git and json.dumps(git), v2 and json.dumps(v2))
    v1, v2 = {"totalCommits": 9, "medianCommitSize": 3.0, "largeCommitRatio": 4.0, "commitsPerWeek": 1.5}, {"commitStats": {"medianCommitSize": 7.0, "pctOver500Loc": 2.0}, "burstStats": {"burstRatio": 60.0}}
    d = spark.createDataFrame([(i, *row(*x)) for i, x in enumerate([(v1, v2), (v1, None), (None, None)])], "i int, g string, v string")
    report = F.struct(F.from_json("g", schema.GIT).alias("git"), F.from_json("v", schema.GIT_V2).alias("gitMetricsV2"), F.lit(None).cast("struct<percentage: double>").alias("duplication"))
    got = [r["m"].asDict() for r in d.select("i", report.alias("report")).orderBy("i").select(views.commit_metrics().alias("m")).collect()]
    assert [(x["totalCommits"], x["medianCommitSize"], x["largeCommitRatio"], x["burstRatio"], x["duplication"]) for x in got] == [(9, 7, 2, 6000, 0), (9, 3, 4, 0, 0), (0, 0, 0, 0, 0)]


def test_frameworks(spark):
    rows = [("a", '{"dependencies": {"express": "1", "react": "1"}}'), ("b", '{"devDependencies": {"fastify": "1", "express": "1"}}'), ("c", '{"dependencies": {"@nestjs/core": "1", "fastify": "1"}}'), ("d", "{}"), ("e", "[1]"), ("f", "nope"), ("g", None), ("h", '{"dependencies": {"react": "1"}}')]
    got = {r["repo_id"]: tuple(r["framework"]) for r in profile.framework(parse_manifests(spark.createDataFrame(rows, "repo_id string, content string"))).collect()}
    assert got == {"a": ("Express", True, True), "b": ("Fastify", False, True), "c": ("NestJS", False, True), "d": ("Node", False, False), "h": ("React", True, False)}


def test_scores(spark):
    rows = [(2.0, 500, 10.0), (30.0, 500_000, 200.0), (6.0, 5000, 25.0), (1.0, 0, 5.0)]
    got = [tuple(r["m"]) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c double, n long, l double").orderBy("i").select(profile.maintainability("c", "n", "l").alias("m")).collect()]
    assert got == [(75.2, "high"), (37.7, "low"), (62.9, "moderate"), (84.8, "high")]
    rows = [(10, 0), (5, 100), (50, 200), (100, 100), (3, 10)]
    got = [tuple(r["m"]) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t long, s long").orderBy("i").select(profile.coverage_proxy("t", "s").alias("m")).collect()]
    assert got == [(0.0, "low"), (0.05, "low"), (0.25, "moderate"), (1.0, "high"), (0.3, "moderate")]


def test_concentration(spark):
    rows = [("r", f"f{i}", 12 if i == 0 else 1) for i in range(10)] + [("r", "f0", 15)] + [("r", f"f{i}", 1) for i in range(1, 10)]
    fns = spark.createDataFrame([(*r, r[2], 1) for r in rows], "repo_id string, file string, complexity int, lines int, x int")
    files = fns.select("repo_id", "file").distinct()
    assert distributions.distributions(fns, files).first()["percent_high_complexity_in_top_10_percent_files"] == 100.0
    none = distributions.distributions(fns.limit(0), files).first()
    assert [none[c] for c in none.asDict() if c != "repo_id"] == [0.0] * 7


def test_smells_and_skipped_files(spark):
    long = "function f() {\n" + "  a();\n" * 51 + "}\n"
    deep = lambda n: "function g() { " + "if (a) { " * n + "}" * n + " }"
    code = {"a.ts": long, "b.ts": deep(5), "c.ts": deep(3), "d.ts": "function p(a, b, c, d, e) {}\ntry { x(); } catch (e) {}\nconsole.log(1);"}
    files = spark.createDataFrame([("r", f, c, None) for f, c in code.items()] + [("r", "bad.ts", None, "OSError")], schema.FILES)
    repos = spark.createDataFrame([("r", "/r", ("local", "", "", "")), ("empty", "/e", ("local", "", "", ""))], schema.REPOS)
    got = {r["repo_id"]: json.loads(r["j"]) for r in build_reports(Inputs(repos, files), 0).select("repo_id", report_json().alias("j")).collect()}
    assert got["r"]["smells"] == {"longFunctions": 1, "deepNesting": 1, "longParameterLists": 1, "emptyCatchBlocks": 1, "consoleLogs": 1}
    assert got["r"]["filesAnalyzed"] == 4 and got["r"]["filesSkipped"] == 1 and got["empty"]["filesAnalyzed"] == 0 and got["empty"]["perFile"] == []
    fns = functions.functions_of(analysed(parse_files(files.where("content is not null"))))
    assert {r["name"]: (r["lines"], r["max_nesting"]) for r in fns.where("file in ('a.ts', 'b.ts')").collect()} == {"f": (53, 0), "g": (1, 5)}


def test_duplication(spark):
    body = "\n".join(f"  const v{i} = call{i}(a{i}, b{i});" for i in range(12))
    rows = [("r", "a.ts", f"function a() {{\n{body}\n}}\n"), ("r", "b.ts", f"// another\nfunction bb() {{\n{body}\n  return 1;\n}}\n"), ("r", "c.ts", "const q = 1;\n"), ("s", "a.ts", f"function a() {{\n{body}\n}}\n")]
    got = {r["repo_id"]: tuple(r["duplication"]) for r in duplication.duplication(spark.createDataFrame(rows, "repo_id string, file string, content string")).collect()}
    assert got["s"] == (0.0, 0, 0) and got["r"][1] in (24, 25, 26, 27, 28) and got["r"][2] >= 1 and got["r"][0] == int(got["r"][1] / 31 * 1000 + 0.5) / 10


def test_store_and_views(spark):
    at = lambda d: f"2024-01-{d:02d}"
    rows = lambda xs: spark.createDataFrame(xs, "result_id string, d string, report_json string").select("result_id", F.lit("u").alias("repo_url"), F.lit("c").alias("commit_sha"), F.col("d").cast("timestamp").alias("analyzed_at"), "report_json")
    old, new = rows([("a-1", at(9), "old"), ("a-2", at(2), "x"), ("a%", at(1), "pct")]), rows([("a-1", at(3), "new"), ("a-1", at(1), "newer?")])
    merged = store.upsert(old, new)
    assert {r["result_id"]: r["report_json"] for r in merged.collect()} == {"a-1": "new", "a-2": "x", "a%": "pct"}
    assert store.lookup(merged, " a-2 ").first()["report_json"] == "x" and store.lookup(merged, "a-").first()["result_id"] == "a-1" and store.lookup(merged, "a%").first()["report_json"] == "pct"
    assert store.lookup(merged, "").count() == 0 and store.some_ids(merged).count() == 3
    spec = features.specification(spark)
    assert spec.count() == 42 and {r["category"]: r["n"] for r in spec.groupBy("category").agg(F.count("*").alias("n")).collect()} == {"Structural": 16, "Behavioral": 12, "Verification": 7, "Distribution": 7}
    d = spark.createDataFrame([("x", 12, 50, "F.ts"), ("y", 3, 80, "g.ts")], "name string, complexity int, lines int, file string").withColumn("repo_id", F.lit("r")).withColumn("start_line", F.lit(1))
    assert [r["badges"] for r in views.hotspots(d, "complexity").orderBy("rank").collect()] == [["High", "Long"], ["Long"]]
    assert [r["file"] for r in views.file_table(d, "F.", "lines", True).collect()] == ["F.ts"]
    one = spark.range(1)
    assert tuple(one.select(views.risk_profile(F.lit(8), F.lit(4), F.lit(1), F.lit(20)).alias("r")).first()["r"]) == (0.6, 0.25, "High", "Low", "High risk / Low verification")
    assert len(one.select(views.insight_rules(F.lit(10), F.lit(0.05), F.lit(10), F.lit(5), F.lit(39.9)).alias("r")).first()["r"]) == 4
    assert one.select(views.page_count(F.lit(101)).alias("n")).first()["n"] == 3


def test_download(tmp_path):
    path = export.write_download('{"a": "é"}', "o-r-1", "0123456789", str(tmp_path / "d"))
    assert os.path.basename(path) == "codestrata-o-r-1-0123456.json" and open(path, encoding="utf-8").read() == '{\n  "a": "é"\n}'
    assert os.path.basename(export.write_download("{}", "x", None, str(tmp_path))) == "codestrata-x-—.json"
