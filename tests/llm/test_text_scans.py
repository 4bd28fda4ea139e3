import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from helpers import docs, rows, same_rows

from codestrata.llm import decontaminate, license_scan, quality_rules


def edit_distance_inside(passage, text):
    """Fewest edits to turn the passage into a substring of the text (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def spoil(dice, text, edits):
    t = list(text)
    for _ in range(edits):
        i = dice.randrange(len(t))
        kind = dice.randrange(3)
        t[i : i + (kind != 0)] = [dice.choice("abcdefgh")] if kind < 2 else []
    return "".join(t)


def cases():
    dice = random.Random(11)
    noise = lambda n: "".join(dice.choice("abcdefgh ") for _ in range(n))
    items = [(k, noise(n)) for k, n in enumerate((60, 40, 45, 120, 5, 39))] + [(6, ""), (7, None), (8, "x"), (None, noise(50)), (9, "Abcdefgh  ABCDEFGH\nabcdefgh abcdefgh abcdefgh")]
    texts = [noise(200), "", None, "abcdefgh abcdefgh\tabcdefgh abcdefgh ABCDEFGH", "x"]
    for k in (0, 1, 2, 3, 5):
        for edits in (0, 1, 2, 3, 4, 5, 8):
            part = items[k][1] if edits % 2 else items[k][1][: 45 if k == 3 else None]
            texts.append(noise(dice.randrange(60)) + spoil(dice, part, edits) + noise(dice.randrange(60)))
    texts.append(noise(500) + items[4][1] + items[0][1][10:])
    return items, [(i if i else None, t, "en", "s", 0) for i, t in enumerate(texts)]


def test_leaks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_BLOCKS", 2)  # so that blocks of 100 characters take several passes
    items, data = cases()
    settings = dict(q=4, passage=40, edit_rate=0.1)
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, start int")
    for chars in (8 << 20, 100):
        got = decontaminate.find_leaks(docs(spark, data), bench, item_chars=chars, **settings).collect()
        want = []
        for d, t, *_ in data:
            text = decontaminate.normalised(t)
            for k, item in items:
                item = decontaminate.normalised(item)
                if k is None or not item:
                    continue
                n = min(len(item), 40)
                e = int(0.1 * n) if len(item) >= 4 else 0
                if any(edit_distance_inside(item[s : s + n], text) <= e for s in range(len(item) - n + 1)):
                    want.append((d, k))
        same_rows([(r["doc_id"], r["item_id"]) for r in got], want)
        assert all(0 <= r["start"] <= r["stop"] for r in got) and len(want) > 15
        clean = decontaminate.without_leaks(docs(spark, data), bench, item_chars=chars, **settings)
        assert clean.columns == docs(spark, data).columns
        same_rows([r["doc_id"] for r in clean.collect()], [d for d, t, *_ in data if not any((d, k) in want for k, _ in items)])
    assert decontaminate.find_leaks(docs(spark, []), bench).count() == 0 and decontaminate.find_leaks(docs(spark, data), bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs(spark, data), bench.limit(0)).count() == len(data)


@pytest.mark.parametrize("settings", [{}, {"edit_rate": 0.3}, {"q": 12, "edit_rate": 0.15}])
def test_short_items_get_the_edits_of_their_rate(spark, settings):
    dice = random.Random(17)
    noise = lambda n: "".join(dice.choice("abcdefghijklmnop") for _ in range(n))
    items = [(n, noise(n)) for n in range(2, 31)]
    data = []
    for n, item in items:
        for edits in range(4):
            data.append((len(data), noise(20) + spoil(dice, item, edits) + noise(20), "en", "s", 0))
    got = decontaminate.find_leaks(docs(spark, data), spark.createDataFrame(items, "item_id long, text string"), **settings).collect()
    rate = settings.get("edit_rate", decontaminate.EDIT_RATE)
    want = [(d, n) for d, t, *_ in data for n, item in items if edit_distance_inside(item, t) <= int(rate * n)]
    same_rows([(r["doc_id"], r["item_id"]) for r in got], want)
    texts = {d: t for d, t, *_ in data}
    for r in got:
        assert edit_distance_inside(dict(items)[r["item_id"]], texts[r["doc_id"]][r["start"] : r["stop"]]) <= r["edits"] <= int(rate * r["item_id"])
    assert any(r["edits"] and r["item_id"] < 16 for r in got)


def test_blank_items_stay_behind(spark):
    bench = spark.createDataFrame([(1, ""), (2, " \n"), (3, None), (4, "\u00a0"), (5, "an item to be found")], "item_id long, text string")
    assert [[i for i, t in b if t] for b in decontaminate.item_blocks(bench, "item_id", "text", 100)] == [[5]]
    got = decontaminate.find_leaks(docs(spark, [(1, "here is an item to be found", "", "", 0), (2, "", "", "", 0)]), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 5)]


def test_items_without_an_id_leak_too(spark):
    items, data = cases()
    bench = spark.createDataFrame([(None, items[0][1])], "item_id long, text string")
    held = [r[0] for r in data if items[0][1] in (r[1] or "")]
    clean = {r["doc_id"] for r in decontaminate.without_leaks(docs(spark, data), bench, q=4, passage=40, edit_rate=0.1).collect()}
    assert held and clean and not clean & set(held)


def test_whole_long_texts_are_searched(spark):
    dice = random.Random(1)
    item = "".join(dice.choice("abcdefghijklmnop ") for _ in range(150))
    long = "lorem ipsum dolor " * 20_000 + item[20:140] + " tail"
    got = decontaminate.find_leaks(docs(spark, [(1, long, "", "", 0), (2, "lorem " * 100, "", "", 0)]), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in got] == [(1, 5, 0)]


def test_gram_hashes_tell_grams_apart():
    codes = np.random.default_rng(0).integers(97, 101, 500).astype(np.uint32)
    for q in (1, 2, 3, 5, 8, 13):
        g = decontaminate._grams(codes, q)
        assert len(g) == 501 - q and len(set(g.tolist())) == len({tuple(codes[i : i + q].tolist()) for i in range(501 - q)})


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_each_template_is_found_in_a_text(name):
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    words = license_scan.TEMPLATES[name].split()
    wrapped = "\n".join("# " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    for body in (license_scan.TEMPLATES[name], wrapped):
        text = f"Some words before it.\n{body}\nand more after."
        found = scanner.scan(text)
        assert [(f[0], f[5]) for f in found] == [(name, True)], (name, found)
        assert license_scan._words(text[found[0][1] : found[0][2]])[-1] == license_scan._words(body)[-1]


def test_license_wording(spark):
    near = license_scan.TEMPLATES["MIT"].replace("free of charge", "without any fee").replace("Software", "Library")
    data = [(1, "Released under the MIT License.", "", "", 0), (2, "x\nReleased under the MIT License.\ny\nLicensed under CC BY-NC 4.0.", "", "", 0), (3, near, "", "", 0), (4, "a license to kill is no permission", "", "", 0), (5, None, "", "", 0), (6, "", "", "", 0), (None, "Released under the MIT License.", "", "", 0)]
    data += [(7, "word " * 30_000 + "\nThis work is licensed under the GNU General Public License, version 3.", "", "", 0), (8, "This work is licensed under the GNU General Public License, version 2.", "", "", 0)]
    got = license_scan.find_licenses(docs(spark, data)).collect()
    same_rows([(r["doc_id"], r["license"], r["exact"]) for r in got], [(1, "MIT-line", True), (2, "MIT-line", True), (2, "CC-BY-NC-4.0-line", True), (3, "MIT", False), (None, "MIT-line", True), (7, "GPL-3.0-line", True), (8, "GPL-2.0-line", True)])
    assert all(r["saved"] >= license_scan.LEAST_SAVED for r in got) and [r["different_words"] for r in got if r["doc_id"] == 3][0] > 0
    assert license_scan.find_licenses(docs(spark, [])).count() == 0
    lines = license_scan.find_licenses(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    exact = {license_scan.TEMPLATES[n] for n in ("MIT-line", "CC-BY-NC-4.0-line", "GPL-3.0-line", "Apache-2.0-line", "All-rights-reserved-line")}
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    assert lines.where("exact").count() == sum(line in exact for r in texts for line in r["text"].split("\n"))


@pytest.mark.parametrize("before", ["Copyright (c) 2024 Acme. ", "The poet had a license and no warranty of it, " + "so to say " * 40, "Permission was given. Copyright remains. "])
def test_every_cue_of_a_line_is_tried(before):
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name in ("Apache-2.0-line", "MIT-line", "GPL-3.0-line", "MPL-2.0"):
        text = before + license_scan.TEMPLATES[name]
        assert [(f[0], f[1], f[2], f[5]) for f in scanner.scan(text)] == [(name, len(before), len(text), True)]


@pytest.mark.parametrize("behind", [" international documentation contributors", " https://example.org/projects/documentation/licensing/index.html?version=2", " src/main/resources/META-INF/services/org.example.Provider", " ok", "\n" + "Überwachungsmaßnahmen " * 30])
def test_words_behind_a_notice_do_not_hide_it(behind):
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name, body in license_scan.TEMPLATES.items():
        found = scanner.scan("Written in earlier centuries.\n" + body + behind)
        assert [(f[0], f[5]) for f in found] == [(name, True)] and found[0][3] >= license_scan.LEAST_SAVED, (name, found)


def exact_notices(text):
    """Every word start against every template; of notices that overlap the longer one, then the first."""
    words = [(w, a, b) for a, b in ((m.start(), m.end()) for m in re.finditer(r"\S+", text)) if (w := text[a:b].lower().strip("*#/;,.:\"'()[]<>-!"))]
    found = []
    for name, body in license_scan.TEMPLATES.items():
        body = [w for w in (x.lower().strip("*#/;,.:\"'()[]<>-!") for x in body.split()) if w]
        for i in range(len(words) - len(body) + 1):
            if [w for w, _, _ in words[i : i + len(body)]] == body:
                found.append((-len(body), words[i][1], words[i + len(body) - 1][2], name))
    out = []
    for n, a, b, name in sorted(found):
        if not any(a < d and c < b for c, d, _ in out):
            out.append((a, b, name))
    return sorted(out)


@pytest.mark.parametrize("seed", range(25))
def test_exact_notices_against_every_word_start(seed):
    dice = random.Random(seed)
    noise = ["the", "license", "of", "permission", "no", "warranty", "copyright", "poet", "https://example.org/" + "x" * 300, "public", "domain", "Überwachung", "redistribution", "rights", "reserved", "--", "v2"]
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    gap = dice.choice([" ", " ", "\n", "\t "])
    parts = []
    for _ in range(dice.randrange(1, 9)):
        parts += [dice.choice(noise) for _ in range(dice.randrange(1, 60))]
        name = dice.choice(list(license_scan.TEMPLATES))
        parts += license_scan.TEMPLATES[name].split()
    text = gap.join(parts)
    got = [(a, b, name) for name, a, b, _, _, exact in scanner.scan(text) if exact]
    assert got == exact_notices(text) and len(got) > 0


def test_words_before_a_cue_may_be_long():
    mine = {"x": "one two three four five six the license of this"}
    long = {"x": " ".join("w" * 200 + str(i) for i in range(12)) + " license here"}
    for templates in (mine, long):
        text = "Before. " + templates["x"] + " After."
        assert [(f[0], f[1], f[5]) for f in license_scan.Scanner(templates).scan(text)] == [("x", 8, True)]


def test_reserved_rights_of_a_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = license_scan.find_licenses(table).where("license = 'All-rights-reserved-line' and exact").count()
    assert got == sum(line == "All rights reserved." for r in table.select("text").collect() for line in r["text"].split("\n")) > 0
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for text in ("Copyright 2020 Acme, all rights reserved by law", "# all rights\n# reserved", "ALL RIGHTS RESERVED"):
        assert [(f[0], f[5]) for f in scanner.scan(text)] == [("All-rights-reserved-line", True)], text


def test_templates_of_the_caller_bring_their_cues(spark):
    mine = {"beer": "As long as you retain this notice you can do whatever you want with this stuff.", "cc0": license_scan.TEMPLATES["CC0-1.0-line"]}
    text = "Before. " + mine["beer"] + " Between, at length.\n" + mine["cc0"] + " After."
    got = license_scan.find_licenses(docs(spark, [(1, text, "", "", 0)]), templates=mine).collect()
    same_rows([(r["license"], r["exact"]) for r in got], [("beer", True), ("cc0", True)])
    assert [f[0] for f in license_scan.Scanner({"cc0": mine["cc0"]}).scan(text)] == ["cc0"] and license_scan.Scanner({}).scan(text) == []


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_rules.fit_quality(d, labels)
    assert model.terms and quality_rules.fit_quality(d, labels, fit_rows=300).terms
    scored = quality_rules.score_documents(d, model)
    got = scored.join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert len(good) > 300 and np.mean([r["predicted"] for r in good]) > 0.98 and np.mean([r["predicted"] for r in bad]) < 0.05
    some = scored.limit(50).collect()
    texts = {r["doc_id"]: r["text"] for r in d.where(d["doc_id"].isin([r["doc_id"] for r in some])).collect()}
    for r in some:
        want = model.scores(np.array([quality_rules.statistics(texts[r["doc_id"]])]))[0]
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == (want >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    kept = quality_rules.good_documents(d, model)
    assert kept.columns == d.columns and kept.count() == scored.where("predicted = 1").count()


def test_quality_of_odd_tables(spark):
    data = rows()
    labels = spark.createDataFrame([(r[0], 1, 0) for r in data] + [(3, None, 0), (None, 1, 0), (6, 0, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    for taught in (labels, labels.limit(0), labels.where("quality = 1")):
        got = quality_rules.score_documents(docs(spark), quality_rules.fit_quality(docs(spark), taught)).collect()
        assert len(got) == len(data) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == 1 for r in quality_rules.score_documents(docs(spark), quality_rules.fit_quality(docs(spark), labels.limit(0))).collect())
    assert quality_rules.score_documents(docs(spark, []), quality_rules.fit_quality(docs(spark, []), labels)).count() == 0
    assert quality_rules.good_documents(docs(spark), quality_rules.fit_quality(docs(spark), labels.limit(0))).columns == docs(spark).columns


def test_rules_are_paths_and_few():
    dice = np.random.default_rng(5)
    x = dice.random((2000, len(quality_rules.STATISTICS)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] <= 0.4)).astype(np.int64)
    model = quality_rules.fit_rules(x, y)
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.98 and len(model.terms) < 300 and all(1 <= len(r.conditions) <= quality_rules.DEPTH for r, _ in model.terms)


def test_notices_behind_any_white_space():
    """Each separator that str.isspace knows, with 500 words before, with several cues in a word, and after a notice."""
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    body = license_scan.TEMPLATES["MIT-line"]
    blanks = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    assert {"\r", "\f", "\x0b", "\x1c", "\x85", "\u00a0", "\u2028", "\u3000"} <= set(blanks)
    for blank in blanks:
        notice = blank.join(body.split())
        for before in (blank.join(["word"] * 500) + blank, "license" * 50 + "/license:", ""):
            text = before + (blank if before and not before[-1].isspace() else "") + notice
            start = len(text) - len(notice)
            assert [(f[0], f[1], f[5]) for f in scanner.scan(text)] == [("MIT-line", start, True)], (blank, before[:9])
            assert [f[1] for f in scanner.scan(text + blank + "x" + blank + notice)] == [start, len(text) + 3], (blank, before[:9])


def statistics_plain(text):
    """The statistics again, character by character and word by word."""
    b = (text or "").encode()
    words = [w for w in re.split(rb"[ \t\n\r\x0b\x0c]+", b) if w]
    if not words:
        return [0.0] * len(quality_rules.STATISTICS)
    kinds = {"upper": string.ascii_uppercase, "digit": string.digits, "stop": ".,", "mark": ";:'\"-()?", "symbol": "#$%&*@^_~<>/\\=+[]{}`", "bang": "!", "pipe": "|", "newline": "\n"}
    out = {"log_bytes": math.log(1 + len(b))} | {k: sum(chr(c) in chars for c in b) / len(b) for k, chars in kinds.items()}
    out["other"] = sum(chr(c) not in string.ascii_lowercase + " \t" + "".join(kinds.values()) for c in b) / len(b)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / len(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    out |= {"word_length": mean, "word_spread": math.sqrt(sum((n - mean) ** 2 for n in lengths) / len(words)), "longest_word": math.log(1 + max(lengths)), "words_distinct": len(set(words)) / len(words)}
    out |= {"top_word": max(words.count(w) for w in set(words)) / len(words), "short_words": sum(n < 3 for n in lengths) / len(words)}
    out["symbol_ends"] = sum(w[-1] < 128 and not chr(w[-1]).isalnum() and chr(w[-1]) not in ".,;:?\"')" for w in words) / len(words)
    out |= {"lines_distinct": len(set(lines)) / len(lines), "line_words": math.log(1 + len(words) / len(lines)), "squeeze": len(zlib.compress(b, 1)) / len(b)}
    return [out[k] for k in quality_rules.STATISTICS]


def test_statistics_again(spark):
    texts = [r[1] for r in rows()] + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["\x1c a!! #b |\x0b\x0c(c) \u00e9\u00df\u3000x\r\n\n d_ e9 F"]
    for text in texts:
        assert quality_rules.statistics(text) == pytest.approx(statistics_plain(text), abs=1e-12)


def test_lasso_ends_where_its_conditions_hold():
    """At the optimum the slope is the penalty, against the weight's sign, where a weight is left, and no more than it elsewhere."""
    dice = np.random.default_rng(8)
    x = dice.normal(size=(400, 30))
    y = (x[:, 0] - 2 * x[:, 1] + dice.normal(size=400) > 0.3).astype(float)
    for penalty in (0.002, 0.02, 0.1):
        b, w = quality_rules._lasso(x, y, penalty)
        g = 1 / (1 + np.exp(-(x @ w + b))) - y
        slope, left = x.T @ g / len(y), w != 0
        assert abs(g.mean()) < 1e-4 and 0 < left.sum() < 30 or penalty == 0.002
        assert np.abs(slope[left] + penalty * np.sign(w[left])).max() < 1e-4 and np.abs(slope[~left]).max(initial=0) <= penalty + 1e-4
        # And no step from there, in any single weight, makes the penalised loss smaller.
        loss = lambda b, w: float(np.mean(np.logaddexp(0, x @ w + b) - y * (x @ w + b)) + penalty * np.abs(w).sum())  # noqa: B023, E731
        for k in range(30):
            for step in (-0.01, 0.01):
                assert loss(b, w + step * (np.arange(30) == k)) >= loss(b, w) - 1e-7
