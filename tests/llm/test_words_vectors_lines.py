"""Spelling variants, vector codes and line labels against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import docs, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from codestrata.llm import line_labels, spelling_forms, vector_codes
from codestrata.llm.quality_rules import held_out_column
from oracle import SF

# spelling variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def words_plain(data):
    n = Counter()
    for r in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def forms_plain(n):
    out = {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (len(near), best if best and n[best] >= 2 * n[w] else None)
    rows = set()
    for w, (k, form) in out.items():
        root = w
        while out[root][1]:
            root = out[root][1]
        rows.add((w, form, root, n[w], k, n[form] if form else None))
    return rows


def variants(seed, n=250):
    """Texts of words that are often one or two edits apart, in runs of one letter, too."""
    dice = random.Random(seed)
    stems = ["aaaaaa", "ababab", "receive", "éàéàéà", "interna", "zzzzzzzzzzzz", "internationalisation"]
    out = []
    for i in range(n):
        words = []
        for _ in range(dice.randrange(12)):
            w = list(dice.choice(stems))
            for _ in range(dice.choice((0, 0, 0, 1, 1, 2))):
                at = dice.randrange(len(w))
                w[at : at + dice.randrange(2)] = dice.choice(("", "a", "é", "z", "ß"))
            words.append(dice.choice(("%s", "%s", "X%s", "%s9"))[:] % "".join(w))
        out.append((i if i % 9 else None, dice.choice((" ", "-", "\n")).join(words), "en", "s", 1))
    return out


@pytest.mark.parametrize("sizes", [{}, {"bin_words": 20, "key_words": 2}])
def test_forms_against_all_pairs(spark, sizes):
    data = rows() + variants(1) + [(5, "CafÉs CAFÉs cafÉs cafés cafés cafés", "fr", "s", 1)]
    got = {tuple(r) for r in spelling_forms.spelling_forms(docs(spark, data), **sizes).collect()}
    want = forms_plain(words_plain(data))
    assert len(want) > 50 and any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want)
    assert got == want


def test_no_words(spark):
    assert spelling_forms.spelling_forms(docs(spark, [])).count() == 0
    assert spelling_forms.spelling_forms(docs(spark, [(1, None, None, None, None), (None, "", None, None, None), (2, "no word here", None, None, None)])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", min_size=2, max_size=7), max_size=60), st.text("abé", min_size=2, max_size=7), st.integers(0, 7))
def test_automaton(words, asked, exact):
    order = sorted(words)
    automaton, exact = spelling_forms.Automaton(order), min(exact, len(asked))
    found = automaton.near(asked, exact)
    assert sorted(found) == [i for i, w in enumerate(order) if w[:exact] == asked[:exact] and one_edit(w, asked)]


def test_automaton_is_minimal():
    words = sorted(a + b for a in ("form", "norm", "warm") for b in ("", "s", "ed", "ing"))
    states, todo = set(), [0]
    automaton = spelling_forms.Automaton(words)
    while todo:
        s = todo.pop()
        if s not in states:
            states.add(s)
            todo += [to for to, _ in automaton.edges[s].values()]
    assert len(states) == len({frozenset(w[k:] for w in words if w.startswith(w0[:k])) for w0 in words for k in range(len(w0) + 1)})


# vector codes


def codes_plain(data, entries=256, rounds=4):
    kept = [(i, label, np.array([int(np.floor(float(x) * 1024)) for x in v])) for i, v, label in data if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2].astype(np.int32).tobytes()))
    if not kept:
        return []
    parts = [np.stack([np.split(v, 4)[p] for _, _, v in kept]) for p in range(4)]
    books = [x[:entries].copy() for x in parts]
    nearest = lambda p: ((parts[p][:, None, :] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p in range(4):
            of = nearest(p).argmin(axis=1)
            for e in range(len(books[p])):
                if (of == e).any():
                    books[p][e] = parts[p][of == e].sum(axis=0) // (of == e).sum()
    found = [nearest(p) for p in range(4)]
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    of_label = defaultdict(int)
    out = []
    for k, (i, label, _) in enumerate(kept):
        error = sum(int(f[k].min()) for f in found)
        of_label[label] += error
        out.append((i, "".join(f"{f[k].argmin():02x}" for f in found), error, label))
    return [(i, c, e, of_label[label], sha) for i, c, e, label in out]


VECTORS = "vec_id long, embedding array<float>, label int, of string, v int, code string, n int, entry string"


def vectors(spark, data):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in data], VECTORS).repartition(3)


def some_vectors(n=700, dim=8, seed=3):
    dice = np.random.default_rng(seed)
    centre = dice.normal(size=(12, dim)) / 3
    x = np.round(centre[dice.integers(0, 12, n)] + dice.normal(size=(n, dim)) / 20, 2)
    data = [(int(i), [float(v) for v in x[i]], int(i % 3) if i % 5 else None) for i in range(n)]
    data += [(n + 1, None, 1), (n + 2, [None] * dim, 1), (n + 3, [float("nan")] * dim, 2), (n + 4, [float("inf")] + [0.0] * (dim - 1), 2), (n + 5, [], 1)]
    data += [(7, data[7][1], 0), (None, data[8][1], 1), (n + 6, [0.0] * dim, None), (n + 7, [-0.0001] * dim, None), (-3, data[3][1], 2)]
    return data


@pytest.mark.parametrize("entries", [256, 5])
def test_codes_against_all_distances(spark, entries):
    data = some_vectors()
    got = [tuple(r) for r in vector_codes.vector_codes(vectors(spark, data), entries=entries).collect()]
    assert sorted(got, key=repr) == sorted(codes_plain(data, entries), key=repr)


def test_few_or_no_vectors(spark):
    assert vector_codes.vector_codes(vectors(spark, [])).count() == 0
    assert vector_codes.vector_codes(vectors(spark, [(1, None, 1)])).count() == 0
    data = [(i, [0.5, 0.25, -0.5, float(i)], None) for i in range(3)] * 2
    assert sorted(map(tuple, vector_codes.vector_codes(vectors(spark, data)).collect())) == sorted(codes_plain(data))
    with pytest.raises(ValueError, match="one length"):
        vector_codes.vector_codes(vectors(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)]))
    with pytest.raises(ValueError, match="one length"):
        vector_codes.vector_codes(vectors(spark, [(1, [1.0] * 6, 1)]))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 200), st.integers(1, 40), st.sampled_from([1, 3, 1000]))
def test_filtering(seed, n, m, width):
    """Sums, numbers and entries are those of comparing each point with each entry; ties are frequent."""
    dice = np.random.default_rng(seed)
    points, entries = dice.integers(-width, width + 1, (n, 3)), dice.integers(-width, width + 1, (m, 3))
    sums, counts, of = vector_codes.Tree(points).assign(entries, each=True)
    want = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert of.tolist() == want.tolist()
    assert counts.tolist() == np.bincount(want, minlength=m).tolist()
    assert all((sums[e] == points[want == e].sum(axis=0)).all() for e in range(m))


def test_subtrees_are_assigned_whole():
    """Of points in a few clumps far apart most are never looked at."""
    dice = np.random.default_rng(1)
    centre = dice.integers(-100_000, 100_000, (16, 4))
    points = np.repeat(centre, 500, axis=0) + dice.integers(-50, 50, (8000, 4))
    tree = vector_codes.Tree(points)
    looked = []
    tree.points = type("Watched", (), {"__getitem__": lambda _, rows: looked.append(len(rows)) or points[rows], "__len__": lambda _: len(points)})()
    counts = tree.assign(centre, each=False)[1]
    assert counts.tolist() == [500] * 16 and sum(looked) < 800


# line labels


def numbers_plain(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {i + k for where in at.values() if len(where) > 1 for i in where for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(covered)


def field(spark):
    return line_labels.fit_lines(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_numbers_of_whole_texts(spark):
    odd = [(9000, "a\r\na\r\n b\x0bc\n\nA B 　  x #|\n" * 3, "en", "s", 1), (9001, "é " * 30 + "\n\n", "fr", "s", 1), (9002, "\x1c\x1d x y\n x y\nx y", "en", "s", 1), (9003, "\n".join(["one line of words here"] * 40), "en", "s", 1)]
    table = docs(spark, rows() + odd).union(docs(spark, [(10_000 + r["doc_id"], r["text"], None, None, None) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]))
    texts = defaultdict(list)
    for r in table.collect():
        n = numbers_plain(r["text"])
        texts[r["doc_id"]].append((*n, n[0] < 10 or 100 * n[4] > 20 * n[0]))
    got = defaultdict(list)
    for r in line_labels.judge_lines(table, field(spark)).collect():
        got[r["doc_id"]].append(tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")))
        assert not (r["base_failed"] and r["kept"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}


def test_no_documents_and_no_labels(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = line_labels.fit_lines(none, labels)
    assert line_labels.judge_lines(none, model).count() == 0
    kept = {r["doc_id"] for r in line_labels.judge_lines(docs(spark), model).collect() if r["kept"]}
    assert kept == {r[0] for r in rows() if not (lambda n: n[0] < 10 or 100 * n[4] > 20 * n[0])(numbers_plain(r[1]))}  # every line is content


def test_labels_of_lines(spark):
    model = field(spark)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for r in line_labels.judge_lines(table, model, with_labels=True).join(table.select("doc_id", "text"), "doc_id").collect():
        lines = [len(x.encode().split()) for x in (r["text"] or "").split("\n") if x.encode().split()]
        assert len(r["content"]) == len(lines)
        share = sum(n for n, c in zip(lines, r["content"], strict=True) if c) / sum(lines) if lines else 0.0
        assert abs(share - r["content_share"]) < 1e-9
        assert r["kept"] == (not r["base_failed"] and share >= model.least_share)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 8))
def test_viterbi_against_all_sequences(seed, n):
    dice = np.random.default_rng(seed)
    scores, transition = dice.normal(size=(n, 2)), dice.normal(size=(2, 2))
    value = lambda y: sum(scores[i, y[i]] for i in range(n)) + sum(transition[a, b] for a, b in itertools.pairwise(y))
    assert line_labels.viterbi(scores, transition) == list(max(itertools.product((0, 1), repeat=n), key=value))


def test_likelihood_against_all_sequences():
    dice = np.random.default_rng(5)
    lengths = [1, 4, 2, 5, 1]
    starts, x, y = np.cumsum([0, *lengths[:-1]]), dice.normal(size=(13, 3)), dice.integers(0, 2, 13)
    w = dice.normal(size=10)

    def whole(w):
        emission, transition, out = w[:6].reshape(2, 3), w[6:].reshape(2, 2), 0.0
        for a, n in zip(starts, lengths, strict=True):
            s = x[a : a + n] @ emission.T
            value = lambda z, s=s, n=n: sum(s[i, z[i]] for i in range(n)) + sum(transition[p, q] for p, q in itertools.pairwise(z))
            out += value(y[a : a + n]) - np.log(sum(np.exp(value(z)) for z in itertools.product((0, 1), repeat=n)))
        return out

    value, g, gt = line_labels.likelihood((w[:6].reshape(2, 3), w[6:].reshape(2, 2)), x, y, starts)
    assert abs(value - whole(w)) < 1e-9
    slopes = [(whole(w + 1e-6 * e) - whole(w - 1e-6 * e)) / 2e-6 for e in np.eye(10)]
    assert np.allclose(np.concatenate([g.ravel(), gt.ravel()]), slopes, atol=1e-5)


def test_fit_ends_where_the_slope_does():
    dice = np.random.default_rng(6)
    starts, x = np.arange(0, 200, 5), dice.normal(size=(200, 4))
    y = (x[:, 0] + dice.normal(size=200) > 0).astype(int)
    emission, transition = line_labels.fit_field(x, y, starts)
    _, g, gt = line_labels.likelihood((emission, transition), x, y, starts)
    assert np.abs(g / 200 - line_labels.PENALTY * emission).max() < 1e-5 and np.abs(gt / 200 - line_labels.PENALTY * transition).max() < 1e-5


def test_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = line_labels.fit_lines(table, labels)
    held = labels.where(held_out_column(labels["doc_id"])).select("doc_id", "quality")
    n = Counter((r["quality"], r["kept"]) for r in line_labels.judge_lines(table, model).join(held, "doc_id").collect() if not r["base_failed"])
    assert n[1, True] >= 0.97 * (n[1, True] + n[1, False]) > 0
    assert n[0, False] >= 0.8 * (n[0, False] + n[0, True])
