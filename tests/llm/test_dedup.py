import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from helpers import docs, rows, same_rows

import corpus_pipeline
from codestrata.llm import components, similar_sets, simhash_dedup, substring_dedup


def cut(data, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in data]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for r, w in zip(data, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        yield r[0], w, gone


@pytest.mark.parametrize("window", [35, 3, 1])
def test_substring_against_brute_force(spark, window):
    data = rows()
    got = [tuple(r) for r in substring_dedup.remove_repeated(docs(spark), window=window, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    want = [(d, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()) for d, w, g in cut(data, window)]
    same_rows(got, want)


def test_substring_spans(spark):
    for r in substring_dedup.remove_repeated(docs(spark)).collect():
        inside = [i for s in r["intervals"] for i in range(s["start"], s["stop"])]
        assert len(inside) == r["n_removed"] and len(r["kept"].split()) == r["n_words"] - r["n_removed"]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeated(docs(spark, [(1, "b " * 36, "", "", 1), (2, "c " * 35, "", "", 1), (3, "d " * 34, "", "", 1), (4, "d " * 34, "", "", 1)])).collect()}
    assert got == {1: 36, 2: 0, 3: 0, 4: 0}
    assert substring_dedup.remove_repeated(docs(spark, [])).count() == 0


def test_minimisers_and_hashes():
    dice = np.random.default_rng(1)
    tokens = dice.integers(0, 4, 300).astype(np.uint64)
    h = substring_dedup.rolling(tokens, 5, substring_dedup._Q1)
    groups = collections.defaultdict(set)
    for i, x in enumerate(h.tolist()):
        groups[tuple(tokens[i : i + 5].tolist())].add(x)
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len(set(h.tolist()))
    m = substring_dedup.minimisers(tokens, 35, 8)
    assert len(m) == 266 and len(substring_dedup.minimisers(tokens[:34], 35, 8)) == 0


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def linked(fps, distance=3):
    """The smallest member of each fingerprint's component."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(root)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in root}


def test_simhash_against_brute_force(spark):
    data = rows()
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_dedup.link_documents(docs(spark)).collect()]
    fps = [fingerprint(r[1]) for r in data]
    roots = linked(set(fps))
    least = {}
    for r, f in zip(data, fps, strict=True):
        if r[0] is not None:
            least[roots[f]] = min(least.get(roots[f], r[0]), r[0])
    same_rows(got, [(r[0], f"{f:016x}", least.get(roots[f])) for r, f in zip(data, fps, strict=True)])
    assert simhash_dedup.link_documents(docs(spark, [])).count() == 0
    assert [r["component_id"] for r in simhash_dedup.link_documents(docs(spark, [(None, "a", "", "", 0), (None, "a", "", "", 0)])).collect()] == [None, None]


def clouds(dice, n):
    out = set()
    for _ in range(n):
        centre = dice.getrandbits(64)
        for _ in range(dice.randrange(1, 60)):
            x = centre
            for _ in range(dice.randrange(5)):
                x ^= 1 << dice.randrange(64)
            out.add(x)
    return out


@pytest.mark.parametrize(("distance", "large"), [(3, 1 << 16), (3, 4), (5, 8), (0, 1 << 16), (1, 2)])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, distance, large):
    monkeypatch.setattr(simhash_dedup, "LARGE", large)
    monkeypatch.setattr(simhash_dedup, "SMALL", 3)
    fps = clouds(random.Random(distance), 12)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    links = simhash_dedup.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"), distance)
    rows_ = links.collect()
    assert all(0 < (signed[r["a"]] ^ signed[r["b"]]).bit_count() <= distance for r in rows_)
    assert len(rows_) < 40 * len(fps)
    roots = {r["node"]: r["root"] for r in components.star_components(links).collect()}
    mine, want = {}, linked(fps, distance)
    for s, f in signed.items():
        mine.setdefault(roots.get(s, s), set()).add(f)
    theirs = {}
    for f, r in want.items():
        theirs.setdefault(r, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_spanning_links_by_flips(monkeypatch):
    monkeypatch.setattr(simhash_dedup, "DENSE", 10)
    dice = random.Random(4)
    fps = np.array([dice.getrandbits(9) for _ in range(300)], dtype=np.int64)
    want = linked({int(f) for f in fps}, 2)
    links = simhash_dedup.spanning_links(fps, 2)
    assert len(links) == len(want) - len(set(want.values()))


def test_star_components(spark):
    dice = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 130)] + [(dice.randrange(200, 260), dice.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}
    assert components.star_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 90, 1 << 16])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    dice = random.Random(few)
    edges = [(i, i + 1) for i in range(40)] + [(200, k) for k in range(101, 160)] + [(dice.randrange(-60, 0), dice.randrange(-60, 0)) for _ in range(50)] + [(1 << 62, -(1 << 62)), (7, 7)]
    edges += [(b, a) for a, b in edges[::3]] + edges[::5]
    dice.shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = [(r["node"], r["root"]) for r in components.star_components(frame).collect()]
    assert sorted(got) == sorted((x, r) for x, r in root.items() if x != r)
    assert components.star_components(frame.where("a = b")).count() == 0


def work_of(spark, name, run):
    """Jobs and tasks that the driver keeps account of for ``run``."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    jobs = [status.getJobInfo(j) for j in status.getJobIdsForGroup(name)]
    return len(jobs), sum(x.numTasks for j in jobs for s in j.stageIds if (x := status.getStageInfo(s)) and x.numCompletedTasks)


def test_few_links_take_no_rounds_and_a_round_few_tasks(spark, monkeypatch):
    """The driver's memory holds every task of the last thousand stages, so rounds over many partitions fill it."""
    held = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
        jobs, tasks = work_of(spark, "few-links", lambda: components.star_components(chain).count())
        assert jobs <= 12 and tasks < 5 * 23
        monkeypatch.setattr(components, "FEW", 0)
        links = components.cut_lineage(chain.repartition(23, "a"))
        jobs, tasks = work_of(spark, "a-round", lambda: components.cut_lineage(components._round(links)))
        assert 0 < tasks < 12 * 23
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_of_each(spark):
    data = rows()
    kept = simhash_dedup.one_of_each(docs(spark))
    assert kept.columns == docs(spark).columns
    roots = linked({fingerprint(r[1]) for r in data})
    groups = collections.defaultdict(list)
    for r in data:
        groups[roots[fingerprint(r[1])]].append(r)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(groups)
    want = {min((r[0] is None, r[0] or 0) for r in g) for g in groups.values()}
    assert {(d is None, d or 0) for d, _ in got} == want
    assert simhash_dedup.one_of_each(docs(spark, [])).count() == 0


def jaccard_roots(texts, similarity=0.8, width=5):
    """The smallest index of each text's component, by all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) / len(a | b) >= similarity:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def near_copies(dice):
    words = [f"w{i}" for i in range(500)]
    out = []
    for size in (30, 60, 120, 250, 400):
        base = [dice.choice(words) for _ in range(size)]
        for edits in (0, 1, 1, 2, 2, 3, 4, 6, 8, 12):
            text = list(base)
            for _ in range(edits):
                text[dice.randrange(size)] = dice.choice(words)
            out.append(" ".join(text))
        out.append("\n".join(base + base).upper())
    return out


@pytest.mark.parametrize(("small", "tile"), [(16, 1024), (3, 1024), (2, 3)])
def test_near_copies_against_all_pairs(spark, monkeypatch, small, tile):
    monkeypatch.setattr(similar_sets, "SMALL", small)
    monkeypatch.setattr(similar_sets, "TILE", tile)
    data = rows() + [(5000 + i, t, "en", "s", 1) for i, t in enumerate(near_copies(random.Random(3)))]
    roots = jaccard_roots([r[1] for r in data])
    least = {}
    for r, x in zip(data, roots, strict=True):
        least[x] = min(least.get(x, (True, 0)), (r[0] is None, r[0] or 0))
    frame = docs(spark, data)
    kept = similar_sets.one_of_each(frame)
    assert kept.columns == frame.columns
    same_rows([(r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()], list(least.values()))
    assert similar_sets.one_of_each(docs(spark, [])).count() == 0


def hot_groups(dice):
    """Texts around a few bases, near and less near, in chains too."""
    words = [f"w{i}" for i in range(400)]
    first = [dice.choice(words) for _ in range(120)]
    bases = [first, [dice.choice(words) if dice.random() < 0.05 else w for w in first], [dice.choice(words) for _ in range(120)]]
    out = []
    for base, n in zip(bases, (150, 60, 40), strict=True):
        for _ in range(n):
            text = list(base)
            for _ in range(dice.choice([0, 1, 1, 2, 3, 5])):
                text[dice.randrange(120)] = dice.choice(words)
            out.append(" ".join(text))
    chain = list(first)
    for _ in range(40):
        chain[dice.randrange(120)] = dice.choice(words)
        out.append(" ".join(chain))
    dice.shuffle(out)
    return out


@pytest.mark.parametrize(("rounds", "shingles"), [(12, 2 << 20), (1, 2 << 20), (0, 2 << 20), (12, 700)])
def test_hot_groups_against_all_pairs(spark, monkeypatch, rounds, shingles):
    monkeypatch.setattr(similar_sets, "SMALL", 4)
    monkeypatch.setattr(similar_sets, "TILE", 20)
    monkeypatch.setattr(similar_sets, "TILE_SHINGLES", shingles)
    monkeypatch.setattr(similar_sets, "ROUNDS", rounds)
    data = [(i, t, "en", "s", 1) for i, t in enumerate(hot_groups(random.Random(11)))]
    want = set(jaccard_roots([r[1] for r in data]))
    got = [r["doc_id"] for r in similar_sets.one_of_each(docs(spark, data)).collect()]
    assert sorted(got) == sorted(want) and 3 < len(want) < 200


def test_copies_of_a_hot_group_are_not_compared_with_each_other(spark, monkeypatch):
    monkeypatch.setattr(similar_sets, "TILE", 50)
    dice = random.Random(12)
    base = [f"w{i}" for i in range(300)]
    sets = {}
    for at in dice.sample(range(300), 200):
        text = " ".join([*base[:at], "other", *base[at + 1 :]])
        sets[len(sets)] = text
    for i in range(5):
        sets[len(sets)] = " ".join(f"far{i} w{j}" for j in range(150))
    texts = spark.createDataFrame(list(sets.items()), "node long, text string")
    runs = spark.createDataFrame([(1, i, 296) for i in sets], "key long, node long, n int")
    links, left = similar_sets._thinned(runs, texts, 0.8, 5)
    assert sum(d.count() for d in links) == 199 and sum(d.count() for d in left) == 5
    links, left = similar_sets._thinned(runs.limit(0), texts, 0.8, 5)
    assert links == [] and [d.count() for d in left] == [0]


def test_the_stage_drops_what_is_similar(spark):
    data = [(i, t, "en", "s", 1) for i, t in enumerate(near_copies(random.Random(5)))]
    want = set(jaccard_roots([r[1] for r in data]))
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs(spark, data), "").collect()]
    assert sorted(got) == sorted(want) and len(want) < len(data)


def test_similar_sets_meet_as_often_as_said():
    dice = np.random.default_rng(8)
    met = {0.8: 0, 0.85: 0, 0.3: 0}
    for similarity in met:
        for _ in range(400):
            shared = round(100 * similarity)
            pool = dice.integers(0, 1 << 64, 100, dtype=np.uint64)
            only = (100 - shared) // 2
            a, b = np.unique(pool[: shared + only]), np.unique(np.concatenate([pool[:shared], pool[shared + only :]]))
            met[similarity] += bool(np.intersect1d(similar_sets.variants(a), similar_sets.variants(b)).size)
    assert met[0.8] == met[0.85] == 400 and met[0.3] < 260


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_recall_and_precision_of_the_stage(spark, sf):
    """All pairs of different texts that share a shingle, against the components of the stage."""
    table = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    data = sorted((r["doc_id"], r["text"]) for r in table.collect())
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table, "").collect()}
    sets = [frozenset(similar_sets.shingles(t).tolist()) for _, t in data]
    by = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for h in s:
            by[h].append(i)
    shared = collections.Counter((a, b) for at in by.values() for i, b in enumerate(at) for a in at[:i])
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for (a, b), n in shared.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            pairs += sets[a] != sets[b]
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert kept == {data[i][0] for i in range(len(data)) if find(i) == i} and pairs >= 10


def test_the_stage_links_by_deletion_variants_of_bits(spark, monkeypatch):
    """Near copies within three bits are found where no minima meet; what bits bring together is held against the sets."""

    def none_meet(similarity):
        def meet(batches):
            for _ in batches:
                pass
            return iter(())

        return meet

    monkeypatch.setattr(similar_sets, "_meet", none_meet)
    dice = random.Random(21)
    data = []
    for i in range(6):
        words = [f"w{dice.randrange(10**6)}" for _ in range(1500)]
        for j in range(3):
            data.append((3 * i + j, " ".join([*words[: 100 * j], "other", *words[100 * j + 1 :]]), "en", "s", 1))
    data.append((100, "w1 " * 40, "en", "s", 1))
    data.append((101, "w1 " * 60, "en", "s", 1))
    bits = {r[0]: simhash_dedup.fingerprint(r[1], 5) for r in data}
    near = [[b for b in bits if b // 3 == a // 3 and (bits[a] ^ bits[b]).bit_count() <= 3 and b < a] for a in range(18)]
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs(spark, data), "").collect()}
    assert sum(map(bool, near)) > 5 and not {a for a in range(18) if near[a]} & kept
    assert {0, 3, 6, 9, 12, 15, 100} <= kept and 101 not in kept


def test_runs_of_nearly_the_same_members_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(similar_sets, "TILE", 50)
    dice = random.Random(3)
    runs = {(key, node) for key in range(100, 140) for node in dice.sample(range(60), 40)} | {(key, 1000 + key * 20 + i) for key in range(200, 205) for i in range(20)}
    frame = spark.createDataFrame([(k, node, 5) for k, node in sorted(runs)], "key long, node long, n int")
    got = similar_sets._bundled(similar_sets._bundled(frame, similar_sets.F.min), similar_sets.F.max).collect()
    members = collections.defaultdict(set)
    for r in got:
        members[r["key"]].add(r["node"])
    for key in {k for k, _ in runs}:
        assert any({n for k, n in runs if k == key} <= m for m in members.values())
    assert len(got) < len(runs) / 4 and sum(len(m) for m in members.values()) == len(got)
    # Runs that share one member and nothing else would be a group of many tiles.
    apart = [(key, node, 5) for key in range(10) for node in [0, *range(1000 + key * 100, 1030 + key * 100)]]
    assert len(similar_sets._bundled(spark.createDataFrame(apart, "key long, node long, n int"), similar_sets.F.min).collect()) == len(apart)


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    seen = []
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(similar_sets, "cut_lineage", lambda df, f=similar_sets.cut_lineage: (seen.append(int(spark.conf.get(name))), f(df))[1])
    sizes = spark.range(0, 100, 1, 1).mapInArrow(lambda batches: (b.select(["id"]).slice(0, 1) for b in batches), "id long")
    monkeypatch.setattr(similar_sets, "BATCH", 10)
    assert similar_sets._with_texts(sizes).count() == 10 and seen == [10] and spark.conf.get(name) == before
    similar_sets.one_of_each(docs(spark)).count()
    assert 10 in seen[1:] and spark.conf.get(name) == before
