import collections
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from helpers import docs, rows, same_rows
from pyspark.sql import functions as F

from codestrata.llm import common, pfair_mix, preference_format, queries, shard_tree, token_blocks, topk_search


def vectors():
    dice = random.Random(2)
    v = [(i, [dice.gauss(0, 0.2) for _ in range(16)]) for i in range(0, 300)]
    v += [(400 + i, v[0][1]) for i in range(15)] + [(500, [1.0] * 15), (600, [0.5] * 15), (700, None), (800, [None] * 16), (900, [float("nan")] * 16), (1000, [float("inf")] * 16), (None, [0.1] * 16), (1100, []), (1200, [])]
    v += [(100, v[100][1]), (200, v[7][1]), (0, [-x for x in v[0][1]]), (1300, [1e300] + [0.0] * 15), (1301, [-1e300] + [0.0] * 15), (1400, [3e15] * 16)]
    return v


def best(data, is_query, k):
    ok = [(n, i, [int(np.floor(x * 1024)) if abs(x * 1024) < 1e18 else int(x * 1024) for x in e]) for n, (i, e) in enumerate(data) if i is not None and e is not None and all(x is not None and np.isfinite(x * 1024) for x in e)]
    for n, i, q in ok:
        if is_query(i):
            found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c, strict=True)))), j) for m, j, c in ok if m != n and len(c) == len(q))[:k]
            yield from ((i, r + 1, j, -s) for r, (s, j) in enumerate(found))


@pytest.mark.parametrize(("block", "k", "column"), [(7, 10, 1 << 14), (8192, 3, 64 << 20), (16, 1, 64 << 20)])
def test_topk_against_brute_force(spark, monkeypatch, block, k, column):
    monkeypatch.setattr(topk_search, "VECTORS", block)
    monkeypatch.setattr(topk_search, "COLUMN_BYTES", column)
    monkeypatch.setattr(topk_search, "ROW_BLOCKS", 4)
    monkeypatch.setattr(topk_search, "QUERIES", 2)
    data = vectors()
    d = spark.createDataFrame([(*v, 1, 2) for v in data], "vec_id long, embedding array<double>, score int, rank int")
    got = [tuple(r) for r in topk_search.top_k(d, F.col("vec_id") % 100 == 0, k).collect()]
    same_rows(got, list(best(data, lambda i: i % 100 == 0, k)))
    assert topk_search.top_k(d.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_prune_and_keep_ties():
    dice = np.random.default_rng(3)
    grid = dice.integers(-300, 300, (64, 4000))
    b = topk_search.Best(np.array([-1, -2]), grid[:, :2].copy(), 10)
    for at in range(0, 4000, 500):
        b.meet(topk_search.Block(np.arange(at, at + 500), grid[:, at : at + 500]))
    for q in range(2):
        want = sorted((-int(s), i) for i, s in enumerate(grid[:, q] @ grid))[:10]
        assert list(zip((-b.score[q]).tolist(), b.found[q].tolist(), strict=True)) == want


def test_shards(spark):
    trees = [shard_tree.hash_tree(n) for n in (16, 17, 18)]
    data = rows(n=400)
    got = shard_tree.number_shards(docs(spark, data), *trees[:2]).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16 and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and any(r["grown_shard"] == 16 for r in got)
    same_rows([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in data])
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_id.values())
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    one, two = (shard_tree.assign_shards(ids, t).groupBy("shard").count().collect() for t in trees[::2])
    assert len(one) == 16 and len(two) == 18 and all(1000 < r["count"] < 1500 for r in one)
    moved = shard_tree.assign_shards(shard_tree.assign_shards(ids, trees[1], shard_col="a"), trees[2], shard_col="b").where("a <> b")
    assert {r["b"] for r in moved.collect()} == {17}
    assert shard_tree.number_shards(docs(spark, []), *trees[:2]).count() == 0
    assert docs(spark).columns == shard_tree.assign_shards(docs(spark), trees[0]).columns[:-1]
    own = docs(spark).withColumn("Shard", F.lit("mine"))
    got = shard_tree.assign_shards(own, trees[0])
    assert got.columns == [*own.columns, "shard_"] and got.where("Shard <> 'mine' or shard_ is null").count() == 0


def test_weights_draw_in_proportion_and_confine_movement(spark):
    leaf = lambda k, w: shard_tree.Node(f"shard {k}", w, shard=k)
    tree = lambda w: shard_tree.Node("root", children=(shard_tree.Node("r0", children=(shard_tree.Node("a", children=(leaf(0, 1.0), leaf(1, 1.0))),)), shard_tree.Node("r1", children=(shard_tree.Node("b", children=(leaf(2, w), leaf(3, 1.0))),))))
    ids = spark.range(30_000).select(F.col("id").alias("doc_id"))
    d = shard_tree.assign_shards(shard_tree.assign_shards(ids, tree(1.0), shard_col="a"), tree(3.0), shard_col="b")
    counts = {r["b"]: r["count"] for r in d.groupBy("b").count().collect()}
    assert counts[2] == pytest.approx(15_000, rel=0.06) and counts[0] == pytest.approx(5_000, rel=0.1)
    assert d.where("a in (0, 1) and b in (0, 1) and a <> b").count() == 0 and d.where("a in (2, 3) and b in (0, 1)").count() == 0


def test_gapless_numbers(spark):
    d = spark.createDataFrame([("a", i % 50, 1 + i % 3) for i in range(200)] + [(None, 1, 4)], "grp string, x int, copies int").groupBy("grp", "x").agg(F.sum("copies").alias("copies"))
    for copies in (None, "copies"):
        spans = collections.defaultdict(list)
        for r in common.gapless(d, ["grp"], ["x"], 7, copies).collect():
            spans[r["grp"]].append((r["pos"], r["pos"] + (r["copies"] if copies else 1)))
        assert all(sorted(s)[0][0] == 0 and all(a[1] == b[0] for a, b in zip(sorted(s), sorted(s)[1:], strict=False)) for s in spans.values())


def lags(order, weights):
    total, seen, worst = sum(map(Fraction, weights.values())), collections.Counter(), 0.0
    for t, s in enumerate(order, 1):
        seen[s] += 1
        worst = max(worst, max(abs(seen[x] - t * w / total) for x, w in weights.items()))
    return worst


def earliest_deadlines(weights, slots):
    """The schedule by its definition, over all slots at once."""
    total = sum(map(Fraction, weights.values()))
    share, seen, out = {s: w / total for s, w in weights.items()}, collections.Counter(), []
    for t in range(slots):
        due = [(math.ceil((seen[s] + 1) / w), i, s) for i, (s, w) in enumerate(share.items()) if math.floor(seen[s] / w) <= t]
        out.append(min(due)[2])
        assert min(due)[0] > t
        seen[out[-1]] += 1
    return out


def dealt(weights, length, slots):
    """The schedule in stretches, with each block held against its window."""
    whole, names, out = list(pfair_mix.whole_weights(weights).values()), list(weights), []
    total, seen = sum(whole), [0] * len(whole)
    for n, have, until in pfair_mix.borders(whole, length, slots):
        assert have == seen
        for i, k in pfair_mix.stretch(whole, n * length, min(slots, (n + 1) * length), have, until):
            assert k == seen[i] and k * total // whole[i] <= len(out) < -(-(k + 1) * total // whole[i])
            seen[i] += 1
            out.append(names[i])
    assert len(out) == slots
    return out


@pytest.mark.parametrize("seed", range(40))
def test_stretches_stay_within_a_block(seed):
    dice = random.Random(seed)
    draw = dice.choice([lambda: Fraction(dice.random() ** 4 + 1e-6), lambda: Fraction(dice.randrange(1, 9)), lambda: Fraction(10) ** dice.randrange(-9, 3)])
    weights = {f"s{i}": draw() for i in range(dice.randrange(1, 30))}
    slots = dice.randrange(1, 300)
    assert lags(dealt(weights, dice.choice([1, 2, 3, 7, 50]), slots), weights) < 1
    assert dealt(weights, slots, slots) == earliest_deadlines(weights, slots)


def test_extreme_weights_are_kept():
    weights = {"big": Fraction(991, 1000)} | {f"s{i}": Fraction(9, 1000 * 8999) for i in range(8999)}
    order = dealt(weights, 40_000, 130_000)
    counts = collections.Counter(order)
    assert abs(counts["big"] - 130_000 * 0.991) < 1 and max(abs(n - 130_000 * float(weights[s])) for s, n in counts.items()) < 1
    for t in (1, 999, 39_999, 40_000, 40_001, 88_888, 130_000):
        seen = collections.Counter(order[:t])
        assert all(abs(seen[s] - t * w) < 1 for s, w in weights.items())
    order = dealt({"one": Fraction(1), "many": Fraction(10**9)}, 5_000, 20_000)
    assert abs(order.count("one") - 20_000 / (10**9 + 1)) < 1
    assert pfair_mix.whole_weights({"a": 0.5, "b": 1.5, "c": 2}) == {"a": 1, "b": 3, "c": 4}
    for wrong in (0, -1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            pfair_mix.whole_weights({"a": wrong})


@pytest.mark.parametrize("length", [None, 3])
def test_mix(spark, length):
    data = [(i, f"text {i}", "en", "big", 0) for i in range(300)] + [(1000 + i, f"t {i}", "en", "small", 0) for i in range(10)] + [(5000, "same", "en", None, 0)] * 6
    weights = {"big": 3.0, "small": 1.0, None: 1.0}
    got = pfair_mix.mix_sources(docs(spark, data), weights, block_docs=4, length=length).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in data}
    by_slot = collections.defaultdict(list)
    for r in got:
        by_slot[r["slot"]].append(r)
    assert sorted(by_slot) == list(range(len(by_slot)))
    order = [by_slot[t][0]["source"] for t in range(len(by_slot))]
    assert all(len({(r["source"], r["block"], r["epoch"]) for r in b}) == 1 for b in by_slot.values())
    assert lags(order, weights) < 1
    if length is None:  # the driver sorts names, null last
        assert order == earliest_deadlines({"big": Fraction(3), "small": Fraction(1), None: Fraction(1)}, len(order))
    # It ends with the last block that had not gone before.
    assert any(r["source"] == order[-1] and r["epoch"] == 0 for r in by_slot[len(order) - 1])
    turns_of = collections.Counter()
    for t in range(len(order)):
        r = by_slot[t][0]
        blocks = {"big": 75, "small": 3, None: 2}[r["source"]]
        assert (r["epoch"], r["block"]) == divmod(turns_of[r["source"]], blocks)
        turns_of[r["source"]] += 1
    counts = collections.Counter((r["source"], r["epoch"]) for r in got)
    assert counts["big", 0] == 300 and counts["small", 0] == 10 and counts[None, 0] == 6 and counts["small", 1] == 10
    same_rows([r["doc_id"] for r in pfair_mix.mixed_documents(docs(spark, data), weights=weights, block_docs=4, length=length).collect()], [r["doc_id"] for r in got])


def test_mix_of_odd_tables(spark):
    assert pfair_mix.mixed_documents(docs(spark)).columns == docs(spark).columns
    assert {r["doc_id"] for r in pfair_mix.mix_sources(docs(spark)).collect()} == {r[0] for r in rows()}
    assert pfair_mix.mix_sources(docs(spark, [])).count() == 0 and pfair_mix.mixed_documents(docs(spark, [])).columns == docs(spark).columns
    with pytest.raises(ValueError):
        pfair_mix.mix_sources(docs(spark), {"s0": 1.0})
    few = docs(spark, [(i, "t", "en", f"s{i}", 0) for i in range(2)])
    with pytest.raises(ValueError):
        pfair_mix.mix_sources(few, {"s0": 1.0, "s1": 1e-9})


def test_many_copies_of_a_row(spark, monkeypatch):
    monkeypatch.setattr(common, "RUN", 7)
    d = spark.createDataFrame([("a", 100), ("b", 1), ("c", 7), ("d", 8)], "k string, n long")
    same_rows([(r["k"], r["i"]) for r in common.each_copy(d, "n", "i").collect()], [(k, i) for k, n in (("a", 100), ("b", 1), ("c", 7), ("d", 8)) for i in range(n)])
    data = [(1, "same", "en", "s", 0)] * 500 + [(None, None, None, None, None)] * 300 + [(2, "x", "en", "s", 0)]
    got = shard_tree.number_shards(docs(spark, data), shard_tree.hash_tree(16), shard_tree.hash_tree(17)).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 801 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mixed = pfair_mix.mix_sources(docs(spark, data)).where("epoch = 0").collect()
    assert collections.Counter(r["doc_id"] for r in mixed) == {1: 500, None: 300, 2: 1} and len({(r["slot"], r["at"]) for r in mixed}) == 801


def turns():
    dice = random.Random(6)
    out = []
    for pair in range(30):
        shared = [("user" if i % 2 == 0 else "assistant", f"turn {i} é😀") for i in range(dice.randrange(4))]
        for side in (0, 1):
            more = [(dice.choice(["user", "assistant", "system", None]), dice.choice(["x", "y", "", None])) for _ in range(dice.randrange(3))]
            out += [(2 * pair + side, i, role, text) for i, (role, text) in enumerate(shared + more)]
    return [*out, (100, 0, "user", "alone"), (103, 0, "assistant", "alone too"), (None, 0, "user", "lost"), (104, None, "user", "b"), (104, None, "assistant", "a"), (104, None, "user", "b"), (105, 1, "assistant", "a")]


def test_preferences(spark):
    data = turns()
    d = spark.createDataFrame([(*t, "c", "p") for t in data], "conv_id long, turn int, role string, text string, chosen string, prompt string")
    got = preference_format.preference_rows(d, F.shiftright("conv_id", 1), F.col("conv_id") % 2 == 1).collect()
    convs = collections.defaultdict(list)
    for c, t, r, x in data:
        if c is not None:
            convs[c].append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or "")))
    plain = {c: [(r[1], x[1]) for _, r, x in sorted(v)] for c, v in convs.items()}
    assert len(got) == len({c >> 1 for c in plain})
    show = lambda ts: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in ts)
    for r in got:
        a, b = plain.get(2 * r["pair_id"], []), plain.get(2 * r["pair_id"] + 1, [])
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert r["n_common"] == n and r["prompt"] == show(a[:n]) and r["chosen"] == show(a[n:]) and r["rejected"] == show(b[n:])
        for side, ts in (("chosen", a[n:]), ("rejected", b[n:])):
            assert [r[side][s["start"] : s["stop"]] for s in r[f"{side}_learnt"]] == [f"{x}<|im_end|>\n" for role, x in ts if role == "assistant"]
    assert preference_format.preference_rows(d.limit(0), F.shiftright("conv_id", 1), F.lit(True)).count() == 0
    assert "Python" not in preference_format.preference_rows(d, F.col("conv_id"), F.lit(True))._jdf.queryExecution().toString()


def test_swapped_answers(spark):
    data = turns()
    d = spark.createDataFrame([(*t, "c", "p") for t in data], "conv_id long, turn int, role string, text string, chosen string, prompt string")
    pairs = preference_format.pair_conversations(d, F.shiftright("conv_id", 1), F.col("conv_id") % 2 == 1)
    got = preference_format.format_pairs(preference_format.swapped_answers(pairs)).collect()
    convs = collections.defaultdict(list)
    for c, t, r, x in data:
        if c is not None:
            convs[c].append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or "")))
    plain = {c: [(r[1], x[1]) for _, r, x in sorted(v)] for c, v in convs.items()}
    assert sorted(r["pair_id"] for r in got) == sorted(plain) and sum(r["n_common"] > 0 for r in got) > len(got) // 2
    show = lambda ts: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in ts)
    for r in got:
        mine, other = plain[r["pair_id"]], plain.get(r["pair_id"] ^ 1, [])
        at = max((i for i, t in enumerate(mine) if t[0] == "assistant"), default=None)
        lent = [x for x in other if x[0] == "assistant"][-1:]
        swapped = mine if at is None else mine[:at] + lent + mine[at + 1 :]
        n = 0
        while n < min(len(mine), len(swapped)) and mine[n] == swapped[n]:
            n += 1
        assert (r["n_common"], r["prompt"], r["chosen"], r["rejected"]) == (n, show(mine[:n]), show(mine[n:]), show(swapped[n:]))
        assert at is None or n >= at
        assert r["rejected_id"] == (r["pair_id"] ^ 1 if r["pair_id"] ^ 1 in plain else None)
        for side, ts in (("chosen", mine[n:]), ("rejected", swapped[n:])):
            assert [r[side][s["start"] : s["stop"]] for s in r[f"{side}_learnt"]] == [f"{x}<|im_end|>\n" for role, x in ts if role == "assistant"]
    assert "Python" not in preference_format.swapped_answers(pairs)._jdf.queryExecution().toString()


def test_registered_preferences_share_turns(spark):
    got = queries.op8_preference_format(spark, "/root/testdata/sf0.01")
    assert got.count() == 100 and got.where("n_common > 0 and prompt <> ''").count() > 90 and got.where("chosen_learnt <> ''").count() > 50
    assert "Python" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("seed", range(6))
def test_token_file_round_trip(seed):
    dice = np.random.default_rng(seed)
    lengths = dice.integers(0, 400, 30)
    ids = np.where(dice.random(lengths.sum()) < 0.03, dice.integers(0, 2**32, lengths.sum()), dice.integers(5, 5 + 2 ** dice.integers(0, 17), lengths.sum())).astype(np.uint32)
    doc_ids = [None if i == 0 else int(x) for i, x in enumerate(dice.integers(-(2**62), 2**62, 30))]
    f = token_blocks.TokenFile(token_blocks.encode_file(doc_ids, lengths, ids, block=int(dice.choice([2, 128, 1024])), percentile=int(dice.choice([50, 95, 100]))))
    assert f.doc_ids == doc_ids and f.lengths.tolist() == lengths.tolist() and (f.read(0, f.n_ids) == ids).all()
    for _ in range(20):
        a, b = sorted(dice.integers(0, len(ids) + 1, 2).tolist())
        assert (f.read(a, b) == ids[a:b]).all()
    empty = token_blocks.TokenFile(token_blocks.encode_file([], np.zeros(0, int), np.zeros(0, np.uint32)))
    assert empty.doc_ids == [] and len(empty.read(0, 10)) == 0
    with pytest.raises(ValueError):
        token_blocks.TokenFile(b"x" * 64)


def test_word_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole, fast = Tokenizer.from_file(path), token_blocks.WordEncoder(path)
    dice = random.Random(8)
    bits = ["don't", "It'S", "abc", "ÀÉ", "ß", "İ", "é", "Σας", "12", "x1", "<|endoftext|>", "a<|startoftext|>b", ".", "!!", "'s", " ", " ", "\u0085", "\x1c", "日本", "😀", "|", "_", "a.b", "ﬁ", "​", " ", "\t", "\r\n", "", "~|~", "é,", "'", "''ve"]
    texts = ["".join(dice.choice(bits) + dice.choice(["", "", " "]) for _ in range(dice.randrange(30))) for _ in range(400)] + [r[1] or "" for r in rows()]
    for at in range(0, len(texts), 50):
        for text, got in zip(texts[at : at + 50], fast(texts[at : at + 50]), strict=True):
            assert np.frombuffer(got, dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_long_texts_go_in_pieces(monkeypatch):
    monkeypatch.setattr(token_blocks, "PIECE", 40)
    monkeypatch.setattr(token_blocks, "LONG_WORD", 5)
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole, fast = Tokenizer.from_file(path), token_blocks.WordEncoder(path)
    for text in ("word " * 100, "a" * 300, "x" * 90 + "\t" + "Some words, and more. " * 20, " " * 100, "é" * 50 + " tail", ""):
        assert np.frombuffer(fast([text])[0], dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        file = json.load(f)
    assert token_blocks.words_apart(file)
    texts = ["Two  Words, and MORE.", "", "It's\tfine", "a b"]
    for n, change in enumerate(({"normalizer": None}, {"normalizer": {"type": "NFC"}}, {"added_tokens": [*file["added_tokens"], {**file["added_tokens"][0], "id": 49408, "content": "and", "special": False}]})):
        other = {**file, **change}
        assert not token_blocks.words_apart(other)
        path = tmp_path / f"t{n}.json"
        path.write_text(json.dumps(other))
        whole, mine = Tokenizer.from_file(str(path)), token_blocks.WordEncoder(str(path))
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in mine(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert token_blocks._arrow_uri("file:/a/b") == "file:///a/b" == token_blocks._arrow_uri("/a/b") and token_blocks._arrow_uri("s3a://x/y") == "s3://x/y" and token_blocks._arrow_uri("hdfs://n/a") == "hdfs://n/a"


def test_token_files(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    data = rows()
    got = token_blocks.token_digest(docs(spark), queries.tokenizer_path(), file_ids=500).collect()
    n = {}
    for d, t, *_ in data:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        n.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    seen, at = [], 0
    for r in sorted(got, key=lambda r: (r["start"], r["n_tokens"])):
        assert r["start"] == at
        at += r["n_tokens"]
        seen.append(r["doc_id"])
    assert seen == sorted((d for d, *_ in data), key=lambda d: (d is not None, d or 0)) and len({r["file"] for r in got}) > 3
    same_rows([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], [(d, *x) for d, xs in n.items() for x in xs])
    assert token_blocks.token_digest(docs(spark, []), queries.tokenizer_path()).count() == 0
