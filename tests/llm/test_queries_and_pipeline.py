import collections
import math
import struct
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from helpers import docs
from oracle import SF, connection, same

import corpus_pipeline
from codestrata.llm import pfair_mix, quality_rules, queries, shard_tree
from test_dedup import jaccard_roots
from test_search_and_layout import earliest_deadlines


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert same(queries.QUERIES[name](spark, SF), connection(), queries.ORACLE_SQL[name]) > 0


def test_each_query_gives_rows(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    for name, f in queries.QUERIES.items():
        if name not in queries.ORACLE_SQL:
            assert f(spark, SF).count() > 0, name


def spark_hash(*values):
    """Spark's xxhash64 of texts and whole numbers, unsigned; nulls change nothing."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def mixture(data):
    """The documents in the order of the mixture: by the definition of the schedule, until the last has gone."""
    sources = collections.defaultdict(list)
    for r in data:
        by = signed(spark_hash(r["doc_id"], r["text"])), signed(spark_hash("second", r["doc_id"], r["text"]))
        sources[r["source"]].append((signed(spark_hash(*by)) % 1024, *by, r["doc_id"]))
    blocks = {}
    for s in sorted(sources, key=lambda s: (s is None, s or "")):
        ids = [x[-1] for x in sorted(sources[s])]
        blocks[s] = [ids[i : i + 16] for i in range(0, len(ids), 16)]
    weights = {s: Fraction(float(len(sources[s])) ** 0.7) for s in blocks}
    horizon = max(math.ceil(len(b) * sum(weights.values()) / weights[s]) for s, b in blocks.items())
    order, went, out, new = earliest_deadlines(weights, horizon), collections.Counter(), [], 0
    for s in order:
        out.append(blocks[s][went[s] % len(blocks[s])])
        went[s] += 1
        new = len(out) if went[s] <= len(blocks[s]) else new
    return [d for b in out[:new] for d in b]


def shard(doc_id, node):
    while node.children:
        draws = [(-math.log(((spark_hash(c.name, doc_id) >> 11) + 0.5) / 2**53) / c.mass, i) for i, c in enumerate(node.children)]
        node = node.children[min(draws)[1]] if len(draws) > 1 else node.children[0]
    return node.shard


def test_pipeline_against_brute_force(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    data = sorted((r.asDict() for r in source.collect()), key=lambda r: r["doc_id"])
    model = quality_rules.fit_quality(source, spark.read.parquet(f"{SF}/labels.parquet"))
    data = [r for r in data if model.scores(np.array([quality_rules.statistics(r["text"])]))[0] >= quality_rules.THRESHOLD]
    kept = set(jaccard_roots([r["text"] for r in data]))
    data = [r for i, r in enumerate(data) if i in kept]
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    # The planted passages are whole items; a piece of each decides.
    clean = [r for r in data if not any(item[20:100] in " ".join(r["text"].lower().split()) for item in items)]
    assert 0 < len(clean) < len(data)
    tree, want = shard_tree.hash_tree(16), mixture(clean)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*source.columns, "shard"]
    assert collections.Counter((r["doc_id"], r["shard"]) for r in got.collect()) == collections.Counter((d, shard(d, tree)) for d in want)
    assert set(want) == {r["doc_id"] for r in clean}


def test_stages_take_odd_tables(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixture", "shards"]
    for table in (docs(spark), docs(spark, [])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            assert out.columns[: len(table.columns)] == table.columns or name == "shards"
            out.count()


def test_near_duplicates_of_the_table_against_all_pairs(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    data = sorted((r["doc_id"], r["text"]) for r in source.collect())
    want = {data[i][0] for i in jaccard_roots([t for _, t in data])}
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, source, SF).collect()) == sorted(want)


def test_mixture_is_written_in_its_order(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    want = mixture([r.asDict() for r in source.collect()])
    assert want == [r["doc_id"] for r in sorted(pfair_mix.mix_sources(source).collect(), key=lambda r: (r["slot"], r["at"]))]
    corpus_pipeline.mixture(spark, source, SF).write.parquet(str(tmp_path / "m"))
    files = sorted((tmp_path / "m").glob("*.parquet"))
    assert [d for f in files for d in pq.read_table(f, columns=["doc_id"]).column(0).to_pylist()] == want
