"""Near-duplicates at a Jaccard similarity of word shingles, by deletion-variant signatures of MinHash minima.

The method is that of ``simhash_dedup`` with minima in place of bits: a signature is cut into ``SEGMENTS`` segments of ``ROWS`` minima,
each segment indexed once for every minimum with that one left out, and texts that share a variant meet. At a similarity of 0.8 a
segment differs in at most one minimum with probability 0.74, so a pair of that similarity meets in none with
probability 1.6e-6, and one of 0.85 with 1.5e-8. Few that meet are compared in pairs, many as groups whose texts come to one task.
Every link is verified on the sets of shingles.

Called by ``simhash_dedup``, the links among SimHash fingerprints of the same shingles come first: equal ones and those that deletion variants of
their bits bring together, verified on the sets, too. Minima that meet are then compared only if these links do not connect them already.

Groups that agree in their least or greatest member are one, where that sends no more texts. Groups of more than a tile, such as near copies of one text that a third of all documents are, are first thinned out around
a text of theirs, the pivot: all members are compared with it, and those similar to it are linked and need no
comparison with each other. One minus the Jaccard similarity is a metric, so of these only members
whose similarity to the pivot is at most 1 - ``similarity`` above that of some member not linked can still be similar to one
that is not; only they and those not linked go to the next round, which has another pivot. A round is linear in
the members. A group that a round does not thin out by a quarter (many texts around a common one, few of them similar to each
other) is compared in cells of two tiles: exactly, but each text goes to as many cells as the group has tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import arrow_rows, cut_lineage, first_rows, shuffle_partitions, text_keys
from codestrata.llm.components import star_components

SIMILARITY = 0.8
WIDTH = 5
SEED = 42
SEGMENTS, ROWS = 10, 5
#: Variants shared by up to this many texts give pairs; the texts of larger ones are compared together.
SMALL = 16
#: Texts and shingles of a tile; two tiles are compared in one task.
TILE, TILE_SHINGLES = 1024, 2 << 20
#: Texts, or pairs of texts, of a batch for Python.
BATCH = 512
#: Rounds, at most, in which groups of more than a tile are thinned out, and the part that a round may leave for another to follow.
ROUNDS, MOST_KEPT = 12, 0.75

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, SEGMENTS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(words[i : i + width]), SEED) for i in range(n)], dtype=np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending."""
    return np.unique(shingle_hashes(text, width))


def variants(hashes: np.ndarray) -> np.ndarray:
    """A key for each minimum of a set's signature: its segment without that minimum."""
    mixed = hashes ^ (hashes >> np.uint64(32))
    least = np.full(SEGMENTS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(mixed), 1024):
        least = np.minimum(least, (mixed[at : at + 1024, None] * _FACTORS).min(axis=0))
    rest = [np.delete(least[i - i % ROWS : i - i % ROWS + ROWS], i % ROWS).tobytes() for i in range(SEGMENTS * ROWS)]
    return np.array([xxhash.xxh64_intdigest(r, i) for i, r in enumerate(rest)], dtype=np.uint64).view(np.int64)


def _sketch(width: int, fingerprint: Callable[[np.ndarray], int] | None):
    @F.pandas_udf("node long, n int, variants array<long>, fp long")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []  # no more than one text's hashes at a time
        for t in texts:
            hashes = shingle_hashes(t, width)
            s = np.unique(hashes)
            rows.append((xxhash.xxh64_intdigest(s.tobytes(), SEED), len(s), variants(s), fingerprint(hashes) if fingerprint else 0))
        nodes, n, keys, fps = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pd.DataFrame({"node": np.array(nodes, dtype=np.uint64).view(np.int64), "n": np.array(n, dtype=np.int32), "variants": list(keys), "fp": np.array(fps, dtype=np.int64)})

    return of


def _with_texts(df: DataFrame) -> DataFrame:
    """A checkpoint of what functions of texts give: ``BATCH`` texts go to Python at once, since a batch of Spark's 10,000 is held by both sides."""
    with arrow_rows(df.sparkSession, BATCH):
        return cut_lineage(df)


def _likeness(width: int):
    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        """Jaccard similarities; the second text of a row is often that of the row before."""
        out, last, t = [], None, None
        for x, y in zip(a, b, strict=True):
            if t is None or y != last:
                last, t = y, shingles(y, width)
            s = shingles(x, width)
            shared = len(np.intersect1d(s, t, assume_unique=True))
            out.append(shared / (len(s) + len(t) - shared))
        return pd.Series(out, dtype=float)

    return of


def _meet(similarity: float):
    def pairs(key: np.ndarray, node: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        out = []
        for k in range(1, SMALL):
            same = np.flatnonzero(key[k:] == key[:-k]) if len(key) > k else []
            if not len(same):
                break
            same = same[np.minimum(n[same], n[same + k]) >= similarity * np.maximum(n[same], n[same + k]) - 1e-6]
            a, b = node[same], node[same + k]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        return out

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key. kind 0: a pair (a, b) to compare; kind 1: the key, node and size of a member of a larger run."""
        kept = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int32)]
        large = None

        def table(key, node, n):
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            sizes = np.diff(cuts)
            many = np.repeat(sizes > SMALL, sizes) if len(key) else np.zeros(0, dtype=bool)
            if large is not None:
                many |= key == large
            few = pairs(key[~many], node[~many], n[~many])
            few = np.concatenate(few, axis=1) if few else np.zeros((2, 0), dtype=np.int64)
            kind = np.concatenate([np.zeros(few.shape[1], dtype=np.int32), np.ones(int(many.sum()), dtype=np.int32)])
            size = np.concatenate([np.zeros(few.shape[1], dtype=np.int32), n[many]])
            return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(np.concatenate(x)) for x in ([few[0], key[many]], [few[1], node[many]])), pa.array(size)], names=["kind", "a", "b", "n"])

        for batch in batches:
            key, node, n = (np.concatenate([k, batch.column(c).to_numpy()]) for k, c in zip(kept, ("key", "node", "n"), strict=True))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if len(key) - last > SMALL or large == key[-1]:
                yield table(key, node, n)
                large, last = int(key[-1]), len(key)
            else:
                yield table(key[:last], node[:last], n[:last])
            kept = [key[last:], node[last:], n[last:]]
        yield table(*kept)

    return meet


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets under "Jaccard similarity of at least ``similarity``"."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    posted, count = owner[order], np.bincount(column)
    starts, ends = np.cumsum(count) - count, np.cumsum(sizes)
    left, out = np.ones(len(sets), dtype=bool), []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed], queue = False, [seed]
        while queue:
            i = queue.pop()
            columns = column[ends[i] - sizes[i] : ends[i]]
            many = count[columns]
            at = np.arange(many.sum()) + np.repeat(starts[columns] - (np.cumsum(many) - many), many)
            shared = np.bincount(posted[at], minlength=len(sets))
            found = np.flatnonzero(left & (shared / (sizes + sizes[i] - shared) >= similarity))
            left[found] = False
            out += [(i, int(j)) for j in found]
            queue += found.tolist()
    return out


def _compare(similarity: float, width: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell: links of each cell."""
        cell, nodes, sets = None, [], []

        def links():
            found = [(nodes[i], nodes[j]) for i, j in forest(sets, similarity)] if sets else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for *at, node, text in zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi", "node", "text")), strict=True):
                if at != cell:
                    yield links()
                    cell, nodes, sets = at, [], []
                nodes.append(node)
                sets.append(shingles(text, width))
        yield links()

    return compare


def _tiles() -> Column:
    """The tiles of a group of rows (node, n)."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")


def _bundled(runs: DataFrame, shared: Callable[[str], Column]) -> DataFrame:
    """Runs (key, node, n) that agree in one member, which ``shared`` picks (the least or the greatest), become one run, if that sends no more texts
    than the runs by themselves. Near copies of one text meet in many variants, in runs of nearly the same members."""
    own = runs.groupBy("key").agg(shared("node").alias("one"), (F.count(F.lit(1)) * _tiles()).alias("sent"))
    placed = runs.join(own.select("key", "one"), "key")
    members = placed.groupBy("one", "node").agg(F.min("n").alias("n"))
    together = members.groupBy("one").agg((F.count(F.lit(1)) * _tiles()).alias("together"))
    better = together.join(own.groupBy("one").agg(F.sum("sent").alias("apart")), "one").where("together <= apart").select("one")
    left = placed.join(better, "one", "left_anti").select("key", "node", "n")
    return cut_lineage(members.join(better, "one").select(F.col("one").alias("key"), "node", "n").union(left))


def _sized(runs: DataFrame) -> DataFrame:
    """Adds to each run (key, node, n, was) its members' number, its tiles and its pivot."""
    shares = runs.groupBy("key").agg(F.count(F.lit(1)).alias("members"), _tiles().alias("tiles"), F.min("node").alias("pivot"))
    return runs.join(shares, "key").withColumn("tile", F.expr("cast(pmod(xxhash64(node), tiles) as int)"))


def _thinned(runs: DataFrame, texts: DataFrame, similarity: float, width: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links to pivots, and the runs, with their tiles, whose members are still to be compared with each other."""
    links, left = [], []
    sized = cut_lineage(_sized(runs.withColumn("was", F.lit(None).cast("long"))))
    for _ in range(ROUNDS):
        goes_on = (F.col("tiles") > 1) & F.coalesce(F.col("members") <= F.col("was") * MOST_KEPT, F.lit(True))
        hot = sized.where(goes_on)
        if hot.isEmpty():
            break
        left.append(sized.where(~goes_on))
        # The pivot's text goes to each tile of its run, so that no task gets a whole run.
        pivots = hot.where("node = pivot").join(texts, "node").select("key", F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"), F.col("text").alias("pivot_text"))
        like = _likeness(width)(F.col("text"), F.col("pivot_text"))
        seen = _with_texts(hot.join(texts, "node").join(pivots, ["key", "tile"]).select("key", "node", "n", "pivot", "members", like.alias("like")))
        links.append(seen.where((F.col("like") >= similarity) & (F.col("node") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        most = seen.where(F.col("like") < similarity).groupBy("key").agg(F.max("like").alias("most"))
        rest = seen.join(most, "key").where((F.col("like") <= F.col("most") + (1 - similarity + 1e-9)) & (F.col("node") != F.col("pivot")))
        sized = cut_lineage(_sized(rest.select("key", "node", "n", F.col("members").alias("was"))))
    return links, [*left, sized]


def _near(nodes: DataFrame, near_links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of nodes that bits bring together: those of one fingerprint in a chain, and the first ones of linked fingerprints."""
    fps = nodes.select("node", F.col("place.fp").alias("fp"))
    first = cut_lineage(fps.groupBy("fp").agg(F.min("node").alias("node")))
    chain = fps.select("node", F.lag("node").over(Window.partitionBy("fp").orderBy("node")).alias("last")).where("last is not null").select(F.col("last").alias("a"), F.col("node").alias("b"))
    one, two = first.select(F.col("fp").alias("a"), F.col("node").alias("node_a")), first.select(F.col("fp").alias("b"), F.col("node").alias("node_b"))
    linked = near_links(first.select("fp")).join(one, "a").join(two, "b").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    return cut_lineage(chain.union(linked))


def _links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, similarity: float, width: int, near_links: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links (a, b) that connect exactly the nodes whose sets are similar."""
    parts = shuffle_partitions(docs.sparkSession)
    keyed = nodes.select(F.explode("place.variants").alias("key"), "node", F.col("place.n").alias("n"))
    met = cut_lineage(keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_meet(similarity), "kind int, a long, b long, n int").distinct())
    pairs, runs = met.where("kind = 0").select("a", "b"), met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"), "n")
    runs = _bundled(_bundled(runs, F.min), F.max)
    near = None if near_links is None else _near(nodes, near_links)
    compared = pairs if near is None else pairs.union(near)
    asked = compared.select(F.col("a").alias("node")).union(compared.select("b")).union(runs.select("node")).distinct()
    asked = asked.join(nodes, "node").select("node", F.col("place.id_of_row").alias("i"), F.col("place.k1").alias("c1"), F.col("place.k2").alias("c2"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = text_keys(text)
    rows = docs.select(F.col(id_col).alias("id_of_row"), k1, k2, text.alias("text"))
    same = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & F.col("id_of_row").eqNullSafe(F.col("i"))
    texts = cut_lineage(rows.join(asked, same).select("node", "text").dropDuplicates(["node"]))
    one, two = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def alike(pairs: DataFrame) -> DataFrame:
        return pairs.join(one, "a").join(two, "b").where(_likeness(width)(F.col("text_a"), F.col("text_b")) >= similarity).select("a", "b")

    found = []
    if near is not None:
        roots = star_components(_with_texts(alike(near)))
        found.append(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        known = [roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b")]
        apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
        pairs = pairs.join(known[0], "a", "left").join(known[1], "b", "left").where(apart).select("a", "b")
    linked, left = _thinned(runs, texts, similarity, width)
    cells = reduce(DataFrame.union, left).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    # Every pair of one tile is in the cells of that tile with another, too.
    cells = cells.where("tiles = 1 or tile <> other").select("key", "node", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
    cells = cells.join(texts, "node").select("key", "lo", "hi", "node", "text").repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    met = _with_texts(alike(pairs).union(cells.mapInArrow(_compare(similarity, width), "a long, b long")))
    return reduce(DataFrame.union, [*found, *linked], met)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WIDTH, fingerprint: Callable[[np.ndarray], int] | None = None, near_links: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row of ``docs`` from each component of texts linked by a similarity of at least ``similarity``: that of the
    smallest id (null ids last, then by a hash of the text).

    The similarity is that of the sets of shingles of ``width`` words; only A-Z are lower-cased, words are runs without
    ASCII white space, a shorter text is one shingle; null, empty and blank texts are alike. Texts of one set are one node.
    ``fingerprint`` makes bits of a text's hashes, and ``near_links`` links such fingerprints (column ``fp``); what they link is compared first.
    """
    k1, k2 = text_keys(F.coalesce(F.col(text_col), F.lit("")))
    digest = docs.select(F.col(id_col).alias("id_of_row"), k1, k2, _sketch(width, fingerprint)(F.col(text_col)).alias("s"))
    place = F.struct(F.col("id_of_row").isNull().alias("no_id"), "id_of_row", "k1", "k2", F.col("s.n").alias("n"), F.col("s.variants").alias("variants"), F.col("s.fp").alias("fp"))
    nodes = _with_texts(digest.groupBy(F.col("s.node").alias("node")).agg(F.min(place).alias("place")))
    roots = star_components(_links(docs, nodes, id_col, text_col, similarity, width, near_links)).select(F.col("node").alias("linked"), "root")
    placed = nodes.select("node", F.struct("place.no_id", "place.id_of_row", "place.k1", "place.k2").alias("place"))
    chosen = placed.join(roots, F.col("node") == F.col("linked"), "left").groupBy(F.coalesce("root", "node").alias("root_of")).agg(F.min("place").alias("place"))
    return first_rows(docs, chosen, id_col, text_col)
