"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most d bits are cut into s = d // 2 + 1 segments, so that one segment
differs in at most one bit. Each fingerprint is indexed once for every segment and bit with that bit left out; two
fingerprints whose segment differs in at most one bit meet in such a variant. Meetings are verified over all 64 bits.
"""

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm import similar_sets
from codestrata.llm.common import cut_lineage, first_rows, shuffle_partitions, text_keys
from codestrata.llm.components import star_components

SEED = 42
#: Runs of up to this many members are compared pair by pair; larger ones yield the links of a spanning tree only.
SMALL = 16
#: Up to this many members are searched breadth first; beyond, neighbours are looked up by flipping the bits that vary.
DENSE = 4096
#: A run with more members is dealt anew by variants of the remaining bits.
LARGE = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text's word shingles as a signed 64-bit number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed 64-bit number."""
    ones, n = np.zeros(64, dtype=np.int64), len(hashes)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint_column(text: Column, width: int = 3) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return of(text)


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= distance


def spanning_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of distinct fingerprints under "differ in at most ``distance`` bits"."""
    out: list[tuple[int, int]] = []
    fps = np.unique(fps)
    left = np.ones(len(fps), dtype=bool)
    flips = None
    if len(fps) > DENSE:
        varying = int(np.bitwise_or.reduce((fps ^ fps[0]).view(np.uint64)))
        bits = [1 << i for i in range(64) if varying >> i & 1]
        flips = np.array([sum(c) for k in range(1, distance + 1) for c in combinations(bits, k)], dtype=np.uint64).view(np.int64)
        if len(flips) > len(fps):
            flips = None
    for seed in range(len(fps)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            i = queue.pop()
            if flips is None:
                rest = np.flatnonzero(left)
                found = rest[_near(fps[rest], fps[i : i + 1], distance)]
            else:
                there = fps[i] ^ flips
                at = np.minimum(np.searchsorted(fps, there), len(fps) - 1)
                found = at[fps[at] == there]
                found = found[left[found]]
            left[found] = False
            out += [(int(fps[i]), int(fps[j])) for j in found]
            queue += found.tolist()
    return out


def _small_links(key: np.ndarray, fp: np.ndarray, distance: int) -> list[np.ndarray]:
    """Linked pairs of short runs, all runs at once."""
    out = []
    for k in range(1, SMALL):
        same = np.flatnonzero(key[k:] == key[:-k]) if len(key) > k else []
        if not len(same):
            break
        a, b = fp[same], fp[same + k]
        near = _near(a, b, distance)
        out.append(np.stack([a[near], b[near]]))
    return out


def _meet(distance: int, large: int):
    def meet(batches):
        """Rows sorted by key. kind 0: a link (key, fp) of two fingerprints; kind 1: a row of a run to be dealt anew."""
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        dealing: int | None = None

        def table(links, again=()):
            rows = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in ([y[0] for y in links], [y[1] for y in links])]
            rows_again = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in ([y[0] for y in again], [y[1] for y in again])]
            kind = np.concatenate([np.zeros(len(rows[0]), dtype=np.int32), np.ones(len(rows_again[0]), dtype=np.int32)])
            return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(np.concatenate(x)) for x in zip(rows, rows_again, strict=True))], names=["kind", "a", "b"])

        def whole_runs(key, fp):
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            sizes = np.diff(cuts)
            short = np.repeat(sizes <= SMALL, sizes)
            links = _small_links(key[short], fp[short], distance)
            for lo, hi in zip(cuts[:-1][sizes > SMALL], cuts[1:][sizes > SMALL], strict=True):
                if tree := spanning_links(fp[lo:hi], distance):
                    links.append(np.array(tree, dtype=np.int64).T)
            return links

        for batch in batches:
            key, fp = (batch.column(c).to_numpy() for c in ("key", "fp"))
            again = []
            if not len(key):
                continue
            if dealing is not None:
                n = int(np.searchsorted(key != dealing, True))
                again.append((key[:n], fp[:n]))
                if n == len(key):
                    yield table([], again)
                    continue
                key, fp, dealing = key[n:], fp[n:], None
            if kept:
                key, fp = (np.concatenate([*[k[i] for k in kept], x]) for i, x in enumerate((key, fp)))
            last = len(key) - int(np.argmax(key[::-1] != key[-1])) if (key != key[-1]).any() else 0
            links = whole_runs(key[:last], fp[:last]) if last else []
            kept = [(key[last:], fp[last:])]
            if large and len(key) - last > large:
                again.append(kept[0])
                dealing, kept = int(key[-1]), []
            yield table(links, again)
        if kept:
            yield table(whole_runs(*kept[0]))

    return meet


def _variants(fps: DataFrame, width: int) -> DataFrame:
    """Adds i, each of the 64 bits, and ``value``, the segment of ``width`` bits around that bit without it."""
    at = f"cast(i div {width} as int) * {width}"
    value = F.expr(f"shiftrightunsigned(fp, {at}) & {(1 << width) - 1}L & ~shiftleft(1L, cast(i % {width} as int))")
    return fps.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("value", value)


def near_links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints (column ``fp``, distinct) within ``distance`` bits of each other.

    Small variants yield all their links, larger ones those of a spanning forest, which has the same components. Runs of more than
    ``LARGE`` members are dealt anew by variants of half the width. What then meets in a task shares, for up to three bits,
    31 bits of one segment and 15 of another; members are distinct, so they are at most 2**18 (2 MB), however many
    documents there are. For more bits segments are shorter, and only the data bound such a run.
    """
    if not 0 <= distance <= 31:
        raise ValueError("distance must be 0 to 31")
    segments = 1 << (max(2, distance // 2 + 1) - 1).bit_length()  # a power of two cuts 64 bits evenly
    width = 64 // segments
    parts = shuffle_partitions(fps.sparkSession)

    def links(keyed: DataFrame, large: int) -> DataFrame:
        return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_meet(distance, large), "kind int, a long, b long")

    key = F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("value"))
    met = cut_lineage(links(_variants(fps.select("fp"), width).select(key.alias("key"), "fp"), LARGE))
    # The members of a large run share a segment but for a bit; variants of the other segments, cut twice as finely, part them.
    large = _variants(met.where("kind = 1").select(F.col("a").alias("run"), F.col("b").alias("fp")), width // 2)
    other = F.expr(f"i div {width} <> shiftrightunsigned(run, 32) div {width}")
    again = links(large.where(other).select(F.xxhash64("run", "i", "value").alias("key"), "fp"), 0)
    return met.where("kind = 0").union(again.where("kind = 0")).select("a", "b").distinct()


def _named(digest: DataFrame, distance: int) -> DataFrame:
    """(fp_of, root_of, component_id) of each distinct fingerprint of the rows (id_of_row, fp)."""
    first = digest.groupBy("fp").agg(F.min("id_of_row").alias("first_id"))
    roots = star_components(near_links(first.select("fp"), distance))
    labelled = first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "root_of")
    return labelled.join(smallest, F.col("root") == F.col("root_of")).select(F.col("fp").alias("fp_of"), "root_of", "component_id")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, width: int = 3) -> DataFrame:
    """For each row: the id, ``fp`` (the fingerprint as a signed long), ``fingerprint`` (16 hexadecimal digits) and
    ``component_id``, the smallest id that links of at most ``distance`` differing bits reach, its own included.

    Only A-Z are lower-cased; words are runs without ASCII white space; shingles of ``width`` words count with repeats; a
    shorter text is one shingle. Null, empty and blank texts have fingerprint zero and link like others.
    Copies share a fingerprint, so the work on links is that of distinct fingerprints. Null ids link as others do and
    are never a component's id, unless it has no other (then null). Rows with one id keep a row each. Other columns are
    ignored. An empty table gives an empty result.
    """
    digest = cut_lineage(docs.select(F.col(id_col).alias("id_of_row"), fingerprint_column(F.col(text_col), width).alias("fp")))
    out = digest.join(_named(digest, distance), F.col("fp") == F.col("fp_of"))
    return out.select(F.col("id_of_row").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, width: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of ``docs`` from each component: that of the smallest id (null ids last, then by a hash of the text).

    Texts are linked by at most ``distance`` differing bits of their fingerprints or, with ``similarity``, by that Jaccard similarity
    of their sets of shingles. Such links are looked for among fingerprints as before, each held against the sets, and those that are too far apart
    in bits among minima (``similar_sets``): bits cannot tell a similarity of 0.8, at which they differ in 10 of 64 on
    average and in up to 39 for short texts, from others that differ in as many.
    Copies of a text are thinned out in the tasks that read them, before texts move.
    """
    if similarity is not None:
        return similar_sets.one_of_each(docs, id_col, text_col, similarity, width, majority, partial(near_links, distance=distance))
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = text_keys(text)
    digest = cut_lineage(docs.select(F.col(id_col).alias("id_of_row"), k1, k2, fingerprint_column(F.col(text_col), width).alias("fp")))
    place = F.struct(F.col("id_of_row").isNull().alias("no_id"), "id_of_row", "k1", "k2")
    texts = digest.groupBy("fp", "k1", "k2").agg(F.min(place).alias("place"))
    chosen = texts.join(_named(digest, distance), F.col("fp") == F.col("fp_of")).groupBy("root_of").agg(F.min("place").alias("place"))
    return first_rows(docs, chosen, id_col, text_col)
