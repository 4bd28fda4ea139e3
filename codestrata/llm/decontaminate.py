"""Benchmark decontamination by the q-gram lemma.

A passage of n characters that matches a text with at most e edits shares at least n - q + 1 - q e of its q-grams with
it, on e + 1 neighbouring diagonals (text place less item place). Diagonals are cut into bands that overlap by e, so one
band holds them all. Texts pass three gates, each of which loses no match:

1. places of any benchmark q-gram, counted in every n + e characters of the text;
2. shared q-grams of one item in one band, counted over every n characters of the item;
3. banded alignment of the passage with the text, within e edits.

Where an item is so short that n - q + 1 - q e is not positive, its q is n // (e + 1) instead, with which it always is: of e + 1
pieces of that length, e edits leave one whole. Items of one q form an index; texts are looked up in each.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut_lineage

Q = 8
PASSAGE = 100
EDIT_RATE = 0.08
#: Characters of benchmark items that are searched for in one pass over the texts.
ITEM_CHARS = 8 << 20
#: Most characters of all items together; a larger benchmark is to be cut by the caller.
MOST_CHARS = 256 << 20
ITEM_COST = 64
#: Blocks of items that one pass over the texts of :func:`without_leaks` looks for.
PART_BLOCKS = 4
#: A sieve of 2**22 bits.
SIEVE_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q characters, by doubling."""
    if len(codes) < q:
        return np.zeros(0, dtype=np.uint64)
    base = np.array([_BASE])
    h = codes.astype(np.uint64)
    out, have, h_pow = None, 0, base
    width = 1
    while width <= q:
        if q & width:
            if out is None:
                out, have = h, width
            else:
                n = len(codes) - have - width + 1
                out, have = out[:n] * h_pow + h[have : have + n], have + width
        if width * 2 <= q:
            n = len(h) - width
            h = h[:n] * h_pow + h[width : width + n]
            h_pow = h_pow * h_pow
        width *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def banded_distance(passage: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> int | None:
    """Fewest edits that turn the passage into a substring of the text, on paths whose diagonal (text place less
    passage place) stays within low to high; None if more than ``most``."""
    width = high - low + 1
    far = most + 1
    places = np.arange(width)
    row = np.where((low + places >= 0) & (low + places <= len(text)), 0, far)
    for i, c in enumerate(passage, 1):
        at = i + low + places  # text characters taken so far
        inside = (at >= 0) & (at <= len(text))
        seen = np.where((at >= 1) & (at <= len(text)), text[np.clip(at - 1, 0, max(0, len(text) - 1))] if len(text) else 0, -1)
        new = row + (seen != c)
        new[at < 1] = far
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where(inside, new, far)
        # A text character more costs one: the running minimum of cost less place.
        new = np.minimum(np.minimum.accumulate(new - places) + places, far)
        row = np.where(inside, new, far)
        if row.min() > most:
            return None
    return int(row.min())


@dataclass(frozen=True)
class _Settings:
    q: int
    passage: int
    rate: float

    def of(self, length: int) -> tuple[int, tuple[int, int, int]]:
        """q, and passage length, edits and least shared q-grams, for an item of ``length``."""
        n = min(length, self.passage)
        e = int(self.rate * n)
        q = min(self.q, n // (e + 1))
        return q, (n, e, n - q + 1 - q * e)


class Index:
    """A bounded set of items by the q of their grams; items that are to occur as they are and shorter than q are looked for plainly."""

    def __init__(self, items: list[tuple[int | None, str]], settings: _Settings):
        self.ids = [i for i, _ in items]
        self.short: list[tuple[int, str]] = []
        by_q: dict[int, list[tuple[int, np.ndarray, tuple[int, int, int]]]] = {}
        for k, (_, text) in enumerate(items):
            if not text:
                continue
            q, s = settings.of(len(text))
            if s[1] == 0 and q < settings.q:
                self.short.append((k, text))
            else:
                by_q.setdefault(q, []).append((k, _codes(text), s))
        self.grams = [GramIndex(rows, q) for q, rows in sorted(by_q.items(), reverse=True)]

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, start in the text, stop, edits) of a passage of each item within its edits, those that share most q-grams first."""
        codes = _codes(text)
        for g in self.grams:
            yield from g.matches(codes)
        yield from ((k, at, at + len(t), 0) for k, t in self.short if (at := text.find(t)) >= 0)


class GramIndex:
    """q-grams of items: (number, characters, (passage length, edits, least shared q-grams))."""

    def __init__(self, items: list[tuple[int, np.ndarray, tuple[int, int, int]]], q: int):
        self.q = q
        found: dict[int, tuple[np.ndarray, tuple[int, int, int]]] = {}
        grams, item_of, place = [], [], []
        for k, codes, s in items:
            found[k] = codes, s
            g = _grams(codes, q)
            grams.append(g)
            item_of.append(np.full(len(g), k, dtype=np.int64))
            place.append(np.arange(len(g), dtype=np.int64))
        self.items = found
        g = np.concatenate(grams)
        order = np.argsort(g, kind="stable")
        self.grams, first = np.unique(g[order], return_index=True)
        self.first = np.append(first, len(g))
        self.item_of = np.concatenate(item_of)[order]
        self.place = np.concatenate(place)[order]
        self.sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
        self.sieve[(self.grams >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
        self.reach = max(n + e for _, (n, e, _) in found.values())
        self.least = min(t for _, (_, _, t) in found.values())

    def matches(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        g = _grams(codes, self.q)
        if not len(g):
            return
        hit = np.flatnonzero(self.sieve[(g >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.grams, g[hit]), len(self.grams) - 1)
        true = self.grams[at] == g[hit]
        hit, at = hit[true], at[true]
        if len(hit) < self.least:
            return
        # Gate 1: hits that some stretch of ``reach`` places shares with enough others.
        ahead = np.searchsorted(hit, hit + self.reach, side="left") - np.arange(len(hit)) >= self.least
        if not ahead.any():
            return
        edge = np.zeros(len(hit) + 1, dtype=np.int64)
        np.add.at(edge, np.flatnonzero(ahead), 1)
        np.add.at(edge, np.searchsorted(hit, hit[ahead] + self.reach, side="left"), -1)
        dense = np.cumsum(edge)[:-1] > 0
        hit, at = hit[dense], at[dense]
        counts = self.first[at + 1] - self.first[at]
        place_of = np.repeat(hit, counts)
        posting = np.repeat(self.first[at], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        item, place = self.item_of[posting], self.place[posting]
        order = np.argsort(item, kind="stable")
        cuts = np.flatnonzero(np.diff(item[order], prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            k, rows = int(item[order[lo]]), order[lo:hi]
            if len(rows) >= self.items[k][1][2] and (m := self._in_bands(k, codes, place_of[rows], place[rows])):
                yield (k, *m)

    def _in_bands(self, k: int, codes: np.ndarray, text_at: np.ndarray, item_at: np.ndarray) -> tuple[int, int, int] | None:
        passage, (n, e, least) = self.items[k]
        step = e + 1
        diagonal = text_at - item_at
        band = diagonal // step
        # A band is 2 e + 1 diagonals from band * step on: bands overlap by e.
        both = np.concatenate([band, band - 1])
        rows = np.concatenate([np.arange(len(band))] * 2)
        stays = np.concatenate([np.ones(len(band), dtype=bool), diagonal - (band - 1) * step <= 2 * e])
        both, rows = both[stays], rows[stays]
        order = np.argsort(both, kind="stable")
        cuts = np.flatnonzero(np.diff(both[order], prepend=both.min() - 1, append=both.max() + 1))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo < least:
                continue
            # Gate 2: starts of passages of n characters that hold enough different shared q-grams of this band.
            there = np.zeros(len(passage) + 1, dtype=np.int64)
            there[item_at[rows[order[lo:hi]]] + 1] = 1
            sums = np.cumsum(there)
            starts = np.arange(len(passage) - n + 1)
            shared = sums[starts + n - self.q + 1] - sums[starts]
            enough = starts[np.argsort(-shared, kind="stable")][: int((shared >= least).sum())]  # those that share most go first
            low = int(both[order[lo]]) * step
            for s in enough.tolist():
                first = max(0, s + low)
                text = codes[first : s + low + 2 * e + n + 1]
                edits = banded_distance(passage[s : s + n].astype(np.int64), text.astype(np.int64), s + low - first, s + low - first + 2 * e, e)
                if edits is not None:
                    return first, min(len(codes), first + len(text)), edits
        return None


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, chars: int, null_ids: bool = False, most: int | None = MOST_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """Items, normalised, in blocks of at most ``chars`` characters (or one item), those without an id on demand only. All
    blocks together have at most ``most`` characters, in which an item counts for its characters and ``ITEM_COST`` more; blank items,
    which never match, stay behind. Blocks come one after the other, so the driver holds those that its caller keeps.
    """
    block: list[tuple[int | None, str]] = []
    size = total = 0
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").rlike(r"\S"))
    for r in (items if null_ids else items.where("i is not null")).orderBy("i", "t").toLocalIterator():
        text = normalised(r["t"])
        if size and size + len(text) > chars:
            yield block
            block, size = [], 0
        block.append((r["i"], text))
        size, total = size + len(text), total + len(text) + ITEM_COST
        if most is not None and total > most:
            raise ValueError(f"benchmark items have more than {most} characters; pass them in parts")
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", q: int = Q, passage: int = PASSAGE, edit_rate: float = EDIT_RATE, item_chars: int = ITEM_CHARS) -> DataFrame:
    """(id, item_id, start, stop, edits) for each document and item of which it holds a passage.

    An item's passages are its stretches of ``passage`` characters (the whole item if it is shorter) after lower-casing
    and turning each run of white space into one space. A document holds one if at most ``edit_rate`` of its characters must
    be edited; start and stop bound the stretch of the normalised document that was aligned. Items of any length are searched
    with the edits that the rate gives them (none below 1 / rate characters); empty ones never match. Null texts count as empty, rows with a null item id take no part, null
    and repeated ids keep their rows. Each block of items is one pass over the texts, without a shuffle.
    An empty table on either side gives an empty result. Other columns are ignored.
    """
    if q < 1 or passage < q or not 0 <= edit_rate < 1:
        raise ValueError("passages are at least q characters, edit_rate is 0 to 1")
    spark = docs.sparkSession
    settings = _Settings(q, passage, edit_rate)
    rows = docs.select(F.col(id_col).cast("long").alias("id_of_row"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], "id_of_row long, item_id long, start long, stop long, edits int")
    for block in item_blocks(benchmark, item_col, text_col, item_chars):
        shared = spark.sparkContext.broadcast(block)
        out = out.union(rows.mapInArrow(_finder(shared, settings), "id_of_row long, item_id long, start long, stop long, edits int"))
    return out.withColumnRenamed("id_of_row", id_col)


def _finder(shared, settings: _Settings):
    def find(batches):
        index = None
        for batch in batches:
            index = index or Index(shared.value, settings)
            found = []
            for d, t in zip(batch.column("id_of_row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found += [(d, index.ids[k], a, b, e) for k, a, b, e in index.matches(normalised(t))]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kinds[i]) for i in range(5)], names=["id_of_row", "item_id", "start", "stop", "edits"])

    return find


def _parts(blocks: Iterable[list], most: int) -> Iterator[list[list]]:
    blocks = iter(blocks)
    while part := list(islice(blocks, most)):
        yield part


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", q: int = Q, passage: int = PASSAGE, edit_rate: float = EDIT_RATE, item_chars: int = ITEM_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no passage of any item, with or without an id; all columns stay as they are.

    A row is looked through for ``PART_BLOCKS`` blocks of items in one function, which ends at the first passage. A benchmark
    of more blocks takes a pass for each so many, with the rows that are left written to the checkpoint folder between them; the
    driver and a task hold the items of one pass, so the size of the benchmark has no bound.
    """
    settings = _Settings(q, passage, edit_rate)
    spark, passes = docs.sparkSession, 0
    for part in _parts(item_blocks(benchmark, item_col, text_col, item_chars, null_ids=True, most=None), PART_BLOCKS):
        if passes:
            docs = cut_lineage(docs)
        leaks = _flag(spark.sparkContext.broadcast(part), settings)(F.col(text_col))
        docs, passes = docs.where(~leaks), passes + 1
    return docs


def _flag(shared, settings: _Settings):
    @F.pandas_udf("boolean")
    def flag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        indexes = [Index(block, settings) for block in shared.value]
        for texts in batches:
            yield pd.Series([any(True for index in indexes for _ in index.matches(text)) for text in map(normalised, texts)], dtype=bool)

    return flag
