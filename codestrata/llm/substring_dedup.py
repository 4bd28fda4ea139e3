"""Substring deduplication: Rabin-Karp hashes of fixed-length word windows, counted in Spark.

Texts are collapsed to distinct ones and dealt to groups of bounded size by a hash. Two rounds then count hashes
over all groups. A round sends each group's distinct hashes, packed in arrays and cut by hash range ("bins"), to
the bin, which answers with those that occur more than once:

1. Every window has a minimiser, the least hash of the ``GRAM``-word sequences inside it. Equal windows have
   equal minimisers, so a window whose minimiser occurs once in the corpus has count one and needs no row of its own.
   This loses nothing and leaves about a fourteenth of the hashes to send.
2. All windows with a repeated minimiser are counted by two Rabin-Karp hashes (128 bits) of their words.

Spark deals the arrays to bins and groups by their numbers, so that tasks are alike, and calls the counting of a bin, which is done
on its arrays in numpy: a row a hash would cost many times the bytes. Groups of texts are of ``GROUP_BYTES``; from about 0.4 TB on
they grow with the root of the corpus, to 140 MB at 100 TB, so that arrays keep ``LEAST_PACKED`` hashes.

Repeated windows merge into maximal removal intervals. No hash is sent more than once by a group, so a
passage that a third of all texts hold costs a bin one entry a group.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import shuffle_partitions, text_keys, total_bytes

WINDOW = 35
GRAM = 8
GROUP_BYTES = 8 << 20
BIN_HASHES = 2 << 20
#: Least mean number of hashes in a packed array, which bounds what packing adds at any size of the corpus.
LEAST_PACKED = 32

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240817))
_BYTES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_P, _Q1, _Q2, _G = (int(x) * 8 + 5 for x in _rng.integers(2**40, 2**60, 4))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LONG_WORD = 512


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.bases = base % 2**64, pow(base, -1, 2**64)
        self.tables = [np.ones(1, dtype=np.uint64)] * 2

    def __call__(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            self.tables = [np.cumprod(np.concatenate([[_U(1)], np.full(n + n // 4, _U(b))])) for b in self.bases]
        return [t[:n] for t in self.tables]


_POWERS = {base: _Powers(base) for base in (_P, _Q1, _Q2, _G)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a text in UTF-8."""
    space = np.concatenate([[True], _SPACE[np.frombuffer(data, dtype=np.uint8)], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    codes = _BYTES[np.frombuffer(data, dtype=np.uint8)]
    power, inverse = _POWERS[_P](len(codes) + 1)
    sums = np.concatenate([[_U(0)], np.cumsum(codes * power[:-1])])
    out = _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > _LONG_WORD):  # a polynomial modulo 2**64 is weak on long periodic words
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def rolling(tokens: np.ndarray, n: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of each n consecutive tokens."""
    if len(tokens) < n:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _POWERS[base](len(tokens) + 1)
    sums = np.concatenate([[_U(0)], np.cumsum(tokens * power[:-1])])
    return (sums[n:] - sums[:-n]) * inverse[: len(sums) - n]


def minimisers(tokens: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window the least mixed hash of the gram-token sequences in it, mixed again to spread over the bins."""
    if len(tokens) < window:
        return np.zeros(0, dtype=np.uint64)
    h = _mix(rolling(tokens, gram, _G))
    width, have = window - gram + 1, 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return _mix(np.minimum(h[: len(h) - (width - have)], h[width - have :]) if have < width else h)


class _Cutter:
    """Functions for Spark's workers; the parameters travel with them."""

    def __init__(self, window: int, bins: int):
        self.window, self.gram, self.bins = window, min(GRAM, window), bins

    def texts(self, group: pa.Table) -> dict[tuple[int, int], tuple[bytes, int]]:
        """Distinct texts of a group with their numbers of documents."""
        out: dict[tuple[int, int], tuple[bytes, int]] = {}
        for a, b, text, n in zip(*(group.column(c).to_pylist() for c in ("k1", "k2", "text", "n")), strict=True):
            old, m = out.get((a, b), (None, 0))
            out[a, b] = (text if old is None else old, m + n)
        return out

    def tokens(self, data: bytes) -> np.ndarray:
        return word_hashes(data, *words_of(data))

    def _packed(self, g: int, first: np.ndarray, second: np.ndarray, often: np.ndarray) -> pa.Table:
        """Distinct hashes by bin, in order, with a flag for those that the group itself has more than once."""
        order = np.lexsort((second, first))
        first, second, often = first[order], second[order], often[order]
        new = np.ones(len(first), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        at = np.flatnonzero(new)
        often = (np.diff(np.append(at, len(first))) > 1) | (np.maximum.reduceat(often, at) if len(at) else often[:0])
        first, second = first[at], second[at]
        bin_of = ((first >> _U(32)) * _U(self.bins)) >> _U(32)
        cuts = np.searchsorted(bin_of, np.arange(self.bins + 1, dtype=np.uint64))
        rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
        return pa.table(
            {
                "b": pa.array([b for b, _, _ in rows], pa.int32()),
                "g": pa.array([g] * len(rows), pa.int32()),
                "first": pa.array([first[lo:hi].tobytes() for _, lo, hi in rows], pa.binary()),
                "second": pa.array([second[lo:hi].tobytes() if second.any() else b"" for _, lo, hi in rows], pa.binary()),
                "often": pa.array([np.packbits(often[lo:hi]).tobytes() for _, lo, hi in rows], pa.binary()),
            }
        )

    def send_minimisers(self, key, group: pa.Table) -> pa.Table:
        every, often = [], []
        for data, n in self.texts(group).values():
            tokens = self.tokens(data)
            m = np.unique(minimisers(tokens, self.window, self.gram))
            if len(m):
                # Two equal windows of one text have their minimiser in two places of it.
                grams, counts = np.unique(_mix(_mix(rolling(tokens, self.gram, _G))), return_counts=True)
                every.append(m)
                often.append((counts[np.searchsorted(grams, m)] > 1) | (n > 1))
        h = np.concatenate(every) if every else np.zeros(0, dtype=np.uint64)
        return self._packed(key[0].as_py(), h, np.zeros_like(h), np.concatenate(often) if often else np.zeros(0, dtype=bool))

    def answer(self, key, group: pa.Table) -> pa.Table:
        """The hashes of each group that occur more than once in the bin."""
        first = [np.frombuffer(x, dtype=np.uint64) for x in group.column("first").to_pylist()]
        second = [np.frombuffer(x, dtype=np.uint64) if x else np.zeros(len(f), dtype=np.uint64) for x, f in zip(group.column("second").to_pylist(), first, strict=True)]
        often = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(f)).astype(bool) for x, f in zip(group.column("often").to_pylist(), first, strict=True)]
        a, b, o = np.concatenate(first), np.concatenate(second), np.concatenate(often)
        order = np.lexsort((b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        run = np.concatenate([[0], np.cumsum(~same)])
        many = np.bincount(run, weights=1.0 + o[order]) > 1
        hit = np.empty(len(a), dtype=bool)
        hit[order] = many[run]
        out, at = [], 0
        for g, f, s in zip(group.column("g").to_pylist(), first, second, strict=True):
            h = hit[at : at + len(f)]
            at += len(f)
            if h.any():
                out.append((g, f[h].tobytes(), s[h].tobytes() if s.any() else b""))
        return pa.table({"g": pa.array([x[0] for x in out], pa.int32()), "first": pa.array([x[1] for x in out], pa.binary()), "second": pa.array([x[2] for x in out], pa.binary())})

    @staticmethod
    def _answers(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        first = np.frombuffer(b"".join(group.column("first").to_pylist()), dtype=np.uint64)
        second = np.frombuffer(b"".join(group.column("second").to_pylist()), dtype=np.uint64)
        order = np.argsort(first, kind="stable")
        return first[order], second[order] if len(second) else second

    @staticmethod
    def _among(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(known):
            return np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return known[at] == h, at

    def send_windows(self, key, group: pa.Table, answers: pa.Table) -> pa.Table:
        known, _ = self._answers(answers)
        one, two, often = [], [], []
        for data, n in self.texts(group).values():
            tokens = self.tokens(data)
            keep, _ = self._among(minimisers(tokens, self.window, self.gram), known)
            if keep.any():
                one.append(rolling(tokens, self.window, _Q1)[keep])
                two.append(rolling(tokens, self.window, _Q2)[keep])
                often.append(np.full(len(one[-1]), n > 1))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
        # The first hash is mixed, since bins are cut by its upper bits.
        return self._packed(key[0].as_py(), _mix(join(one, np.uint64)), join(two, np.uint64), join(often, bool))

    def cut(self, key, group: pa.Table, answers: pa.Table) -> pa.Table:
        known, check = self._answers(answers)
        rows = []
        for (k1, k2), (data, _) in self.texts(group).items():
            start, end = words_of(data)
            gone = np.zeros(len(start), dtype=bool)
            intervals: list[tuple[int, int]] = []
            if len(start) >= self.window and len(known):
                tokens = word_hashes(data, start, end)
                hit, at = self._among(_mix(rolling(tokens, self.window, _Q1)), known)
                hit &= check[at] == rolling(tokens, self.window, _Q2)
                edge = np.zeros(len(start) + 1, dtype=np.int64)
                np.add.at(edge, np.flatnonzero(hit), 1)
                np.add.at(edge, np.flatnonzero(hit) + self.window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                intervals = list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))
            kept = b" ".join([data[s:e] for s, e in zip(start[~gone].tolist(), end[~gone].tolist(), strict=True)])
            rows.append((k1, k2, len(start), int(gone.sum()), kept, intervals))
        col = lambda i, kind: pa.array([r[i] for r in rows], kind)
        return pa.table(
            {
                "k1": col(0, pa.int64()),
                "k2": col(1, pa.int64()),
                "n_words": col(2, pa.int64()),
                "n_removed": col(3, pa.int64()),
                "kept": pa.array([r[4].decode() for r in rows], pa.string()),
                "intervals": pa.array([[{"start": a, "stop": b} for a, b in r[5]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            }
        )

    def digest(self, key, group: pa.Table, answers: pa.Table) -> pa.Table:
        full = self.cut(key, group, answers)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in full.column("kept").to_pylist()]
        return full.select(["k1", "k2", "n_words", "n_removed"]).append_column("kept_sha256", pa.array(sha, pa.string()))


def _first_of_each(batches):
    """Sends a text once a task; later ones of the task only raise its number."""
    more: dict[tuple, int] = {}
    names, kinds = ("g", "k1", "k2", "text", "n"), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    for batch in batches:
        rows = []
        for key, text in zip(zip(*(batch.column(c).to_pylist() for c in names[:3]), strict=True), batch.column("text").to_pylist(), strict=True):
            if key in more:
                more[key] += 1
            else:
                more[key] = 0
                rows.append((*key, text, 1))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names=names)
    rows = [(*key, None, n) for key, n in more.items() if n]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names=names)


def _results(docs: DataFrame, text_col: str, window: int, full: bool) -> DataFrame:
    spark = docs.sparkSession
    if window < 1:
        raise ValueError("window must be at least 1")
    size = total_bytes(docs, text_col)
    windows = max(1, size // 6)
    most = max(1, math.isqrt(windows // LEAST_PACKED))
    groups, bins = (max(1, min(math.ceil(x), most)) for x in (size / GROUP_BYTES, windows / BIN_HASHES))
    few = shuffle_partitions(spark)
    groups = max(groups, min(few * 2, most))
    bins = max(bins, min(few, most))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(*text_keys(text), F.encode(text, "UTF-8").alias("text"))
    keyed = keyed.select(F.pmod("k1", F.lit(groups)).cast("int").alias("g"), "k1", "k2", "text")
    parts = max(few, -(-groups // 4))
    texts = keyed.mapInArrow(_first_of_each, "g int, k1 long, k2 long, text binary, n long").repartitionById(parts, F.col("g"))
    cutter = _Cutter(window, bins)
    packed, answer = "b int, g int, first binary, second binary, often binary", "g int, first binary, second binary"
    bin_parts = max(few, -(-bins // 2))

    def answers(sent: DataFrame) -> DataFrame:
        return sent.repartitionById(bin_parts, F.col("b")).groupBy("b").applyInArrow(lambda key, group: cutter.answer(key, group), answer).repartitionById(parts, F.col("g"))

    def both(right: DataFrame, f, schema: str) -> DataFrame:
        return texts.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(lambda key, group, answered: f(key, group, answered), schema)

    first = answers(texts.groupBy("g").applyInArrow(lambda key, group: cutter.send_minimisers(key, group), packed))
    second = answers(both(first, cutter.send_windows, packed))
    if full:
        return both(second, cutter.cut, "k1 long, k2 long, n_words long, n_removed long, kept string, intervals array<struct<start: long, stop: long>>")
    return both(second, cutter.digest, "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """Removes every word that a window of ``window`` words covers whose words also start elsewhere in the corpus.

    Returns a row for each row of ``docs``: the id, n_words, n_removed and, with ``digest``, kept_sha256 (of the kept
    words joined by one space), else ``kept`` (that text) and ``intervals`` (maximal removed word ranges, [start, stop)).

    Words are maximal runs without ASCII white space, unchanged. Windows are judged on the input, so all copies of a
    repeated passage go. A null text counts as empty: no words, nothing removed. Texts of fewer than
    ``window`` words lose nothing, however often they occur. Ids may be null or repeated; each row keeps
    its own result. Other columns are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = docs.select(F.col(id_col).alias("id_of_row"), *text_keys(text))
    done = _results(docs, text_col, window, not digest)
    out = ids.join(done, ["k1", "k2"]).drop("k1", "k2")
    return out.withColumnRenamed("id_of_row", id_col)
