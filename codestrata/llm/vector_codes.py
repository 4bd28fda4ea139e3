"""Vector code compression: product codes whose codebooks are fitted by the filtering form of Lloyd's rounds.

Vectors of whole numbers are cut into parts, each with its own codebook. In a round every task builds, batch by batch, a
kd-tree over the parts of its vectors. A node holds the box around its points, their sum and their number. Codebook entries
go down the tree together: an entry that is further than another one from every point of a box leaves, and where one is left the whole
subtree is assigned by the node's sum and number, without a look at its points. What meets in Spark are one sum
and number for each part, entry and task. The tree is built anew each round: that takes less time than reading it back.

All arithmetic is exact: distances and sums of a task in 64 bits, which ``MAX_COMPONENT`` sees to, sums over tasks in decimals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut_lineage

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Points below which a node is not cut: they are compared with the entries that are left.
LEAF = 24
#: Larger whole numbers have no exact squared distances in 53 bits over parts of up to 512 numbers.
MAX_COMPONENT = 1 << 20


class Tree:
    """A kd-tree over integer points: nodes in order from the root, points of a node consecutive in ``order``."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []  # start, stop, left, right, lower corner, upper corner, sum
        if len(points):
            self._grow()

    def _grow(self) -> None:
        todo, points = [(0, len(self.points), -1, 0)], self.points
        while todo:
            start, stop, parent, side = todo.pop()
            mine = points[self.order[start:stop]]
            low, high = mine.min(axis=0), mine.max(axis=0)
            at = len(self.nodes)
            self.nodes.append([start, stop, -1, -1, low, high, mine.sum(axis=0)])
            if parent >= 0:
                self.nodes[parent][2 + side] = at
            wide = int((high - low).argmax())
            if stop - start > LEAF and high[wide] > low[wide]:
                middle = (stop - start) // 2
                cut = np.argpartition(mine[:, wide], middle)
                self.order[start:stop] = self.order[start:stop][cut]
                todo += [(start + middle, stop, at, 1), (start, start + middle, at, 0)]

    def assign(self, entries: np.ndarray, each: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Sums and numbers of the points of each entry, and with ``each`` the entry of every point: the nearest, ties to the lower index."""
        sums, counts = np.zeros(entries.shape, dtype=np.int64), np.zeros(len(entries), dtype=np.int64)
        of = np.zeros(len(self.points), dtype=np.int64) if each else None
        todo = [(0, np.arange(len(entries)))] if self.nodes else []
        while todo:
            at, alive = todo.pop()
            start, stop, left, right, low, high, total = self.nodes[at]
            if len(alive) > 1:
                alive = self._left(entries, alive, low, high)
            if len(alive) == 1:
                sums[alive[0]] += total
                counts[alive[0]] += stop - start
                if each:
                    of[self.order[start:stop]] = alive[0]
            elif left >= 0:
                todo += [(right, alive), (left, alive)]
            else:
                rows = self.order[start:stop]
                mine, near = self.points[rows], entries[alive].astype(np.float64)
                # |e|^2 - 2 p.e orders entries as distances do; all of it is whole numbers below 2^53
                chosen = alive[((near**2).sum(axis=1) - 2 * (mine.astype(np.float64) @ near.T)).argmin(axis=1)]
                np.add.at(sums, chosen, mine)
                counts += np.bincount(chosen, minlength=len(entries))
                if each:
                    of[rows] = chosen
        return sums, counts, of

    @staticmethod
    def _left(entries: np.ndarray, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Without entries that are nowhere in the box the nearest: the one next to its middle is nearer in all of it, or as near and first."""
        near = entries[alive]
        twice = 2 * near - (low + high)
        best = int((twice.astype(np.float64) ** 2).sum(axis=1).argmin())
        step = near - near[best]
        corner = np.where(step > 0, high, low)  # where in the box an entry does best against ``best``
        ahead = (((near - corner) ** 2) - ((near[best] - corner) ** 2)).sum(axis=1)
        gone = (ahead > 0) | ((ahead == 0) & (alive > alive[best]))
        gone[best] = False
        return alive[~gone]


def _whole_numbers(batches):
    """(vec_id, label, v binary) of the vectors that take part."""
    for batch in batches:
        lists = batch.column("v")
        values, at = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
        numbers = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        there, data = ~lists.is_null().to_numpy(zero_copy_only=False), []
        for i in range(batch.num_rows):
            x = np.floor(numbers[at[i] : at[i + 1]] * SCALE)
            there[i] &= bool(np.isfinite(numbers[at[i] : at[i + 1]]).all())
            if there[i] and np.abs(x).max(initial=0) > MAX_COMPONENT:
                raise ValueError(f"a component is beyond {MAX_COMPONENT / SCALE:g}, for which distances are not exact")
            data.append(x.astype(np.int32).tobytes() if there[i] else None)
        keep = pa.array(there)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(keep), batch.column("label").filter(keep), pa.array(data, pa.binary()).filter(keep)], names=["vec_id", "label", "v"])


def _parts(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """(parts, rows, numbers of a part)"""
    grid = np.frombuffer(b"".join(batch.column("v").to_pylist()), dtype=np.int32).astype(np.int64)
    return grid.reshape(batch.num_rows, parts, -1).transpose(1, 0, 2)


_SUMS = "part int, entry int, place int, total long, n long"


def _round(books: np.ndarray):
    def sums(batches):
        total, n = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                for p, points in enumerate(_parts(batch, len(books))):
                    s, c, _ = Tree(points).assign(books[p], each=False)
                    total[p] += s
                    n[p] += c
        part, entry = np.nonzero(n)
        width = books.shape[2]
        columns = np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), total[part, entry].ravel(), np.repeat(n[part, entry], width)
        kinds = pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "entry", "place", "total", "n"])

    return sums


def _codes(books: np.ndarray):
    def codes(batches):
        for batch in batches:
            n = batch.num_rows
            of, error = np.zeros((n, len(books)), dtype=np.uint8), np.zeros(n, dtype=np.int64)
            if n:
                for p, points in enumerate(_parts(batch, len(books))):
                    entry = Tree(points).assign(books[p], each=True)[2]
                    of[:, p] = entry
                    error += ((points - books[p][entry]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([x.tobytes().hex() for x in of], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return codes


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label as text, v) with floor(1024 x) of each component as packed 32-bit numbers; rows without a usable vector go."""
    d = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = d.schema["vec_id"].dataType.simpleString()
    return d.mapInArrow(_whole_numbers, f"vec_id {kind}, label string, v binary")


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, entries, numbers of a part): books that start as the parts of the vectors of smallest ids (ties: by their numbers) and then go
    through ``rounds`` rounds of assignment and of floor(sum / number); entries that nothing is assigned to stay."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    books = np.stack([np.frombuffer(r["v"], dtype=np.int32).astype(np.int64).reshape(parts, -1) for r in first], axis=1)
    for _ in range(rounds):
        # At most parts x entries x numbers of a part rows come back, however many vectors there are.
        sums = vectors.mapInArrow(_round(books), _SUMS).groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38, 0)")).alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for r in sums.collect():
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def digest_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """A row for each usable vector: the id, code (two hex digits a part), error (squared distance to its entries), label_error
    (errors summed over equal labels, null ones together), codebooks_sha256.

    Vectors that are null or hold null or non-finite components take no part; neither do empty ones. The rest must have one length, a
    multiple of ``parts``, and components of at most 1024: anything else is a ValueError. Repeated ids keep a row each and ties among
    the first ids go by the vectors' bytes. With fewer vectors than entries the books are smaller. Equal labels are those of equal
    text. Other columns are ignored; an empty table gives an empty result.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    whole = cut_lineage(whole_vectors(vectors, id_col, vector_col, label_col).where(F.octet_length("v") > 0))
    bounds = whole.agg(F.min(F.octet_length("v")), F.max(F.octet_length("v"))).first()
    if bounds[0] != bounds[1] or (bounds[0] or 0) % (4 * parts):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    books = fit_codebooks(whole, parts, entries, rounds)
    kind = whole.schema["vec_id"].dataType.simpleString()
    coded = cut_lineage(whole.mapInArrow(_codes(books), f"vec_id {kind}, label string, code string, error long"))
    # A checkpoint of its own, so that the join can split a label that many rows have.
    labels = cut_lineage(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    d = coded.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return d.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))
