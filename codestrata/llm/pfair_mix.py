"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are cut into blocks, and a slot of the mixture takes one block. A source of share w has its k-th block
released at slot floor(k / w) and due before slot ceil((k + 1) / w); of the blocks released, the one with the earliest deadline
goes. On one processor this meets every deadline, so after any number t of slots each source has had more than t w - 1 and
fewer than t w + 1 blocks. Shares are exact fractions of the weights given; nothing is rounded to a period.

The schedule is dealt in stretches of slots, each by a task of its own. The driver finds only what each source has had at the
borders (``advanced``), in steps of a stretch. Why every stretch can then be dealt in time: with windows cut at the borders, a span
of slots is overfull only if too many blocks whose windows hold its border were put on its side. What fits is a whole number that is
no less than the sum of those blocks' fractions, the part of each that falls due by the border. Towards the past, ``advanced`` lets
no more blocks in than those sums rounded up. Towards the future, the earliest deadlines go first: of those up to any
time it takes at least the sum of their fractions, so of the later ones no more than theirs, rounded up, are ahead.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut_lineage, each_copy, gapless

BLOCK_DOCS = 16
TEMPERATURE = 0.7
MAX_SOURCES = 100_000
#: A source that would go more often than this is an error: it has too few documents for its weight.
MAX_EPOCHS = 100_000
#: Slots that one task deals, or ``PER_SOURCE`` for each source if that is more.
STRETCH, PER_SOURCE = 1 << 17, 64
#: Names of sources of up to this many characters together are broadcast.
NAME_CHARS = 8 << 20


def whole_weights(weights: dict[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in exactly the proportion of the weights."""
    if any(not math.isfinite(w) or w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    parts = {s: Fraction(w) for s, w in weights.items()}
    common = math.lcm(*(p.denominator for p in parts.values()))
    whole = {s: int(p * common) for s, p in parts.items()}
    least = math.gcd(*whole.values())
    return {s: w // least for s, w in whole.items()}


def advanced(whole: list[int], have: list[int], before: int, t: int) -> list[int]:
    """Blocks of each source in the first t slots, from those in the first ``before``: a border of the schedule and the next.

    A source has floor(t w) blocks or, where t w is no whole number, one more: the block whose window holds t. What is one
    ahead already stays so. The others go by earliest deadline, and of those released since ``before`` no more of the latest
    released than their fractions of t w add up to, rounded up.
    """
    total = sum(whole)
    out, asked, late = list(have), [], []
    for i, w in enumerate(whole):
        k, part = divmod(t * w, total)
        if part and have[i] > k:
            continue
        out[i] = k
        if part:
            release = k * total // w
            asked.append((-(-(k + 1) * total // w), i))
            if release >= before:
                late.append((-release, i, part))
    units, at = {}, 0
    for _, i, part in sorted(late):
        at += part
        units[i] = -(-at // total)
    # lower[u]: the highest unit up to u that is free; a source takes one that is not above its own.
    lower = list(range(-(-at // total) + 1))

    def free(u: int) -> int:
        while lower[u] != u:
            lower[u] = lower[lower[u]]
            u = lower[u]
        return u

    missing = t - sum(out)
    for _, i in sorted(asked):
        if not missing:
            break
        if i in units:
            if not (u := free(units[i])):
                continue
            lower[u] = u - 1
        out[i] += 1
        missing -= 1
    if missing:
        raise AssertionError("no rounding of the shares")
    return out


def borders(whole: list[int], length: int, horizon: int) -> Iterator[tuple[int, list[int], list[int] | None]]:
    """(number, blocks of each source before it, blocks by its end or None for the last) of each stretch."""
    have, n = [0] * len(whole), 0
    while (n + 1) * length < horizon:
        until = advanced(whole, have, n * length, (n + 1) * length)
        yield n, have, until
        have, n = until, n + 1
    yield n, have, None


def stretch(whole: list[int], start: int, stop: int, have: list[int], until: list[int] | None) -> Iterator[tuple[int, int]]:
    """(source, its block) of each slot from start to stop, given the blocks that each source has had and is to have had then."""
    total = sum(whole)
    waiting = [(max(start, k * total // w), i, k) for i, (k, w) in enumerate(zip(have, whole, strict=True)) if until is None or k < until[i]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    for t in range(start, stop):
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            due = -(-(k + 1) * total // whole[i])
            heapq.heappush(ready, (due if until is None else min(due, stop), i, k))
        due, i, k = heapq.heappop(ready)
        if t >= due:
            raise AssertionError("a block is late")
        yield i, k
        if until is None or k + 1 < until[i]:
            heapq.heappush(waiting, ((k + 1) * total // whole[i], i, k + 1))


def _ahead(whole: list[int], counts: list[int], t: int) -> bytes:
    """A bit for each source: whether it has had more than the whole part of its share of t."""
    total = sum(whole)
    return np.packbits([c > t * w // total for c, w in zip(counts, whole, strict=True)]).tobytes()


def _counts(whole: list[int], ahead: bytes, t: int) -> list[int]:
    total, bits = sum(whole), np.unpackbits(np.frombuffer(ahead, dtype=np.uint8), count=len(whole)).tolist()
    return [t * w // total + b for w, b in zip(whole, bits, strict=True)]


def _dealer(shared, horizon: int, length: int):
    kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, blocks = shared.value
        for n, have, until in (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("n", "have", "until")), strict=True)):
            start, stop = n * length, min(horizon, (n + 1) * length)
            slots = stretch(whole, start, stop, _counts(whole, have, start), None if until is None else _counts(whole, until, stop))
            for at in range(start, stop, 1 << 15):
                rows = [next(slots) for _ in range(at, min(stop, at + (1 << 15)))]
                cols = [i for i, _ in rows], [k // blocks[i] for i, k in rows], [k % blocks[i] for i, k in rows], list(range(at, at + len(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=["of", "epoch", "block_of", "slot"])

    return deal


def tempered(counts: dict[str | None, int], temperature: float = TEMPERATURE) -> dict[str | None, float]:
    """Weights in proportion to size ** temperature: small sources count for more than their share."""
    return {s: float(n) ** temperature for s, n in counts.items() if n}


def _source_counts(docs: DataFrame, source_col: str) -> dict[str | None, int]:
    rows = docs.groupBy(source_col).count().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    return {r[0]: r[1] for r in rows}


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, source_col: str = "source", order: tuple[str, ...] = ("doc_id", "text"), block_docs: int = BLOCK_DOCS, keep: tuple[str, ...] = ("doc_id",), length: int | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Deals blocks of all sources until every document has gone at least once, and so mixes to the weights throughout.

    Returns a row for each time a document goes: the ``keep`` columns, ``source``, ``epoch`` (how often it went
    before), ``block`` (of its source), ``slot`` (the block's place in the mixture, from 0 without gaps) and ``at``
    (the document's place in its block). A source with fewer blocks than its weight asks for starts again from its
    first; no document is dropped. Over any first t slots a source has less than one block more or less than its
    share of t. A source that ``weights`` does not name is an error, and so are more than ``MAX_SOURCES`` and weights
    that would make a source start more than ``max_epochs`` times. Without weights they are ``tempered``. ``length`` is the
    number of slots that a task deals (``STRETCH`` or more without it); any gives the same promise.

    Documents of a source go in the order of a hash of the ``order`` columns, which does not depend on how the input is cut.
    Null sources form a source, null texts and ids are values like others; rows equal in all columns are summed up
    before they move and go one after the other. The last block of a source may be short. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    rows = docs.select(F.col(source_col).alias("source"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)], F.xxhash64(*order).alias("by_1"), F.xxhash64(F.lit("second"), *order).alias("by_2"))
    kept = [f"kept_{i}" for i in range(len(keep))]
    rows = rows.groupBy("source", "by_1", "by_2", *kept).agg(F.count(F.lit(1)).alias("copies"))
    counts = _source_counts(docs, source_col)
    weights = weights or tempered(counts)
    if missing := [s for s in counts if s not in weights]:
        raise ValueError(f"no weight for {missing[:5]}")
    if not counts:
        names = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
        return spark.createDataFrame([], f"{names}, source string, epoch long, block long, slot long, at int")
    names = sorted(counts, key=lambda s: (s is None, s or ""))
    by_name = whole_weights({s: weights[s] for s in names})
    whole, blocks = [by_name[s] for s in names], [-(-counts[s] // block_docs) for s in names]
    total = sum(whole)
    horizon = max(-(-b * total // w) for b, w in zip(blocks, whole, strict=True))
    for s, b, w in zip(names, blocks, whole, strict=True):
        if (times := -(-horizon * w // (total * b))) > max_epochs:
            raise ValueError(f"source {s!r} would go {times} times: it has too few documents for its weight")
    length = length or max(STRETCH, PER_SOURCE * len(names))
    # A line of two bits a source for each stretch.
    stretches = [(n, _ahead(whole, have, n * length), until and _ahead(whole, until, (n + 1) * length)) for n, have, until in borders(whole, length, horizon)]
    lines = spark.createDataFrame(stretches, "n long, have binary, until binary").repartition(min(len(stretches), 100_000), "n")
    dealt = lines.mapInArrow(_dealer(spark.sparkContext.broadcast((whole, blocks)), horizon, length), "of int, epoch long, block_of long, slot long")
    # A line of four numbers a slot, kept so that the place of the last new block is found without dealing twice.
    dealt = cut_lineage(dealt)
    sources = spark.createDataFrame([(i, s, b) for i, (s, b) in enumerate(zip(names, blocks, strict=True))], "nth int, source_of string, blocks long")
    sources = F.broadcast(sources) if sum(len(s or "") for s in names) <= NAME_CHARS else sources
    new = dealt.where("epoch = 0").join(F.broadcast(sources.select("nth", "blocks")), (F.col("of") == F.col("nth")) & (F.col("block_of") == F.col("blocks") - 1))
    end = new.agg(F.max("slot")).first()[0]
    placed = gapless(rows, ["source"], ["by_1", "by_2", *kept], max(1024, sum(counts.values()) >> 18), "copies", ["by_1", "by_2"])
    placed = each_copy(placed, "copies", "nth_copy").withColumn("pos", F.col("pos") + F.col("nth_copy"))
    placed = placed.withColumn("block", F.expr(f"pos div {block_docs}")).withColumn("at", (F.col("pos") % block_docs).cast("int"))
    placed = placed.join(sources, F.col("source").eqNullSafe(F.col("source_of")))
    # Both sides are spread over the blocks of a source; a block that goes many times is split by Spark's skew handling.
    out = placed.join(dealt.where(F.col("slot") <= end), (F.col("nth") == F.col("of")) & (F.col("block") == F.col("block_of")))
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], "source", "epoch", "block", "slot", "at")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mixture has it and in its order, with the columns of ``docs``.

    The schedule is made for two hashes of each row; texts move once to be joined with it and once to their places.
    """
    if not docs.columns:
        raise ValueError("documents need columns")
    columns = list(docs.columns)
    of = [f"of_{i}" for i in range(len(columns))]
    rows = docs.withColumnsRenamed(dict(zip(columns, of, strict=True)))
    whole = [*of, *[F.col(c).isNull() for c in of]]
    rows = rows.withColumn("row_1", F.xxhash64(*whole)).withColumn("row_2", F.xxhash64(F.lit("second"), *whole))
    went = mix_sources(rows, **{"keep": ("row_1", "row_2"), **_renamed(columns, options)}).select(F.col("row_1").alias("r1"), F.col("row_2").alias("r2"), "slot", "at")
    placed = rows.dropDuplicates(["row_1", "row_2"]).join(went, (F.col("row_1") == F.col("r1")) & (F.col("row_2") == F.col("r2")))
    return placed.orderBy("slot", "at").select(*[F.col(x).alias(c) for x, c in zip(of, columns, strict=True)])


def _renamed(columns: list[str], options: dict) -> dict:
    name = {c: f"of_{i}" for i, c in enumerate(columns)}
    out = {"source_col": name[options.pop("source_col", "source")], "order": tuple(name[c] for c in options.pop("order", ("doc_id", "text")))}
    return out | options
