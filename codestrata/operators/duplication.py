"""Clones: stretches of at least ``TOKENS`` equal tokens on at least ``LINES`` lines, within a repository.

Each file is cut into tokens once; tokens and their lines are kept in the shared folder while they are needed, compressed (a few bytes a token), with the file's minimisers. A window of tokens is looked at only if the
least hash of the short sequences in it, its minimiser, is chosen at two places of the repository. Equal windows choose equal sequences
at different places, so none is lost, and about one hash in twenty moves. Windows that are left are counted by 128 bits
of their tokens; those that a repository has more than once go back to their files, where they are merged if they overlap or touch.
Files of one repository with equal tokens on equal lines are looked at once and count as often as there are of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.exprs import count_lines, pct1, zero
from codestrata.sources.scratch import cut_lineage, passing

TOKENS = 50
LINES = 5
#: Tokens of the sequences among which a window has its minimiser.
GRAM = 8
#: Bytes of a batch that tasks send on.
SENT_BYTES = 4 << 20
#: A lexeme: a comment, white space, or (group 1) a token.
_LEXEME = re.compile(r"//[^\n]*|/\*.*?\*/|\s+|([\w$]+|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|.)", re.DOTALL)
#: The same without a group, for all lexemes of a file at once.
_LEXEMES = re.compile(_LEXEME.pattern.replace("([\\w$]", "(?:[\\w$]"), re.DOTALL)
#: An odd base for each half of the 128 bits.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_HALVES = np.dtype([("high", "<u8"), ("low", "<u8")])


def lexed(content: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Text, first line and last line of each token; comments and blanks are no tokens."""
    pieces = _LEXEMES.findall(content)
    is_token = {p: not (p.isspace() or p.startswith(("//", "/*"))) for p in set(pieces)}
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    token = np.fromiter(map(is_token.__getitem__, pieces), bool, len(pieces))
    breaks = np.array([m.start() for m in re.finditer("\n", content)], dtype=np.int64)
    lines = np.searchsorted(breaks, np.concatenate([[0], ends])).astype(np.int32)
    return list(compress(pieces, token)), lines[:-1][token], lines[1:][token]


def packed(texts: list[str], first: np.ndarray, last: np.ndarray) -> tuple[bytes, bytes]:
    """The tokens' characters, and their lengths, steps of lines and lines more than one; both compressed."""
    shape = np.stack([np.fromiter(map(len, texts), np.int32, len(texts)), np.diff(first, prepend=np.int32(0)), last - first])
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return squeeze("".join(texts).encode()), squeeze(shape.astype("<i4").tobytes())


def unpacked(text: bytes, shape: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    open_ = zstandard.ZstdDecompressor().decompress
    size, step, more = np.frombuffer(open_(shape), dtype="<i4").reshape(3, -1)
    whole, ends, first = open_(text).decode(), np.cumsum(size, dtype=np.int64).tolist(), np.cumsum(step, dtype=np.int32)
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else [], first, first + more


def digests(texts: list[str], seed: int = 0) -> np.ndarray:
    """128 bits of each token, as two columns of 64."""
    known = {t: xxhash.xxh3_128_digest(t, seed) for t in set(texts)}
    return np.frombuffer(b"".join([known[t] for t in texts]), dtype="<u8").reshape(-1, 2)


def rolling(tokens: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of each ``size`` consecutive tokens: Rabin-Karp by prefix sums, since an odd base has an inverse modulo 2**64."""
    n = len(tokens) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(tokens), base, dtype=np.uint64)]))
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, pow(base, -1, 2**64), dtype=np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens * power[:-1])])
    h = (sums[size:] - sums[:-size]) * inverse
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def identities(tokens: np.ndarray, size: int) -> np.ndarray:
    """The 128 bits of each window."""
    halves = [rolling(np.ascontiguousarray(tokens[:, i]), size, base) for i, base in enumerate(_BASES)]
    out = np.empty(len(halves[0]), dtype=_HALVES)
    out["high"], out["low"] = halves
    return out


def minimisers(tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the sequences of ``GRAM`` tokens (fewer, in shorter windows), and where each window has the first of its least ones."""
    grams = rolling(np.ascontiguousarray(tokens[:, 0]), min(GRAM, size), _BASES[0])
    width = size - min(GRAM, size) + 1
    if len(grams) < width:
        return grams, np.zeros(0, dtype=np.int64)
    at = np.lib.stride_tricks.sliding_window_view(grams, width)
    # Slices, since argmin makes a copy of what it is given.
    least = [at[i : i + 65536].argmin(axis=1) + np.arange(i, min(i + 65536, len(at))) for i in range(0, len(at), 65536)]
    return grams, np.concatenate(least)


def _repo_seed(repo: str | None) -> int:
    return xxhash.xxh64_intdigest(repo or "", 1)


def _by_row(columns: tuple[str, ...], schema: pa.Schema, rows: Callable[..., list]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that puts out the columns which ``rows`` gives for each row, in batches of about ``SENT_BYTES`` or of one large file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in columns), strict=True):
                ready.append(pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows(*(x.as_py() for x in row)), schema.types, strict=True)], schema=schema))
                size += ready[-1].nbytes
                if size >= SENT_BYTES:
                    yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                    ready, size = [], 0
        yield from pa.Table.from_batches(ready, schema).combine_chunks().to_batches()

    return run


def _lex(repo: str | None, content: str, total: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    return lexed(content)


def _kept(size: int, lex: Callable[..., tuple]) -> Callable[..., list]:
    def rows(repo: str | None, content: str, total: int) -> list:
        texts, first, last = lex(repo, content, total)
        grams, least = minimisers(digests(texts, _repo_seed(repo)), size)
        h, n = np.unique(grams[np.unique(least)], return_counts=True)
        text, shape = packed(texts, first, last)
        alike = xxhash.xxh3_128(text)
        alike.update(shape)
        return [[repo], [total], [text], [shape], [alike.digest()], [h.view(np.int64)], [n]]

    return rows


def _counted(size: int) -> Callable[..., list]:
    """The identities of the windows whose minimisers are repeated, and how often the file has each."""

    def rows(node: int, repo: str | None, text: bytes, shape: bytes, repeated: list[int]) -> list:
        tokens = digests(unpacked(text, shape)[0], _repo_seed(repo))
        grams, least = minimisers(tokens, size)
        hit = np.isin(grams.view(np.int64), np.array(repeated, dtype=np.int64))[least]
        ids, n = np.unique(identities(tokens, size)[hit], return_counts=True)
        return [[node], [ids["high"].view(np.int64)], [ids["low"].view(np.int64)], [n]]

    return rows


def _stretches(size: int, lines: int) -> Callable[..., list]:
    """Windows that occur again, merged. Equal windows have equal minimisers, so one with such an identity was looked at wherever it stands."""

    def rows(repo: str | None, text: bytes, shape: bytes, high: list[int], low: list[int], copies: int) -> list:
        texts, first, last = unpacked(text, shape)
        ids, again = identities(digests(texts, _repo_seed(repo)), size), np.empty(len(high), dtype=_HALVES)
        again["high"], again["low"] = np.array(high, dtype=np.int64).view(np.uint64), np.array(low, dtype=np.int64).view(np.uint64)
        again.sort()
        at = np.flatnonzero(again[np.minimum(np.searchsorted(again, ids), len(again) - 1)] == ids)
        ends = np.flatnonzero(np.diff(at) != 1)
        runs = [(int(first[at[a]]), int(last[at[b] + size - 1]), ids[at[a]].tobytes()) for a, b in zip([0, *(ends + 1)], [*ends, len(at) - 1], strict=True)]
        runs = [r for r in runs if r[1] - r[0] + 1 >= lines]
        covered, upto = 0, -1
        for a, b, _ in runs:
            covered += max(0, b - max(a, upto + 1) + 1)
            upto = max(upto, b)
        return [[repo], [covered * copies], [[start for _, _, start in runs]]]

    return rows


_LONGS = pa.list_(pa.int64())
_KEPT = pa.schema([("repo_id", pa.string()), ("total", pa.int64()), ("text", pa.binary()), ("shape", pa.binary()), ("alike", pa.binary()), ("h", _LONGS), ("n", _LONGS)])
_COUNTED = pa.schema([("node", pa.int64()), ("high", _LONGS), ("low", _LONGS), ("n", _LONGS)])
_STRETCHES = pa.schema([("repo_id", pa.string()), ("covered", pa.int64()), ("starts", pa.list_(pa.binary()))])


def _more_than_once(sent: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(node, and a list of each column of ``key``): the keys that occur more than once, for each file that has some; ``sent`` has lists of keys and
    of their numbers a file. A key that many files share is counted in each task first; its rows are split by Spark's skew handling in the join."""
    one = sent.select("node", F.explode(F.arrays_zip(*key, "n")).alias("k")).select("node", *[F.col(f"k.{c}").alias(c) for c in key], "k.n")
    repeated = one.groupBy(*key).agg(F.sum("n").alias("times")).where("times > 1").select(*key)
    listed = one.join(repeated, list(key), "left_semi").groupBy("node").agg(F.collect_list(F.struct(*key)).alias("k"))
    return listed.select("node", *[F.col(f"k.{c}").alias(c) for c in key])


def _spread(d: DataFrame) -> DataFrame:
    """Dealt by file to all cores: a partition of compressed tokens that is small for Spark is much work for Python, so none is to be merged with others."""
    spark = d.sparkSession
    return d.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "node")


def duplication(files: DataFrame, tokens: int = TOKENS, lines: int = LINES) -> DataFrame:
    """(repo_id, duplication struct(percentage, duplicateLines, cloneClusters)) of each repository that has files.

    A clone is a stretch that starts alike somewhere else; lines are counted once however many clones cover them. Each row of
    ``files`` is a file of its own, also where names repeat; rows without content are left out. The result is written to the
    shared folder, and what was kept for it is deleted.
    """
    with passing(files.sparkSession) as keep:
        return cut_lineage(_duplication(files, tokens, lines, keep))


def _duplication(files: DataFrame, tokens: int, lines: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    there = files.where(F.col("content").isNotNull()).select("repo_id", "content", count_lines("content").cast("long").alias("total"))
    cut = _by_row(("repo_id", "content", "total"), _KEPT, _kept(tokens, _lex))
    kept = there.mapInArrow(cut, "repo_id string, total long, text binary, shape binary, alike binary, h array<long>, n array<long>")
    kept = keep(kept.withColumn("node", F.monotonically_increasing_id()))  # numbers are drawn once and kept
    # One file of those that are alike stands for all; only numbers and minimisers move for that.
    first = keep(kept.groupBy("repo_id", "alike").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("copies")).select("node", "copies"))
    times = F.transform("n", lambda n: n * F.col("copies")).alias("n")
    chosen = kept.select("node", "h", "n").join(first, "node").select("node", "h", times)
    file = ("node", "repo_id", "text", "shape")
    # What is looked for is written before tokens move to it, so that the disk does not hold both shuffles at once.
    some = _spread(kept.select(*file)).join(_spread(keep(_more_than_once(chosen, ("h",)))), "node").select(*file, "h")
    counted = some.mapInArrow(_by_row((*file, "h"), _COUNTED, _counted(tokens)), "node long, high array<long>, low array<long>, n array<long>")
    counted = keep(counted.join(first, "node").select("node", "high", "low", times, "copies"))
    again = _spread(kept.select(*file)).join(_spread(keep(_more_than_once(counted, ("high", "low")).join(first, "node"))), "node")
    by = (*file[1:], "high", "low")
    found = again.select("copies", *by).mapInArrow(_by_row((*by, "copies"), _STRETCHES, _stretches(tokens, lines)), "repo_id string, covered long, starts array<binary>")
    # One row a file and one a start, so that a single grouping by repository gives the lines and the different starts.
    each = found.select("repo_id", "covered", F.explode(F.concat(F.array(F.lit(None).cast("binary")), "starts")).alias("start"))
    once = each.groupBy("repo_id", "start").agg(F.sum(F.when(F.col("start").isNull(), F.col("covered"))).alias("covered"))
    clones = once.groupBy("repo_id").agg(F.sum("covered").alias("covered"), F.count("start").alias("clones"))
    whole = kept.groupBy("repo_id").agg(zero(F.sum("total")).alias("total"))
    d = whole.join(clones.withColumnRenamed("repo_id", "repo_of"), F.col("repo_id").eqNullSafe(F.col("repo_of")), "left")
    got = F.struct(pct1(zero(F.col("covered")), "total").alias("percentage"), zero(F.col("covered")).alias("duplicateLines"), zero(F.col("clones")).alias("cloneClusters"))
    return d.select("repo_id", got.alias("duplication"))


def repeated_lines(texts: DataFrame, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """lines, repeated (lines whose content occurs more than once in the group) and pct; on whole texts, in built-in functions."""
    lines = texts.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line")).where(F.trim("line") != "")
    counts = lines.groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("n"))
    again = zero(F.sum(F.when(F.col("n") > 1, F.col("n"))))
    return counts.groupBy(*keys).agg(F.sum("n").alias("lines"), again.alias("repeated"), pct1(again, F.sum("n")).alias("pct"))
