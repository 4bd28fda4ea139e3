"""Token ids in binary files of patched frame-of-reference blocks.

A file holds a run of documents in ascending id order. All numbers are little-endian.

    magic "PFOR1\0\0\0"; uint32 block size; uint32 documents; uint64 ids; uint32 blocks; uint32 zero
    int64 id of each document; a bit a document (padded to 8 bytes): the id is null; uint32 ids of each document
    uint64 start of each block, from the beginning of the file, and one more for the end of the last
    blocks: uint32 minimum; uint8 width; uint8 zero; uint16 exceptions;
            block-size values less the minimum, each in ``width`` bits, packed in 64-bit words;
            uint16 place of each exception; uint32 its whole value less the minimum

A block's width is that of the ``PERCENTILE``-th percentile of its values; what needs more bits is an exception. The last
block is filled with its minimum. The index of block starts lets a reader decode any range of ids alone.
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.llm.common import checkpoint_dir, cut_lineage, shuffle_partitions, total_bytes, worker_memory

MAGIC = b"PFOR1\0\0\0"
BLOCK = 1024
PERCENTILE = 95
FILE_IDS = 8 << 20
TASK_BYTES = 16 << 20
END_ID = 1
CACHE_WORDS = 1 << 19
CACHE_PARTS = 1 << 20
#: Longer words are not remembered; longer texts are encoded in pieces.
LONG_WORD, PIECE = 64, 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Blocks that are packed or unpacked at a time.
CHUNK = 512
BROADCAST_FILES = 100_000
_HEAD = "<8sIIQII"


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """values: (n, block) below 2**width; returns (n, words) of 64 bits."""
    n, block = values.shape
    out = np.zeros((-(-block * width // 64), n), dtype=np.uint64)
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    for j in range(block if width else 0):
        word, shift = divmod(j * width, 64)
        out[word] |= columns[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack_bits(words: np.ndarray, width: int, block: int) -> np.ndarray:
    """The inverse of ``pack_bits``."""
    columns = np.ascontiguousarray(words.T)
    out = np.zeros((block, len(words)), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(block if width else 0):
        word, shift = divmod(j * width, 64)
        v = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            v |= columns[word + 1] << np.uint64(64 - shift)
        out[j] = (v & mask).astype(np.uint32)
    return np.ascontiguousarray(out.T)


def _encode_blocks(grid: np.ndarray, percentile: int) -> list[bytes]:
    block = grid.shape[1]
    low = grid.min(axis=1)
    grid = grid - low[:, None]
    at = min(block - 1, block * percentile // 100)
    width = np.ceil(np.log2(np.partition(grid, at, axis=1)[:, at].astype(np.float64) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * len(grid)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        part = grid[rows]
        over = part >> np.uint32(w) > 0 if w < 32 else np.zeros(part.shape, dtype=bool)
        packed = pack_bits(np.where(over, 0, part), int(w))
        for k, r in enumerate(rows):
            place = np.flatnonzero(over[k]).astype("<u2")
            out[r] = struct.pack("<IBBH", low[r], w, 0, len(place)) + packed[k].tobytes() + place.tobytes() + part[k][place].astype("<u4").tobytes()
    return out


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """The bytes of a file; ids: those of all its documents, one after the other."""
    ids = np.asarray(ids, dtype=np.uint32)
    whole = len(ids) // block
    out: list[bytes] = []
    for at in range(0, whole, CHUNK):
        out += _encode_blocks(ids[at * block : min(at + CHUNK, whole) * block].reshape(-1, block), percentile)
    if rest := ids[whole * block :].tolist():
        out += _encode_blocks(np.array([rest + [min(rest)] * (block - len(rest))], dtype=np.uint32), percentile)
    n = len(out)
    null = np.array([d is None for d in doc_ids], dtype=bool)
    flags = np.packbits(null, bitorder="little").tobytes()
    table = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + flags + b"\0" * (-len(flags) % 8) + np.asarray(lengths, dtype="<u4").tobytes()
    start = struct.calcsize(_HEAD) + len(table) + 8 * (n + 1)
    starts = start + np.concatenate([[0], np.cumsum([len(b) for b in out])]).astype("<u8")
    return b"".join([struct.pack(_HEAD, MAGIC, block, len(doc_ids), len(ids), n, 0), table, starts.tobytes(), *out])


class TokenFile:
    """A file's documents and ids; ``read`` decodes no more blocks than a range touches."""

    def __init__(self, data: bytes):
        magic, self.block, n_docs, self.n_ids, n, _ = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a file of token blocks")
        self.data, at = data, struct.calcsize(_HEAD)
        ids = np.frombuffer(data, dtype="<i8", count=n_docs, offset=at)
        at += 8 * n_docs
        size = -(-n_docs // 8)
        null = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=size, offset=at), bitorder="little")[:n_docs]
        at += size + -size % 8
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.lengths = np.frombuffer(data, dtype="<u4", count=n_docs, offset=at).astype(np.int64)
        self.starts = np.frombuffer(data, dtype="<u8", count=n + 1, offset=at + 4 * n_docs).astype(np.int64)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The values of blocks first to last - 1."""
        starts = self.starts[first:last]
        out = np.empty((len(starts), self.block), dtype=np.uint32)
        heads = [struct.unpack_from("<IBBH", self.data, s) for s in starts]
        widths = np.array([h[1] for h in heads], dtype=np.int64)
        for w in np.unique(widths):
            rows, words = np.flatnonzero(widths == w), -(-self.block * int(w) // 64)
            packed = np.stack([np.frombuffer(self.data, dtype="<u8", count=words, offset=starts[r] + 8) for r in rows])
            out[rows] = unpack_bits(packed, int(w), self.block)
        for r, (low, w, _, n) in enumerate(heads):
            if n:
                at = starts[r] + 8 + 8 * (-(-self.block * w // 64))
                out[r][np.frombuffer(self.data, dtype="<u2", count=n, offset=at)] = np.frombuffer(self.data, dtype="<u4", count=n, offset=at + 2 * n)
            out[r] += np.uint32(low)
        return out.reshape(-1)

    def read(self, start: int, stop: int) -> np.ndarray:
        start, stop = max(0, start), min(stop, self.n_ids)
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block, -(-stop // self.block)
        parts = [self.blocks(at, min(at + CHUNK, last)) for at in range(first, last, CHUNK)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]


#: Byte-level models write a byte that is no printable character of Latin-1 as one of the characters from 256 on, in order.
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


class _Words(dict):
    """Ids of words, learnt when they are first asked for."""

    #: Letters that lower-casing and normal forms treat one by one, then marks; an apostrophe may belong to the letters before it.
    PARTS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, tokenizer):
        self.tokenizer, self.parts = tokenizer, {}

    def part(self, p: str) -> bytes:
        """The ids of one pre-token, given to the model in its own alphabet."""
        got = self.parts.get(p)
        if got is None:
            letters = p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_LETTERS)
            got = _ids([t.id for t in self.tokenizer.model.tokenize(letters)])
            if len(p) <= LONG_WORD:
                self.parts[p] = got
        return got

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if m := self.PARTS.fullmatch(text):
            letters, marks = m.groups()
            got = self.part(letters.lower()) + self.part(marks) if marks else self.part(letters.lower())
        else:
            got = _ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(word) <= LONG_WORD:
            self[word] = got
        return got

    def shrink(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()


def _ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: How a tokenizer must cut texts for its words to be encoded one by one.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PATTERN = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
WORD_SPLIT = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": WORD_PATTERN, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def words_apart(tokenizer: dict) -> bool:
    """Whether the words of a text are encoded alike alone and within it, by the tokenizer's file: that it normalises and cuts as
    above, by a plain byte-pair model, and has no token of its own that letters followed by marks could hold."""
    model = tokenizer.get("model") or {}
    same = tokenizer.get("normalizer") == WORD_NORMALIZER and tokenizer.get("pre_tokenizer") == WORD_SPLIT
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "fuse_unk"))
    whole = any(tokenizer.get(k) for k in ("truncation", "padding", "post_processor"))
    own = any(re.fullmatch(r"[A-Za-zÀ-ÖØ-öø-ÿ]*[!-&(-/:-@\[-`{-~]*", t["content"]) or t["content"].split() != [t["content"]] for t in tokenizer.get("added_tokens") or [])
    return same and plain and not whole and not own


class WordEncoder:
    """Encodes whole texts, with a memory of words where the tokenizer drops white space and lower-cases (``words_apart``).

    Such a pre-tokenizer cuts at white space and between letters and marks, and the model never sees across a cut. So the
    ids of a text are those of its words, one after the other, and those of letters followed by marks are those of the
    letters in lower case and then those of the marks, each of which the byte-level model takes as one piece. Words
    of other characters are encoded as they are. Any other tokenizer gets whole texts.
    Ids come as little-endian 32-bit numbers.
    """

    def __init__(self, path: str):
        memory = worker_memory(f"tokenizer {path}")
        if "words" not in memory:
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as f:
                memory["apart"] = words_apart(json.load(f))
            memory["words"] = _Words(Tokenizer.from_file(path))
        self.words, self.apart = memory["words"], memory["apart"]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return [_ids(e.ids) for e in self.words.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return [b"".join(map(self._piece, _pieces(t.encode()))) for t in texts]

    def _piece(self, data: bytes) -> bytes:
        self.words.shrink()
        return b"".join(map(self.words.__getitem__, data.split()))


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``PIECE`` bytes, cut at white space."""
    at = 0
    while len(data) - at > PIECE:
        gap = _GAP.search(data, at + PIECE)
        if gap is None:
            break
        yield data[at : gap.start()]
        at = gap.end()
    yield data[at:] if at else data


def _arrow_uri(path: str) -> str:
    """The URI of a folder as Arrow's file systems take it: file:/a as file:///a, s3a as s3."""
    if "://" not in path:
        return "file://" + path.removeprefix("file:")
    return re.sub("^s3[an]://", "s3://", path)


def _write(path: str, name: str, data: bytes) -> str:
    """A file appears under its name when it is whole; a task that runs again writes a file of its own."""
    fs, folder = pafs.FileSystem.from_uri(_arrow_uri(path))
    fs.create_dir(folder, recursive=True)
    target = posixpath.join(folder, f"{name}-{uuid.uuid4().hex}.pfor")
    with fs.open_output_stream(f"{target}.part") as f:
        f.write(data)
    fs.move(f"{target}.part", target)
    return posixpath.join(path, posixpath.basename(target))


def _writer(path: str, tokenizer: str, end_id: int, block: int, percentile: int, file_ids: int):
    def write(batches):
        encoder = WordEncoder(tokenizer)
        docs: list[int | None] = []
        lengths: list[int] = []
        ids: list[bytes] = []
        end = struct.pack("<I", end_id)
        held = part = number = 0

        def flush():
            nonlocal held, number
            data = encode_file(docs, np.array(lengths), np.frombuffer(b"".join(ids), dtype="<u4"), block, percentile)
            row = (part, number, _write(path, f"part-{part:06d}-{number:06d}", data), len(docs), held)
            docs.clear(), lengths.clear(), ids.clear()
            held, number = 0, number + 1
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=["part", "number", "file", "n_docs", "n_ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            for at in range(0, batch.num_rows, 128):
                piece = batch.slice(at, 128)
                for d, got in zip(piece.column("id_of_row").to_pylist(), encoder(piece.column("text").to_pylist()), strict=True):
                    docs.append(d)
                    lengths.append(len(got) // 4 + 1)
                    ids += [got, end]
                    held += lengths[-1]
                if held >= file_ids:
                    yield flush()
        if docs:
            yield flush()

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, percentile: int = PERCENTILE, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes every whole text and writes the ids below ``path``, a folder that all executors share, in ascending order
    of ids (nulls first; rows of one id by a hash of their text). Returns the manifest: part, number, file, n_docs, n_ids.

    Null texts count as empty; each document ends with ``end_id``. Files that are not in the manifest come from tasks that
    ran again and are to be ignored. An empty table gives an empty manifest. Other columns are ignored.
    """
    if not (2 <= block <= 1 << 16 and 0 < percentile <= 100):
        raise ValueError("block is 2 to 65536, percentile 1 to 100")
    parts = max(shuffle_partitions(docs.sparkSession), -(-total_bytes(docs, text_col) // TASK_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("id_of_row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Rows of one id and text are dealt by their place in the input, so that many of them do not meet in a task.
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4096)))
    order = ["id_of_row", "tie", "place"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "id_of_row", "text")
    made = rows.mapInArrow(_writer(path, tokenizer, end_id, block, percentile, file_ids), "part int, number int, file string, n_docs long, n_ids long")
    return cut_lineage(made)


def _digest(batches):
    for batch in batches:
        rows = []
        for file, base, data in zip(*(batch.column(c).to_pylist() for c in ("file", "base", "content")), strict=True):
            f = TokenFile(data)
            ids = f.read(0, f.n_ids).astype("<u4")
            stops = np.cumsum(f.lengths)
            raw = memoryview(ids).cast("B")
            for d, stop, n in zip(f.doc_ids, stops.tolist(), f.lengths.tolist(), strict=True):
                rows.append((d, base + stop - n, n, zlib.crc32(raw[4 * (stop - n) : 4 * stop]), file))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names=["id_of_row", "start", "n_tokens", "ids_crc32", "file"])


def read_digest(manifest: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Reads the manifest's files back: for each document the id, start (ids of all documents before it), n_tokens, ids_crc32, file."""
    spark = manifest.sparkSession
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    # The window is over files, of millions of ids each, not over documents.
    bases = manifest.select(F.element_at(F.split("file", "/"), -1).alias("name"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    files = manifest.count()
    if not files:
        return spark.createDataFrame([], f"{id_col} long, start long, n_tokens long, ids_crc32 long, file string")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(path)
    content = content.select(F.element_at(F.split("path", "/"), -1).alias("name_of"), "content")
    # Up to this many lines of a name and a number are a few MB; the join of more is left to Spark.
    found = content.join(F.broadcast(bases) if files <= BROADCAST_FILES else bases, F.col("name") == F.col("name_of")).select(F.col("name").alias("file"), "base", "content")
    return found.mapInArrow(_digest, "id_of_row long, start long, n_tokens long, ids_crc32 long, file string").withColumnRenamed("id_of_row", id_col)


def token_digest(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the token files of ``docs`` into a new folder below the shared one and reads them back; the rows are read from there
    whenever they are asked for, so the files stay until the application's folder is cleared."""
    path = posixpath.join(checkpoint_dir(docs.sparkSession), f"tokens-{uuid.uuid4().hex}")
    return read_digest(write_tokens(docs, path, tokenizer, **options), path, options.get("id_col", "doc_id"))
