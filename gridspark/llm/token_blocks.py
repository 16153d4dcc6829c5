"""Token ids in files of patched frame-of-reference blocks.

``encode_blocks`` tokenizes the documents in ascending order of their ids and ``write_blocks`` stores them; ``read_documents``
reads the files back. A file is a Parquet file of segments, so that any store that Spark can reach will do. A segment
holds the ids of consecutive documents as one stream, cut into blocks of ``BLOCK`` ids:

* each block stores its smallest id once and the differences to it in a fixed number of bits;
* that width covers the ``PERCENTILE`` smallest differences of the block; for the others, the exceptions, the low bits stay
  in place and the high bits go into a list with their positions;
* the segment has the start of every block in the packed words and in the exception lists, so any block can be read alone,
  and the ids and lengths of its documents.

How it scales: one range shuffle by doc_id; every task encodes and writes its own range. The driver sees nothing but the
paths. Places in the whole stream come from sums per segment and per partition.

Defined results: a null or empty text is the end id alone. Null doc_ids come first, equal ones follow each other by text. An empty
table gives an empty file and no rows. Other columns are not stored.
"""

from __future__ import annotations

import uuid
import zlib
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.session import ensure_checkpoint_dir

BLOCK = 1024
LANES = 64
PERCENTILE = 90
SEGMENT_IDS = 1 << 19
CACHE_WORDS = 500_000

SEGMENT = (
    "part int, segment int, n_ids long, doc_ids array<long>, doc_sizes array<long>, lows binary, widths binary, "
    "block_starts binary, exception_starts binary, packed binary, exception_places binary, exception_highs binary"
)


# ---- blocks -----------------------------------------------------------------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """``values`` (blocks, BLOCK) in ``width`` bits each: row i of 64 lanes goes to bits i * width of every lane word."""
    lanes = np.ascontiguousarray(values.reshape(-1, LANES, BLOCK // LANES).transpose(1, 0, 2)).astype(np.uint64)
    out = np.zeros((width, *lanes.shape[1:]), np.uint64)
    for i in range(LANES):
        word, shift = divmod(i * width, 64)
        out[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return out.transpose(1, 0, 2).reshape(values.shape[0], -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.reshape(words.shape[0], width, BLOCK // LANES).transpose(1, 0, 2))
    mask = np.uint64((1 << width) - 1)
    out = np.empty((LANES, *lanes.shape[1:]), np.uint32)
    for i in range(LANES):
        word, shift = divmod(i * width, 64)
        value = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (lanes[word + 1] << np.uint64(64 - shift))
        out[i] = value & mask
    return out.transpose(1, 0, 2).reshape(words.shape[0], BLOCK)


def _bits(values: np.ndarray) -> np.ndarray:
    """Number of bits of each value."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def encode(ids: np.ndarray, percentile: int = PERCENTILE) -> dict[str, np.ndarray]:
    """The blocks of a stream of unsigned 32-bit ids."""
    n = -(-ids.size // BLOCK)
    padded = np.empty(n * BLOCK, np.uint32)
    padded[: ids.size] = ids
    padded[ids.size :] = ids[-1] if ids.size else 0
    blocks = padded.reshape(n, BLOCK)
    lows = blocks.min(axis=1) if n else np.zeros(0, np.uint32)
    rest = blocks - lows[:, None]
    at = BLOCK * percentile // 100 - 1
    widths = _bits(np.partition(rest, at, axis=1)[:, at]) if n else np.zeros(0, np.uint8)
    sizes = widths.astype(np.int64) * (BLOCK // LANES)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    packed = np.zeros(int(starts[-1]), np.uint64)
    masks = ((np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    for width in np.unique(widths[widths > 0]).tolist():
        own = np.flatnonzero(widths == width)
        words = _pack(rest[own] & masks[own, None], width)
        packed[starts[own][:, None] + np.arange(words.shape[1])] = words
    block, place = np.nonzero(rest > masks[:, None])
    highs = rest[block, place] >> widths[block].astype(np.uint32) if n else np.zeros(0, np.uint32)
    counts = np.bincount(block, minlength=n)
    return {
        "lows": lows.astype("<u4"),
        "widths": widths,
        "block_starts": starts.astype("<u4"),
        "exception_starts": np.concatenate([[0], np.cumsum(counts)]).astype("<u4"),
        "packed": packed.astype("<u8"),
        "exception_places": place.astype("<u2"),
        "exception_highs": highs.astype("<u4"),
    }


KINDS = {"lows": "<u4", "widths": "u1", "block_starts": "<u4", "exception_starts": "<u4", "packed": "<u8", "exception_places": "<u2", "exception_highs": "<u4"}


def decode(stored: dict[str, bytes], n_ids: int, blocks: slice = slice(None)) -> np.ndarray:
    """The ids of a segment, or of a slice of its blocks (found through the index of block starts)."""
    part = {k: np.frombuffer(stored[k], kind) for k, kind in KINDS.items()}
    widths, starts = part["widths"][blocks], part["block_starts"][:-1][blocks].astype(np.int64)
    chosen = np.arange(part["widths"].size)[blocks]
    out = np.zeros((widths.size, BLOCK), np.uint32)
    for width in np.unique(widths[widths > 0]).tolist():
        own = np.flatnonzero(widths == width)
        out[own] = _unpack(part["packed"][starts[own][:, None] + np.arange(width * (BLOCK // LANES))], width)
    first = part["exception_starts"][:-1][blocks].astype(np.int64)
    counts = part["exception_starts"][1:][blocks].astype(np.int64) - first
    at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    block = np.repeat(np.arange(widths.size), counts)
    out[block, part["exception_places"][at]] |= part["exception_highs"][at] << widths[block].astype(np.uint32)
    out += part["lows"][blocks][:, None]
    flat = out.reshape(-1)
    if chosen.size and chosen[-1] == part["widths"].size - 1:
        flat = flat[: flat.size - (part["widths"].size * BLOCK - n_ids)]
    return flat


# ---- tokens -----------------------------------------------------------------------------------------------------------------


# Byte-level vocabularies write bytes that have no visible Latin-1 letter as the letters from 256 on, in order.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(_HIDDEN)}


class Encoder(dict):
    """Ids of whole texts from a tokenizer file, little-endian 32 bits each.

    For tokenizers that drop white space and never look across it (``by_chunk``), a text is the sequence of its chunks between
    spaces and line feeds, and the ids of the first ``cache_words`` different chunks are kept in this mapping. Each shortcut is only taken where probes
    show it to be right: chunks apart from each other (``by_chunk``), words of lower-case letters straight to the tokenizer's model (``plain``), words
    with capitals as those without (``lowers``), a full stop or comma after letters as a chunk of its own (``splits``). Otherwise whole texts are encoded.
    """

    PROBES = ("a", "the", "of", "tokenizer", "zyxwvut", "ll", "re", "s", "qqqq", "été", "größe", "señor", "ωμέγα", "字", "ж")
    CASED = ("A", "The", "THE", "Of", "Brown", "tOkEnIzEr", "ZYXWVUT", "LL", "iPhone", "QqQq")
    MIXED = ("the Brown", "THE x2", "été ÉTÉ", "ΣΑΣ ωμέγα", "12 345", "a1 B2", "don't I'll", "x-y Z", "字 ж")

    def __init__(self, path: str, by_chunk: bool, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache_words = cache_words
        of = self._of_text
        words = [*self.PROBES, *self.CASED]
        pairs = [*(p.split(" ") for p in self.MIXED), *zip(words, words[1:], strict=False)]
        self.by_chunk = by_chunk and all(of(f"{x}{gap}{y}") == of(x) + of(y) for x, y in pairs for gap in (" ", "\n", "  "))
        self.plain = self.by_chunk and all(self._of_model(w) == of(w) for w in self.PROBES)
        self.lowers = self.plain and all(of(w) == of(w.lower()) for w in self.CASED)
        self.splits = self.plain and all(of(w + mark) == of(w) + of(mark) for w in words for mark in ".,")

    def _of_text(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _of_model(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if not self.plain:
            out = self._of_text(chunk)
        elif chunk.isalpha():
            small = chunk == chunk.lower()
            if small and (chunk.isascii() or is_normalized("NFC", chunk)):
                out = self._of_model(chunk)
            elif self.lowers and chunk.isascii():
                out = self[chunk.lower()]
            else:
                out = self._of_text(chunk)
        elif self.splits and len(chunk) > 1 and chunk[-1] in ".," and chunk[:-1].isalpha():
            out = self[chunk[:-1]] + self[chunk[-1]]
        else:
            out = self._of_text(chunk)
        if len(self) < self.cache_words:
            self[chunk] = out
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return [self._of_text(t) for t in texts]
        get = self.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(path: str, by_chunk: bool) -> Encoder:
    if (path, by_chunk) not in _ENCODERS:
        _ENCODERS[path, by_chunk] = Encoder(path, by_chunk)
    return _ENCODERS[path, by_chunk]


def _segment_row(part: int, number: int, doc_ids: list, encoded: list[bytes]) -> pa.RecordBatch:
    stream = np.frombuffer(b"".join(encoded), "<u4")
    stored = {k: v.tobytes() for k, v in encode(stream).items()}
    cells = {"part": part, "segment": number, "n_ids": stream.size, "doc_ids": doc_ids, "doc_sizes": [len(e) // 4 for e in encoded], **stored}
    kinds = {"part": pa.int32(), "segment": pa.int32(), "n_ids": pa.int64(), "doc_ids": pa.list_(pa.int64()), "doc_sizes": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in cells.items()], names=list(cells))


def encode_blocks(
    docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", by_chunk: bool = False, partitions: int | None = None
) -> DataFrame:
    """Segments of the documents in ascending order of ``doc_id``, the end id after each document."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        part, number, size = TaskContext.get().partitionId(), 0, 0
        doc_ids, encoded = [], []
        tokens = _encoder(tokenizer, by_chunk)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                some = batch.slice(start, 64)
                ids = some.column(0).to_pylist()
                for i, e in zip(ids, tokens([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    doc_ids.append(i)
                    encoded.append(e + end)
                    size += len(e) // 4 + 1
                    if size >= SEGMENT_IDS:
                        yield _segment_row(part, number, doc_ids, encoded)
                        doc_ids, encoded, number, size = [], [], number + 1, 0
        if doc_ids:
            yield _segment_row(part, number, doc_ids, encoded)

    ordered = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).repartitionByRange(n, F.asc_nulls_first("d"))
    return ordered.sortWithinPartitions(F.asc_nulls_first("d"), F.asc_nulls_first("t")).mapInArrow(run, SEGMENT)


def write_blocks(segments: DataFrame, path: str) -> None:
    """Store segments; the packed columns are not compressed again."""
    segments.write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document in the whole stream), n_tokens and ids (binary, little-endian 32 bits) from stored files."""
    stored = spark.read.parquet(path)
    sums = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    places = stored.select("part", "segment", inside.alias("segment_start"), F.col("n_ids").alias("_n")).join(before, "part")
    places = places.select("part", "segment", (F.col("part_start") + F.col("segment_start")).alias("first"))
    names = ["part", "segment", "n_ids", "doc_ids", "doc_sizes", *KINDS]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                cells = {k: batch.column(k)[row] for k in names}
                ids = decode({k: cells[k].as_buffer() for k in KINDS}, cells["n_ids"].as_py())
                sizes = np.array(cells["doc_sizes"].as_py(), np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                pieces = [raw[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                count = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([cells["part"].as_py()] * count, pa.int32()),
                        pa.array([cells["segment"].as_py()] * count, pa.int32()),
                        cells["doc_ids"].values,
                        pa.array(ends - sizes),
                        pa.array(sizes),
                        pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                        pa.array([bytes(p) for p in pieces], pa.binary()),
                    ],
                    names=["part", "segment", "doc_id", "offset", "n_tokens", "ids_crc32", "ids"],
                )

    schema = "part int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long, ids binary"
    read = stored.select(*names).mapInArrow(run, schema)
    return read.join(places, ["part", "segment"]).select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "ids")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
