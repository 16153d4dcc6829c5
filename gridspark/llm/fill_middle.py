"""Fill-in-the-middle: texts cut at unit borders and put into the order prefix, suffix, middle (or suffix, prefix, middle).

Units are lines (with their line feed) or code points. The UTF-8 bytes of a batch are viewed as unsigned 64-bit words. Arithmetic on
whole words marks the byte that ends each unit, a population count per word gives running totals, a binary search in them finds the
word that holds the end of unit k, and clearing lowest marks inside that word finds its byte. All cuts of a batch are found at once.

Where a text is cut, and into which form it goes, depends only on the seed and the document's id: the first four groups of eight hex digits of
the SHA-256 of ``seed:id`` are h1 to h4. The prefix ends after the smaller, the middle after the larger of h1 and h2 modulo (units + 1).

How it scales: one pass in batches of about 2 MB of text (a longer text is a batch of its own), no shuffle, nothing sent around.

Defined results: a null text counts as an empty one; an empty text, or one that holds one of the marks, stays ``plain`` and is its own
output. A null id is hashed as an empty string. Rows that repeat an id get the same draws, each on its own text. An empty table gives no rows. Input
columns named like a result column are replaced; all others stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridspark.llm.textbytes import chunks, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
UNITS = ("line", "code_point")

LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
HIGH = np.uint64(0x8080808080808080)
FEEDS = np.uint64(0x0A0A0A0A0A0A0A0A)
ONE = np.uint64(1)


# ---- words ------------------------------------------------------------------------------------------------------------------


def as_words(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian words, with at least one zero byte behind the last one."""
    padded = np.zeros((data.size // 8 + 1) * 8, np.uint8)
    padded[: data.size] = data
    return padded.view("<u8")


def line_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a line feed: a byte of ``x`` is zero if neither it nor its sum with 0x7F has the high bit."""
    x = words ^ FEEDS
    return ~(((x & LOW) + LOW) | x | LOW)


def code_point_starts(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is no continuation (10xxxxxx)."""
    return (~words | (words << ONE)) & HIGH


def code_point_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that the start of a code point, or the padding, follows."""
    starts = code_point_starts(words)
    ends = starts >> np.uint64(8)
    ends[:-1] |= starts[1:] << np.uint64(56)
    return ends


class Marks:
    """Marked bytes of an array of words, with rank (marks before a byte) and select (byte of the k-th mark)."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.zeros(marks.size + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marked bytes lie before each position; positions may be one past the last byte."""
        word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        inside = self.marks[word] & ((ONE << shift) - ONE)
        return self.before[word] + np.bitwise_count(inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th marked byte, counted from 1."""
        word = np.searchsorted(self.before, k, side="left") - 1
        left, over = self.marks[word], k - self.before[word] - 1
        for step in range(7):
            clear = over > step
            if not clear.any():
                break
            left[clear] &= left[clear] - ONE
        lowest = left & (~left + ONE)
        return (word << 3) + (np.bitwise_count(lowest - ONE) >> 3)


class Cuts:
    """Units of the texts of one batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str):
        words = as_words(data)
        self.starts, self.ends = offsets[:-1], offsets[1:]
        self.points = Marks(code_point_starts(words))
        self.marks = Marks(line_ends(words) if unit == "line" else code_point_ends(words))
        self.first = self.marks.rank(self.starts)
        self.units = self.marks.rank(self.ends) - self.first
        if unit == "line" and data.size:
            # What follows the last line feed of a text is a unit of its own.
            self.units += (self.ends > self.starts) & (data[np.maximum(self.ends - 1, 0)] != 0x0A)

    def after(self, k: np.ndarray) -> np.ndarray:
        """The byte position behind the first ``k`` units of each text."""
        out = np.where(k <= 0, self.starts, self.ends)
        inner = np.flatnonzero((k > 0) & (k < self.units))
        if inner.size:
            out[inner] = self.marks.select(self.first[inner] + k[inner]) + 1
        return out

    def code_points(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.points.rank(b) - self.points.rank(a)


# ---- forms ------------------------------------------------------------------------------------------------------------------


def draws(ids: list, seed: int) -> np.ndarray:
    """The four numbers of each id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def join_parts(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == PLAIN:
        return prefix + middle + suffix
    if form == PSM:
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def split_parts(form: str, output: str) -> tuple[str, str, str]:
    """Prefix, middle and suffix of an output; no part holds a mark, so the first of each kind is the one that was put in."""
    if form == PLAIN:
        return output, "", ""
    head, _, middle = output.partition(MIDDLE)
    if form == PSM:
        prefix, _, suffix = head.removeprefix(PREFIX).partition(SUFFIX)
    else:
        suffix, _, prefix = head.removeprefix(SUFFIX).partition(PREFIX)
    return prefix, middle, suffix


RESULT = T.StructType(
    [
        T.StructField("n_units", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


def fill_in_middle(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    unit: str = "line",
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
) -> DataFrame:
    """``docs`` with n_units, form, prefix_chars, middle_chars (code points, null for plain texts) and output.

    ``percent`` of the documents are cut at all (h3), ``spm_percent`` of those go into the suffix-first form (h4).
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    docs = docs.drop(*[c for c in docs.columns if c in RESULT.names and c not in (text, doc_id)])
    names = docs.columns

    def run(batches):
        for batch in chunks(batches, text):
            data, offsets = text_bytes(batch.column(text))
            raw = data.tobytes()
            cuts = Cuts(data, offsets, unit)
            h = draws(batch.column(doc_id).to_pylist(), seed)
            first, second = h[:, 0] % (cuts.units + 1), h[:, 1] % (cuts.units + 1)
            a, b = cuts.after(np.minimum(first, second)), cuts.after(np.maximum(first, second))
            forms, outputs = [], []
            for i, (s, p, m, e) in enumerate(zip(offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist(), strict=True)):
                whole = raw[s:e].decode()
                plain = not whole or h[i, 2] % 100 >= percent or any(mark in whole for mark in (PREFIX, SUFFIX, MIDDLE))
                forms.append(PLAIN if plain else SPM if h[i, 3] % 100 < spm_percent else PSM)
                outputs.append(whole if plain else join_parts(forms[-1], raw[s:p].decode(), raw[p:m].decode(), raw[m:e].decode()))
            plain = np.array([f == PLAIN for f in forms], bool)
            extra = {
                "n_units": pa.array(cuts.units, pa.int64()),
                "form": pa.array(forms, pa.string()),
                "prefix_chars": pa.array(cuts.code_points(offsets[:-1], a), pa.int64(), mask=plain),
                "middle_chars": pa.array(cuts.code_points(a, b), pa.int64(), mask=plain),
                "output": pa.array(outputs, pa.string()),
            }
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=[*names, *extra])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *RESULT.fields]))


def restore(filled: DataFrame, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """``filled`` with the text that was cut, from the output and its form alone."""
    filled = filled.drop(restored)
    names = filled.columns

    def run(batches):
        for batch in chunks(batches, output):
            parts = zip(batch.column(form).to_pylist(), batch.column(output).to_pylist(), strict=True)
            texts = pa.array(["".join(split_parts(f, o)) for f, o in parts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*names, restored])

    return filled.mapInArrow(run, T.StructType([*filled.schema.fields, T.StructField(restored, T.StringType())]))
