"""Benchmark decontamination: documents that hold passages of test questions and answers.

``contamination`` scans every text once with an Aho-Corasick automaton over the word windows of the items.
Texts and items are normalised alike: A-Z in lower case, words of digits, a-z and non-ASCII characters, one
space between words. Places of hits come back as code point offsets of the original text.

How it scales: documents stay in their partitions; a task scans a few megabytes of text per call. Items are read by
the driver in parts of at most ``PATTERN_BYTES`` of windows, one automaton each, so the broadcast is bounded; with more
items than that, the documents pass one scan per part, and each scan merges its hits with those found before, without a shuffle.

Defined results: a null or empty text has no words and no hits; an item without words is left out; an item of fewer than
``WINDOW`` words is one window; items with equal windows are all reported. Null item ids are left out. An empty benchmark gives rows without
hits, an empty document table gives none. Repeated rows are scanned one by one. Columns of ``docs`` that carry the name of a result
column are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.textbytes import LOWER, WORD, chunks, code_points, runs, text_bytes

WINDOW = 13
# A document is contaminated if at least one in so many of its words is hit.
HIT_SHARE = 20
PATTERN_BYTES = 8 << 20
SPACE, BORDER = 0x20, 0x0A

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
# hits are code points of the text, _d_words the same spans counted in words.
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hits", T.ArrayType(SPAN)),
        T.StructField("_d_words", T.ArrayType(SPAN)),
    ]
)
ARROW = [pa.int64(), pa.int64(), pa.list_(pa.string()), ARROW_SPANS, ARROW_SPANS]


def item_words(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends = runs(WORD[data], np.array([0, data.size]))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def item_windows(text: str | None, width: int = WINDOW) -> set[bytes]:
    words = item_words(text)
    last = max(len(words) - width, 0)
    return {b" ".join(words[i : i + width]) for i in range(last + 1)} if words else set()


def _automaton(windows: dict[bytes, tuple[int, list[str]]]) -> ahocorasick.Automaton:
    """Each window stands between spaces, so that it starts and ends with whole words."""
    out = ahocorasick.Automaton()
    for key, value in windows.items():
        out.add_word(f" {key.decode('latin-1')} ", value)
    out.make_automaton()
    return out


_BUILT: dict[str, ahocorasick.Automaton | None] = {}


def _automaton_of(shared) -> ahocorasick.Automaton | None:
    """The automaton of broadcast (name, windows), built once per Python worker."""
    name, windows = shared.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = _automaton(windows) if windows else None
    return _BUILT[name]


def _normal(data: np.ndarray, offsets: np.ndarray):
    """Word runs, and the normal form: each text is its words in spaces, and a border stands between two texts.

    One byte per word byte, one space after each word, and two bytes (border, space) before each text.
    """
    low = LOWER[data]
    starts, ends = runs(WORD[low], offsets)
    first = np.searchsorted(starts, offsets[:-1])  # index of the first word of each text
    sizes = ends - starts
    text_of = np.searchsorted(offsets, starts, side="right") - 1
    place = np.cumsum(sizes + 1) - (sizes + 1) + 2 * (text_of + 1)  # where each word begins in the normal form
    total = int(sizes.sum()) + starts.size + 2 * (offsets.size - 1)
    normal = np.full(total, SPACE, np.uint8)
    mask = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    to = np.repeat(place - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    normal[to] = low[mask]
    before = np.concatenate([sizes + 1, [0]])
    ahead = np.concatenate([[0], np.cumsum(before)])[first] + 2 * np.arange(offsets.size - 1)
    normal[ahead] = BORDER
    return starts, ends, first, place, normal


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def scan(column: pa.Array, automaton, earlier: list[tuple[list, list]] | None = None) -> list[tuple]:
    """The result fields of each text; ``earlier`` holds the items and word spans of former scans."""
    data, offsets = text_bytes(column)
    starts, ends, first, place, normal = _normal(data, offsets)
    counts = np.diff(np.append(first, starts.size))
    found: dict[int, tuple[set, list]] = {}
    for i, (items, words) in enumerate(earlier or []):
        if words:
            found[i] = (set(items), [(w["start"], w["end"]) for w in words])
    if automaton is not None and starts.size:
        for end, (size, items) in automaton.iter(normal.tobytes().decode("latin-1")):
            word = int(np.searchsorted(place, end, side="right")) - 1  # the last word of the window
            text = int(np.searchsorted(first, word, side="right")) - 1
            text_items, spans = found.setdefault(text, (set(), []))
            text_items.update(items)
            last = word - int(first[text]) + 1
            spans.append((last - size, last))
    points = code_points(data) if found else None
    out = []
    for i, n in enumerate(counts.tolist()):
        if i not in found:
            out.append((n, 0, [], [], []))
            continue
        items, spans = found[i]
        merged = _merge(spans)
        at, zero = int(first[i]), points[offsets[i]]
        marks = [{"start": int(points[starts[at + a]] - zero), "end": int(points[ends[at + b - 1]] - zero)} for a, b in merged]
        words = [{"start": a, "end": b} for a, b in merged]
        out.append((n, sum(b - a for a, b in merged), sorted(items), marks, words))
    return out


def _parts(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[dict]:
    """Windows with their length and items, in parts of bounded size."""
    items = benchmark.filter(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total * WINDOW // limit))
    for k in range(n):
        windows: dict[bytes, tuple[int, list[str]]] = {}
        for row in items.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k).toLocalIterator():
            for w in item_windows(row.t):
                windows.setdefault(w, (w.count(b" ") + 1, []))[1].append(row.i)
        yield windows


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    pattern_bytes: int = PATTERN_BYTES,
) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids whose windows occur, as sorted strings), hits (spans) and contaminated."""
    spark = docs.sparkSession
    out = docs.drop(*[c for c in docs.columns if c in {*RESULT.names, "contaminated"}])
    names, fields = out.columns, out.schema.fields
    for i, windows in enumerate(_parts(benchmark, item_id, item_text, pattern_bytes)):
        out = out.mapInArrow(_scanner(spark.sparkContext.broadcast((uuid.uuid4().hex, windows)), names, text, i > 0), T.StructType([*fields, *RESULT.fields]))
    hit = (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words"))
    return out.withColumn("contaminated", hit).drop("_d_words")


def _scanner(shared, names: list[str], text: str, again: bool):
    def run(batches):
        for batch in chunks(batches, text):
            earlier = None
            if again:
                earlier = list(zip(batch.column("items").to_pylist(), batch.column("_d_words").to_pylist(), strict=True))
            found = scan(batch.column(text), _automaton_of(shared), earlier)
            extra = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(ARROW)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *extra], names=[*names, *RESULT.names])

    return run
