"""Personal data: patterns with exact rules, and spans of a linear-chain conditional random field over word shapes.

The base kinds (email, ip, card, phone) follow fixed patterns. The field adds tel (numbers without a country sign), secret, ssn and iban
where they do not overlap a base span. It labels tokens between white space: those with a digit and their neighbours (letter groups
of account numbers), cue words such as "password" and the ``REACH`` tokens after them (secrets of letters only). All other tokens are
outside by definition, so a text falls into short chains of neighbouring tokens. Features are the token's shape (of which 24 characters are a
feature; length, digits and changes are those of the whole token), its letters and the words before it. ``train`` maximises the likelihood on a small labelled table (at most ``MAX_TOKENS`` rows,
which the driver reads); decoding is Viterbi over numpy batches of chains of equal length.

How it scales: one pass over the documents without a shuffle; parameters are a small broadcast.

Defined results: a null or empty text has no spans. Spans are code points of the whole text, end exclusive. Repeated rows are scanned one
by one, an empty table gives no rows. An empty labelled table gives base spans only. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.textbytes import LOWER, chunks, code_points, runs, text_bytes

BASE = ("email", "ip", "card", "phone")
ADDED = ("tel", "secret", "ssn", "iban")
KINDS = BASE + ADDED
MAX_TOKENS = 100_000
EPOCHS = 150
BUCKETS = 4096

DIGIT = np.zeros(256, dtype=bool)
DIGIT[0x30:0x3A] = True
GAP = np.zeros(256, dtype=bool)
GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A start inside a run of digits could only match where the start of the run does, so it is not tried.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


# ---- base patterns ----------------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> list[tuple[int, int]]:
    """Around each @ the longest run of head letters after the last match; linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _HEAD:
            start -= 1
        tail = EMAIL_TAIL.match(text, at) if start < at else None
        if tail:
            out.append((start, tail.end()))
            end = tail.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        # Zeros in front count for nothing, however many there are; digits are stripped before they become a number.
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the field --------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    labels: tuple[str, ...]
    emissions: np.ndarray  # (BUCKETS, labels)
    transitions: np.ndarray  # (labels, labels)
    first: np.ndarray
    last: np.ndarray


def _hash(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ (h >> 15)) % BUCKETS


_TRIM = "\"'()[]{}<>,.;:!?#*$%&|"
_CLASSES = [(re.compile("[A-Z]"), "X"), (re.compile("[a-z]"), "x"), (re.compile("[0-9]"), "d")]


def shape(token: str) -> str:
    out = token
    for pattern, letter in ((_CLASSES[2]), (_CLASSES[0]), (_CLASSES[1])):
        out = pattern.sub({"X": "\x01", "x": "\x02", "d": "\x03"}[letter], out)
    return out.translate({1: "X", 2: "x", 3: "d"})


def token_features(token: str, before: str, before2: str) -> list[int]:
    """Feature numbers of a token and the two tokens before it."""
    body = token.strip(_TRIM)
    form = shape(body)
    short = re.sub(r"(.)\1+", r"\1+", form)
    digits = form.count("d")
    changes = len(re.findall(r"d[Xx]|[Xx]d", form))
    size = min(len(body), 40)
    alphabet = "hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body) else "alnum" if body.isalnum() else "other"
    cue = before.lower().strip(_TRIM)
    cue2 = before2.lower().strip(_TRIM)
    quoted = token[:1] in "\"'" and token[-1:] in "\"'"
    parts = [
        "bias",
        f"form {form[:24]}",
        f"short {short[:24]}",
        f"size {size // 4}",
        f"digits {min(digits, 16)}",
        f"alphabet {alphabet} {size // 8}",
        f"changes {min(changes, 6)}",
        f"mixed {min(changes, 6) > 2} {size >= 16}",
        f"cue {cue}",
        f"cue2 {cue2}",
        f"set {before in ('=', ':', '=>')} {quoted}",
        f"cue digits {any(c.isdigit() for c in before)}",
    ]
    return [_hash(p) for p in parts]


# A token that ends in a cue word, in lower case, and marks; at the end of a text nothing can follow it.
CUE = re.compile(rb"(?:passwor[dt]|passwd|passphrase|passcode|pwd|token|secret|key|bearer|auth|credentials?)[\"')\]:=>]*(?=[ \t\n\x0b\x0c\r])")
REACH = 3


def field_places(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that the field labels, in order, and their texts; ``starts`` are the tokens' first bytes."""
    digits = np.unique(np.searchsorted(starts, np.flatnonzero(DIGIT[data]), side="right") - 1)
    cues = np.array([m.start() for m in CUE.finditer(LOWER[data].tobytes())], np.int64)
    cues = np.unique(np.searchsorted(starts, cues, side="right") - 1)
    reached = [(digits, k) for k in (-1, 0, 1)] + [(cues, k) for k in range(REACH + 1)]
    origin = np.concatenate([at for at, _ in reached]).astype(np.int64)
    places = np.concatenate([at + k for at, k in reached]).astype(np.int64)
    inside = (places >= 0) & (places < starts.size)
    origin, places = origin[inside], places[inside]
    texts = np.searchsorted(offsets, starts[places], side="right") - 1
    same = texts == np.searchsorted(offsets, starts[origin], side="right") - 1
    places, first = np.unique(places[same], return_index=True)
    return places, texts[same][first]


def chains(places: np.ndarray, texts: np.ndarray) -> list[np.ndarray]:
    """Runs of neighbouring tokens of a text, as positions in ``places``."""
    breaks = np.flatnonzero((np.diff(places) != 1) | (np.diff(texts) != 0)) + 1
    return np.split(np.arange(places.size), breaks) if places.size else []


def viterbi(scores: np.ndarray, field: Field) -> np.ndarray:
    """Best labels (chains, length) of a batch of chains of one length with emission scores (chains, length, labels)."""
    n, length, k = scores.shape
    best = field.first + scores[:, 0]
    back = np.zeros((n, length, k), np.int16)
    for t in range(1, length):
        through = best[:, :, None] + field.transitions
        back[:, t] = through.argmax(axis=1)
        best = through.max(axis=1) + scores[:, t]
    out = np.empty((n, length), np.int16)
    out[:, -1] = (best + field.last).argmax(axis=1)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = back[np.arange(n), t, out[:, t]]
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(data: list[tuple[list[list[int]], list[int]]], labels: list[str], epochs: int = EPOCHS, rate: float = 0.2, decay: float = 0.002) -> Field:
    """Maximum likelihood with an L2 penalty by AdaGrad; the gradient is that of forward-backward sums over chains of equal length."""
    k = len(labels)
    shapes = [(BUCKETS, k), (k, k), (k,), (k,)]
    theta = [np.zeros(s) for s in shapes]
    seen = [np.full(s, 1e-6) for s in shapes]
    groups: dict[int, list] = defaultdict(list)
    for features, gold in data:
        groups[len(gold)].append((features, gold))
    batches = [(np.array([f for f, _ in g]), np.array([y for _, y in g])) for g in groups.values()]
    for _ in range(epochs):
        emissions, transitions, first, last = theta
        grads = [-decay * t for t in theta]
        for features, gold in batches:
            n, length = gold.shape
            scores = emissions[features].sum(axis=2)
            forward = [first + scores[:, 0]]
            for t in range(1, length):
                forward.append(_log_sum(forward[-1][:, :, None] + transitions, 1) + scores[:, t])
            backward = [np.broadcast_to(last, (n, k))]
            for t in range(length - 1, 0, -1):
                backward.insert(0, _log_sum(transitions + (scores[:, t] + backward[0])[:, None, :], 2))
            total = _log_sum(forward[-1] + last, 1)
            for t in range(length):
                p = np.exp(forward[t] + backward[t] - total[:, None])
                error = np.eye(k)[gold[:, t]] - p
                for f in range(features.shape[2]):
                    np.add.at(grads[0], features[:, t, f], error)
                if t == 0:
                    grads[2] += error.sum(axis=0)
                if t == length - 1:
                    grads[3] += error.sum(axis=0)
                if t:
                    pair = forward[t - 1][:, :, None] + transitions + (scores[:, t] + backward[t])[:, None, :] - total[:, None, None]
                    grads[1] -= np.exp(pair).sum(axis=0)
                    np.add.at(grads[1], (gold[:, t - 1], gold[:, t]), 1.0)
        for i, g in enumerate(grads):
            seen[i] += g * g
            theta[i] = theta[i] + rate * g / np.sqrt(seen[i])
    return Field(tuple(labels), *theta)


def train(labelled: DataFrame, max_tokens: int = MAX_TOKENS) -> Field | None:
    """Fit to (line, position, token, label) rows; more than ``max_tokens`` rows are an error, none give no field."""
    rows = labelled.select("line", "position", "token", "label").orderBy("line", "position").limit(max_tokens + 1).collect()
    if len(rows) > max_tokens:
        raise ValueError(f"the labelled table has more than {max_tokens} tokens")
    lines: dict[int, list] = defaultdict(list)
    for row in rows:
        lines[row["line"]].append((row["token"], row["label"]))
    labels = ["O", *(f"{p}-{kind}" for kind in ADDED for p in "BI")]
    data = []
    for line in lines.values():
        words = [w for w, _ in line]
        line_data, offsets = text_bytes(pa.array([" ".join(words)]))
        places, texts = field_places(line_data, offsets, runs(~GAP[line_data], offsets)[0])
        for chain in chains(places, texts):
            at = places[chain].tolist()
            features = [token_features(words[p], words[p - 1] if p else "", words[p - 2] if p > 1 else "") for p in at]
            data.append((features, [labels.index(line[p][1]) for p in at]))
    return fit(data, labels) if data else None


# ---- texts ------------------------------------------------------------------------------------------------------------------

def field_spans(column: pa.Array, field: Field) -> dict[int, list[tuple[int, int, int]]]:
    """For each text with hits: (start, kind number, end) of the spans that the field finds."""
    data, offsets = text_bytes(column)
    starts, ends = runs(~GAP[data], offsets)
    places, texts = field_places(data, offsets, starts)
    if not places.size:
        return {}
    raw, points = data.tobytes(), code_points(data)

    def word(i: int, text: int) -> str:
        return raw[starts[i] : ends[i]].decode(errors="replace") if i >= 0 and starts[i] >= offsets[text] else ""

    by_length: dict[int, list[np.ndarray]] = defaultdict(list)
    for chain in chains(places, texts):
        by_length[chain.size].append(chain)
    scores: dict[tuple[str, str, str], np.ndarray] = {}

    def emission(i: int) -> np.ndarray:
        at, text = int(places[i]), int(texts[i])
        key = (word(at, text), word(at - 1, text), word(at - 2, text))
        if key not in scores:
            scores[key] = field.emissions[token_features(*key)].sum(axis=0)
        return scores[key]

    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for group in by_length.values():
        labels = viterbi(np.array([[emission(i) for i in chain] for chain in group]), field)
        reached = None  # the last token of the span at the end of its text's list
        for r, c in zip(*np.nonzero(labels), strict=True):
            i = int(group[r][c])
            text, at = int(texts[i]), int(places[i])
            begin, _, kind = field.labels[labels[r, c]].partition("-")
            body = word(at, text)
            inner = body.strip(_TRIM)
            start = int(points[starts[at]] - points[offsets[text]]) + body.find(inner)
            span = (start, KINDS.index(kind), start + len(inner))
            spans = found[text]
            if begin == "I" and reached == (r, c - 1) and spans[-1][1] == span[1]:
                if inner:
                    spans[-1] = (spans[-1][0], span[1], span[2])
                reached = (r, c)
            elif inner:
                spans.append(span)
                reached = (r, c)
    return found


def apart(new: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of ``new`` that overlap no span of ``base``; ``base`` is sorted by start, spans of one kind do not overlap."""
    if not base:
        return new
    starts = [a for a, _, _ in base]
    # The furthest end of all base spans up to each one.
    reach = list(accumulate((b for _, _, b in base), max))
    return [s for s in new if not (k := bisect_left(starts, s[2])) or reach[k - 1] <= s[0]]


RESULT = T.StructType(
    [
        *(T.StructField(f"n_{kind}", T.LongType()) for kind in BASE),
        T.StructField("base_spans", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("masked", T.StringType()),
    ]
)


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named by the first."""
    out, end = [], 0
    for a, kind, b in spans:
        if a >= end:
            out += [text[end:a], f"<{KINDS[kind].upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def personal_data(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """``docs`` with counts of base spans, base_spans and spans (kind:start:end, joined), and the masked text."""
    docs = docs.drop(*[c for c in docs.columns if c in RESULT.names])
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns

    def run(batches):
        for batch in chunks(batches, text):
            column = batch.column(text)
            more = field_spans(column, shared.value) if shared.value is not None else {}
            rows = []
            for i, value in enumerate(column.to_pylist()):
                base = base_spans(value) if value else []
                spans = sorted(base + apart(more.get(i, []), base))
                counts = [sum(s[1] == k for s in base) for k in range(len(BASE))]
                rows.append((*counts, _join(base), _join(spans), mask(value, spans) if spans else value))
            extra = [pa.array([r[k] for r in rows], pa.int64() if k < len(BASE) else pa.string()) for k in range(len(RESULT.names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, *RESULT.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *RESULT.fields]))
