"""Repair of conversations whose turns are missing, blank, repeated, cut off or out of order.

* ``signatures`` writes one letter a row (role and first fault) and joins them to one signature per conversation.
* ``audits`` finds the cheapest edits of every signature on the suffix-sharing graph of ``repair_dawg``.
* ``repaired_rows`` applies the edits to the rows; ``row_digests`` hashes the repaired rows of each conversation.

The rows of a conversation are taken by turn (nulls first; ties by role, then by the MD5 of the text). The first fault of a row counts: blank (no
character but white space), duplicate (role and text stood earlier in the conversation), truncated (the last character that is no white space is not
one of ``.!?``). Keep costs 0, another role 3, delete 4 (blank and duplicate rows must go), insert an empty row 3, and a truncated row that stays 3
more. The role initials of the result match ``(s?(ua)+)?``; of several cheapest repairs the ASCII-least one is taken.

How it scales: faults are found on narrow rows (the text's MD5 and flags). Equal rows of a conversation are one row with a number before any shuffle
that could be hot; repeats are found by a minimum per role and text. Narrow rows are then dealt by ranges of (conversation, turn, role, MD5), so a
conversation with a third of all rows lies in many tasks, each of which writes its piece of the signature; the pieces together are as long as the
edits, which are a cell of the result. Signatures are dealt by ranges of (reversed signature, conversation): a signature that a third of all
conversations have spreads over tasks, and suffixes are shared inside each. Texts are shuffled once, by conversation, and stream through the last step in
order with nothing kept but the edits. This step takes a conversation in one task: its digest is sequential by definition.

Defined results: null conv_ids are one conversation (the smallest long is not allowed as an id); a null role or text is one space. A conversation all
of whose rows have 0 copies is reported with zeros, no edits and no rows. Rows without ``copies`` column stand once. An empty table gives no rows. Further
columns are not carried along.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.repair_dawg import FAULTS, LETTERS, MUST_GO, ROLES, Graph
from gridspark.session import cut_lineage

SPACES = " \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)
WRITTEN = {1: "system", 2: "user", 3: "assistant"}


def prepared(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """(conv, turn, role, text, md, n) without nulls but in ``turn``."""
    body = F.coalesce(F.col(text), F.lit(" "))
    return rows.select(
        F.coalesce(F.col(conv_id).cast("long"), F.lit(NO_ID)).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        body.alias("text"),
        F.unhex(F.md5(body)).alias("md"),
        (F.lit(1) if copies is None else F.col(copies)).cast("long").alias("n"),
    )


def _letter(fault: Column) -> Column:
    role = F.substring("role", 1, 1)
    number = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3)
    return (fault * 4 + number).cast("int")


def marked_rows(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, md, n, code, again): the letter number of the first copy and of the others; different rows only. Materialised."""
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    flags = rows.select("conv", "turn", "role", "md", "n", F.when(end == "", 2).when(end.isin(".", "!", "?"), 0).otherwise(1).alias("fault"))
    different = cut_lineage(flags.groupBy("conv", "turn", "role", "md", "fault").agg(F.sum("n").alias("n")))
    standing = different.filter((F.col("n") > 0) & (F.col("fault") != 2))
    repeated = standing.groupBy("conv", "role", "md").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("places"))
    both = different.join(repeated.filter("places > 1").drop("places"), ["conv", "role", "md"], "left")
    later = F.col("first").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("first"))
    blank = F.col("fault") == 2
    code = F.when(blank, 2).when(later, 3).otherwise(F.col("fault"))
    return cut_lineage(both.select("conv", "turn", "role", "md", "n", _letter(code).alias("code"), _letter(F.when(blank, 2).otherwise(3)).alias("again")))


def _pieces(batches):
    """For every run of a conversation in a batch: its part of the signature, and its turns."""
    letters = np.frombuffer(LETTERS.encode(), np.uint8)
    for batch in batches:
        conv, n = batch.column("conv").to_numpy(), batch.column("n").to_numpy()
        code, again = batch.column("code").to_numpy(), batch.column("again").to_numpy()
        known = np.asarray(batch.column("turn").is_valid()) & (n > 0)
        turn = batch.column("turn").fill_null(0).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])) if conv.size else np.zeros(0, np.int64)
        last = np.append(first[1:], conv.size)
        ends = np.cumsum(n)
        written = np.repeat(again, n)
        written[(ends - n)[n > 0]] = code[n > 0]
        text = letters[written].tobytes().decode()
        cells = {"conv": [], "piece": [], "low": [], "high": [], "turns": []}
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            own = turn[a:b][known[a:b]]
            cells["conv"].append(int(conv[a]))
            cells["piece"].append(text[ends[a] - n[a] : ends[b - 1]])
            cells["low"].append(int(own[0]) if own.size else None)
            cells["high"].append(int(own[-1]) if own.size else None)
            cells["turns"].append(int(np.count_nonzero(own[1:] != own[:-1])) + 1 if own.size else 0)
        at = [batch.column(k).take(pa.array(first)) for k in ("turn", "role", "md")]
        kinds = {"piece": pa.string()}
        arrays = [pa.array(v, kinds.get(k, pa.int64())) for k, v in cells.items()]
        yield pa.RecordBatch.from_arrays([*arrays, *at], names=[*cells, "at_turn", "at_role", "at_md"])


PIECES = "conv long, piece string, low long, high long, turns long, at_turn long, at_role string, at_md binary"


def _count(raw: Column, fault: str) -> Column:
    k = 4 * FAULTS.index(fault)
    return (F.length(raw) - F.length(F.translate(raw, LETTERS[k : k + 4], ""))).cast("long")


def signatures(rows: DataFrame) -> DataFrame:
    """Per conversation: its signature from the end, gaps, and the number of rows of each fault and of illegal neighbours."""
    ordered = marked_rows(rows).repartitionByRange("conv", "turn", "role", "md").sortWithinPartitions("conv", "turn", "role", "md")
    pieces = ordered.mapInArrow(_pieces, PIECES)
    joined = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at_turn", "at_role", "at_md", "piece", "low", "high", "turns"))).alias("p"))
    raw = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    # A turn that ends one piece and begins the next was counted twice.
    n = F.size("p")
    pairs = F.zip_with(F.slice("p", F.lit(1), n - 1), F.slice("p", F.lit(2), n - 1), lambda x, y: F.when(x["high"] == y["low"], 1).otherwise(0))
    turns = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["turns"]) - F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    span = F.array_max(F.transform("p", lambda x: x["high"])) - F.array_min(F.transform("p", lambda x: x["low"])) + 1
    flat = joined.select("conv", raw.alias("raw"), F.coalesce(span - turns, F.lit(0)).cast("long").alias("gaps"))
    roles = F.translate("raw", LETTERS, ROLES * len(FAULTS))
    legal = F.regexp_count(roles, F.lit("s(?=u)|u(?=a)|a(?=u)"))
    must_go = LETTERS[8:]
    return flat.select(
        "conv",
        F.reverse(F.translate("raw", must_go, MUST_GO * len(must_go))).alias("signature"),
        "gaps",
        *[_count(F.col("raw"), fault).alias(fault) for fault in ("blank", "duplicate", "truncated")],
        (F.greatest(F.length("raw") - 1, F.lit(0)) - legal).cast("long").alias("illegal"),
    )


def _solved(batches):
    graph, last, answer = Graph(), None, (0, "")
    for batch in batches:
        costs, edits = [], []
        for signature in batch.column("signature").to_pylist():
            if signature != last:
                answer, last = graph.solve(signature), signature
            costs.append(answer[0])
            edits.append(answer[1])
        rest = [c for c in batch.schema.names if c != "signature"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(costs, pa.int64()), pa.array(edits, pa.string())], names=[*rest, "cost", "audit"])


def audits(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation, materialised."""
    dealt = cut_lineage(signatures(rows)).repartitionByRange("signature", "conv").sortWithinPartitions("signature", "conv")
    return cut_lineage(
        dealt.mapInArrow(_solved, "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    )


def _applied(batches):
    """Rows of each conversation behind its edits, in order; rows are written as soon as their edits are known."""
    conv, edits, at, state, place = None, "", 0, 0, 0
    out: list[tuple] = []

    def write(edit, role, text):
        nonlocal place
        out.append((conv, place, role, text, edit))
        place += 1

    def inserted():
        nonlocal at, state
        while edits[at : at + 1] == "I":
            state = 3 if state == 2 else 2
            write("I", WRITTEN[state], "")
            at += 1

    def flush():
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv", "place", "role", "text", "edit"])
        out.clear()
        return batch

    for batch in batches:
        held = 0
        for c, audit, n, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "audit", "n", "role", "text")), strict=True):
            if audit is not None:
                inserted()
                conv, edits, at, state, place = c, audit, 0, 0, 0
                continue
            for _ in range(n):
                inserted()
                edit = edits[at]
                at += 1
                if edit == "K":
                    state = 1 + ROLES.index(role[0])
                    write(edit, role, text)
                elif edit == "R":
                    state = 3 if state == 2 else 2
                    write(edit, WRITTEN[state], text)
                held += len(text) * (edit != "D")
            if held > 1 << 22:
                yield flush()
                held = 0
        yield flush()
    inserted()
    yield flush()


def repaired_rows(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """(conv, place, role, text, edit): what the edits leave of ``rows`` and put in, in order inside each partition."""
    heads = audit.select("conv", "audit")
    both = heads.unionByName(rows.filter("n > 0"), allowMissingColumns=True)
    order = ["conv", F.col("audit").isNull(), "turn", "role", "md"]
    return both.repartition("conv").sortWithinPartitions(*order).mapInArrow(_applied, "conv long, place long, role string, text string, edit string")


def _digested(batches):
    conv, digest, done, any_row = None, None, [], False
    for batch in batches:
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "role", "text")), strict=True):
            if not any_row or c != conv:
                if any_row:
                    done.append((conv, digest.hexdigest()))
                conv, digest, any_row = c, hashlib.sha256(), True
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if len(done) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["conv", "sha256"])
            done = []
    if any_row:
        done.append((conv, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["conv", "sha256"])


def row_digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha256) of ``role:text`` joined by line feeds, over the rows of ``repaired_rows``; none for conversations without rows."""
    return repaired.mapInArrow(_digested, "conv long, sha256 string")


def repair(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The audit of every conversation and its repaired rows, both by ``conv`` (``NO_ID`` for null)."""
    known = prepared(rows, conv_id, turn, role, text, copies)
    audit = audits(known)
    return audit, repaired_rows(known, audit)
