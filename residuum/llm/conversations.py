"""Repair of conversations whose turns were lost, doubled, cut or mislabelled.

A repaired conversation has no blank, doubled or cut turn and its roles read
``(system? (user assistant)+)?``.  The cheapest edits that lead there are found
over one byte per row (``repair_paths``), so no conversation needs to fit a task:

* rows are counted by (conversation, turn, role, text digest) and put in order by
  ranges of that key, so that a long conversation spans many partitions;
* runs of one conversation inside a partition become segments of one byte a row,
  cut at 32,768; a conversation that lies within one segment is solved there;
* the few segments of conversations that go on in another partition hand their
  costs backwards and their states forwards, one short row a segment, and are
  solved for each state that they may be entered in;
* scripts and texts meet in one pass, in order, with one row in memory at a time.

Order is by turn (NULLs first), then role, then a digest of role and text.  Equal
rows stand next to one another; all but the first are duplicates.

Defined cases: NULL roles and texts are one space; a NULL conversation id is a
conversation; a role counts by its first character, an empty role is like any
other unknown one; no rows give no conversations; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm import repair_paths as R
from residuum.llm.bytewords import text_bytes
from residuum.llm.shared import Workspace, slices

#: Rows of a segment at most, and rows that are solved together at most.
SEGMENT = 1 << 15
BLANK_CHARS = " \t\n\x0b\x0c\r"


def damage(rows: DataFrame) -> DataFrame:
    """Test damage by ``crc32("conv_id:turn") % 20``: 0 drops the row, 1 empties
    its text, 2 removes its ends of sentences, 3 repeats it (``times`` 2), 4 calls
    it the user's.  NULLs are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
                       F.when(kind == 3, 2).otherwise(1).alias("times"), kind.alias("_kind")).filter("_kind <> 0").drop("_kind")


def _keyed(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, digest, times, text`` of the rows to repair."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    times = F.col("times").cast("long") if "times" in rows.columns else F.lit(1).cast("long")
    src = rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"),
                      blank("text").alias("text"), times.alias("times"))
    return src.withColumn("digest", F.unhex(F.substring(F.sha2(F.concat("role", F.lit("\0"), "text"), 256), 1, 32)))


def _code(role: Column, text: Column) -> Column:
    """One byte a row: the kind of role, and the fault that its text alone shows."""
    kind = F.lit(len(R.KINDS))
    for at, initial in enumerate(R.KINDS):
        kind = F.when(F.substring(role, 1, 1) == initial, at).otherwise(kind)
    kept = F.rtrim(text, F.lit(BLANK_CHARS))
    fault = F.when(kept == "", R.BLANK).when(F.substring(kept, -1, 1).isin(".", "!", "?"), R.NO_FAULT).otherwise(R.TRUNCATED)
    return (kind + 4 * fault).cast("int")


ORDER = ["conv", "turn", "role", "digest"]
FAULTS = {"blank": R.BLANK, "duplicate": R.DUPLICATE, "truncated": R.TRUNCATED}
SEGMENTS = ("conv long, seq long, open boolean, turn long, role string, digest binary, codes binary, first_turn long, last_turn long, "
            "n_turns long, min_turn long, max_turn long, illegal long, " + ", ".join(f"{f} long" for f in FAULTS))


def _segments(table: pa.Table, seq: int, first_open: bool, last_open: bool) -> pa.RecordBatch:
    """Rows in order as segments, one a conversation, numbered from ``seq``."""
    number = lambda c: (pc.is_null(table[c]).to_numpy(), pc.fill_null(table[c], 0).to_numpy())
    (conv_null, conv), (turn_null, turn) = number("conv"), number("turn")
    code, new = table["code"].to_numpy(), table["new"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (conv_null[1:] != conv_null[:-1])]))
    borders = np.append(starts, len(code))
    inside = np.ones(len(code), bool)
    inside[starts] = False
    kind, fault = code & 3, code >> 2
    fault = np.where(fault == R.BLANK, R.BLANK, np.where(new, fault, R.DUPLICATE))
    wrong = np.concatenate([[False], ~R.IN_ORDER[kind[:-1], kind[1:]]]) & inside
    other_turn = np.concatenate([[True], (turn[1:] != turn[:-1]) | (turn_null[1:] != turn_null[:-1])]) | ~inside
    total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[borders])
    ends = borders[1:] - 1
    known = total(~turn_null)
    lowest = np.minimum(borders[1:] - known, ends)  # NULLs stand first
    opens = np.zeros(len(starts), bool)
    opens[0], opens[-1] = opens[0] | first_open, opens[-1] | last_open or (len(starts) == 1 and first_open)
    raw = R.code(kind, fault).astype(np.uint8).tobytes()
    first = table.take(pa.array(starts))
    # the first key of an open segment places its script among the texts
    key = lambda c: pc.if_else(pa.array(opens), first[c], pa.scalar(None, first[c].type)).combine_chunks()
    optional = lambda v, null: pa.array(v, pa.int64(), mask=null)
    columns = {
        "conv": first["conv"].combine_chunks(), "seq": pa.array(seq + np.arange(len(starts))), "open": pa.array(opens),
        "turn": key("turn"), "role": key("role"), "digest": key("digest"),
        "codes": pa.array([raw[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())], pa.binary()),
        "first_turn": optional(turn[starts], turn_null[starts]), "last_turn": optional(turn[ends], turn_null[ends]),
        "n_turns": pa.array(total(other_turn & ~turn_null)), "min_turn": optional(turn[lowest], known == 0),
        "max_turn": optional(turn[ends], known == 0), "illegal": pa.array(total(wrong)),
    } | {name: pa.array(total(fault == f)) for name, f in FAULTS.items()}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _to_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition, in order, with a row of ``times`` 0 before the first
    of equal texts.  Conversations that have ended go on as whole segments; the
    first and the last of the partition, and the pieces of a long one, are open."""
    from pyspark import TaskContext

    seq, goes_on, held, marked = TaskContext.get().partitionId() << 32, True, None, False

    def emit(table: pa.Table, last_open: bool) -> pa.RecordBatch:
        nonlocal seq, goes_on
        out = _segments(table, seq, goes_on, last_open)
        seq, goes_on = seq + out.num_rows, last_open
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        table, times = pa.Table.from_batches([batch]), batch.column("times").to_numpy()
        mark = np.concatenate([[marked], times[:-1] == 0])
        marked = times[-1] == 0
        upto = np.cumsum(times)
        for at in range(0, int(upto[-1]), SEGMENT):
            copy = np.arange(at, min(at + SEGMENT, int(upto[-1])))
            row = np.searchsorted(upto, copy, side="right")
            part = table.take(pa.array(row)).append_column("new", pa.array(mark[row] & (copy == upto[row] - times[row])))
            held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
            if held.num_rows < SEGMENT:
                continue
            conv = held["conv"].combine_chunks()
            last = pc.is_null(conv) if not conv[-1].is_valid else pc.fill_null(pc.equal(conv, conv[-1]), False)
            tail = held.num_rows - pc.sum(last).as_py()
            if tail:
                yield emit(held.slice(0, tail), False)
                held = held.slice(tail)
            while held.num_rows >= SEGMENT:
                yield emit(held.slice(0, SEGMENT), True)
                held = held.slice(SEGMENT)
    if held is not None and held.num_rows:
        yield emit(held, True)


def segments(keyed: DataFrame, work: Workspace) -> DataFrame:
    """The stored segments of all conversations."""
    counted = work.table(keyed.groupBy(*ORDER).agg(F.sum("times").alias("times"), F.min(_code(F.col("role"), F.col("text"))).alias("code")), "counted")
    # where each text of a conversation is seen first: a row of its own before it
    seen = counted.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    marks = seen.select("conv", F.col("first.turn").alias("turn"), "role", "digest", F.lit(0).cast("long").alias("times"), F.lit(0).alias("code"))
    key = [F.col(c).asc_nulls_first() for c in ORDER]
    placed = counted.unionByName(marks).repartitionByRange(*key).sortWithinPartitions(*key, "times")
    return work.table(placed.mapInArrow(_to_segments, SEGMENTS), "segments")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Segments that are solved together, their bytes and borders."""
    for batch in batches:
        for part in slices(batch, "codes", SEGMENT):
            data, borders = text_bytes(part.column("codes"))
            yield part, data.astype(np.int64), borders


PASSED = ["conv", "seq", "turn", "role", "digest", *FAULTS, "illegal", "n_turns", "min_turn", "max_turn"]
PASSED_SCHEMA = "conv long, seq long, turn long, role string, digest binary, " + ", ".join(f"{c} long" for c in PASSED[5:])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, codes, borders in _slices(batches):
        n = part.num_rows
        got = R.least_paths(codes, borders, np.tile(R.AT_END, (n, 1)), np.ones(n, bool), np.tile(np.arange(4) == R.EMPTY, (n, 1)))
        yield pa.RecordBatch.from_arrays([*map(part.column, PASSED), pa.array([s[R.EMPTY] for s in got.scripts], pa.string()), pa.array(got.costs[:, R.EMPTY])],
                                         names=[*PASSED, "script", "cost"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, codes, borders in _slices(batches):
        m = R.segment_matrices(codes, borders).reshape(-1, 16)
        yield pa.RecordBatch.from_arrays([part.column("conv"), part.column("seq"), pa.array(m.tolist(), pa.list_(pa.int64()))], names=["conv", "seq", "matrix"])


_NONE = object()


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs to go after each segment, from a conversation's last one back."""
    of, costs = _NONE, None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            last = of is _NONE or r["conv"] != of
            if last:
                of, costs = r["conv"], R.AT_END
            out.append((r["seq"], costs.tolist(), last))
            costs = R.through(np.array(r["matrix"]).reshape(4, 4), costs)
        if out:
            seq, ends, lasts = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(ends, pa.list_(pa.int64())), pa.array(lasts)], names=["seq", "at_end", "last"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, codes, borders in _slices(batches):
        n = part.num_rows
        ends = np.array(part.column("at_end").to_pylist(), np.int64)
        got = R.least_paths(codes, borders, ends, part.column("last").to_numpy(zero_copy_only=False), np.ones((n, 4), bool))
        kinds = codes & 3
        extra = [pa.array(got.scripts, pa.list_(pa.string())), pa.array(got.exits.tolist(), pa.list_(pa.int32())), pa.array(got.costs[:, R.EMPTY]),
                 pa.array(kinds[borders[:-1]].astype(np.int32)), pa.array(kinds[borders[1:] - 1].astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*map(part.column, [*PASSED, "first_turn", "last_turn"]), *extra],
                                         names=[*PASSED, "first_turn", "last_turn", "scripts", "exits", "cost", "first_kind", "last_kind"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each segment is entered, and what two neighbours share."""
    of, before = _NONE, None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            first = of is _NONE or r["conv"] != of
            entry = R.EMPTY if first else before["exits"][before["entry"]]
            wrong = not first and not R.IN_ORDER[before["last_kind"], r["first_kind"]]
            same_turn = not first and r["first_turn"] is not None and r["first_turn"] == before["last_turn"]
            of, before = r["conv"], r | {"entry": entry}
            out.append((r["seq"], entry, first, int(wrong), int(same_turn)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["seq", "entry", "first", "wrong", "shared"])


def scripts(parts: DataFrame, work: Workspace) -> DataFrame:
    """The cheapest, then least script of every segment, with what its rows show."""
    closed = parts.filter("not open").mapInArrow(_whole, PASSED_SCHEMA + ", script string, cost long")
    opened = parts.filter("open")
    chain = opened.mapInArrow(_matrices, "conv long, seq long, matrix array<long>").repartition("conv").sortWithinPartitions("conv", F.desc("seq"))
    solved = work.table(opened.join(chain.mapInArrow(_backward, "seq long, at_end array<long>, last boolean"), "seq").mapInArrow(
        _open, PASSED_SCHEMA + ", first_turn long, last_turn long, scripts array<string>, exits array<int>, cost long, first_kind int, last_kind int"), "solved")
    entered = solved.select("conv", "seq", "exits", "first_turn", "last_turn", "first_kind", "last_kind").repartition("conv").sortWithinPartitions("conv", "seq")
    joined = solved.join(entered.mapInArrow(_forward, "seq long, entry long, first boolean, wrong long, shared long"), "seq").withColumns({
        "script": F.col("scripts")[F.col("entry").cast("int")], "cost": F.when(F.col("first"), F.col("cost")).otherwise(0),
        "illegal": F.col("illegal") + F.col("wrong"), "n_turns": F.col("n_turns") - F.col("shared")})
    return work.table(closed.unionByName(joined.select(closed.columns)), "scripts")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Scripts applied to texts that arrive in order, each script before its rows:
    ``(conv, edit, turn, role, text)`` of every edit, and ``(conv, None, ...)`` at
    the end of a conversation."""
    of, script, later, at, state = _NONE, "", deque(), 0, R.EMPTY

    def letter() -> str:
        nonlocal script, at
        while at == len(script):
            if not later:
                return ""
            script, at = later.popleft(), 0
        at += 1
        return script[at - 1]

    def added() -> str:
        nonlocal state
        state = int(R.NEXT[state])
        return "assistant" if state == R.ASSISTANT else "user"

    def ended() -> Iterator[tuple]:
        while letter():
            yield of, "I", None, added(), ""
        yield of, None, None, None, None

    for batch in batches:
        for conv, turn, role, times, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "times", "text"))):
            if of is _NONE or conv != of:
                if of is not _NONE:
                    yield from ended()
                of, script, at, state = conv, "", 0, R.EMPTY
                later.clear()
            if not times:
                later.append(text)
                continue
            for _ in range(times):
                edit = letter()
                while edit == "I":
                    yield conv, "I", None, added(), ""
                    edit = letter()
                if edit == "K":
                    state = int(R.KEPT[state][(R.KINDS + role[:1]).index(role[:1])])
                yield conv, edit, turn, added() if edit == "R" else role, text
    if of is not _NONE:
        yield from ended()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "position", "edit", "turn", "role", "text"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    out, size, position = [], 0, 0
    for conv, edit, turn, role, text in _edits(batches):
        if edit is None:
            position = 0
            continue
        out.append((conv, None if edit == "D" else position, edit, turn, role, text))
        size, position = size + len(text), position + (edit != "D")
        if size > 1 << 20 or len(out) == 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, digest, first = [], hashlib.sha256(), True
    for conv, edit, _, role, text in _edits(batches):
        if edit is None:
            out.append((conv, digest.hexdigest()))
            digest, first = hashlib.sha256(), True
        elif edit != "D":
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        if len(out) == 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["conv", "sha256"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out])], names=["conv", "sha256"])


class Repair:
    """The repair of conversations ``conv_id, turn, role, text`` (and ``times``,
    if a row stands for several equal ones).

    ``conversations``: one row per conversation, with counts, costs and script.
    ``rows()``: every edit with the repaired row; deleted ones have no position.
    ``digests()``: the SHA-256 of each repaired conversation.  It is sequential by
    nature: the texts of one conversation pass through one task, row by row.
    """

    def __init__(self, rows: DataFrame, work: Workspace):
        self._keyed = _keyed(rows)
        self._scripts = scripts(segments(self._keyed, work), work)

    @property
    def conversations(self) -> DataFrame:
        together = F.array_sort(F.collect_list(F.struct("seq", "script")))
        total = {c: F.sum(c).alias(c) for c in (*FAULTS, "illegal", "cost")}
        return self._scripts.groupBy("conv").agg(
            F.coalesce(F.max("max_turn") - F.min("min_turn") + 1 - F.sum("n_turns"), F.lit(0)).alias("gaps"), *total.values(),
            F.array_join(F.transform(together, lambda s: s["script"]), "").alias("audit"))

    def _in_order(self) -> DataFrame:
        text = self._keyed.select(*ORDER, F.lit(None).cast("long").alias("seq"), "times", "text")
        script = self._scripts.select(*ORDER, "seq", F.lit(0).cast("long").alias("times"), F.col("script").alias("text"))
        both = text.withColumn("_kind", F.lit(1)).unionByName(script.withColumn("_kind", F.lit(0)))
        key = [F.col(c).asc_nulls_first() for c in (*ORDER, "_kind", "seq")]
        return both.repartition("conv").sortWithinPartitions(*key).select("conv", "turn", "role", "times", "text")

    def rows(self) -> DataFrame:
        return self._in_order().mapInArrow(_rows, "conv_id long, position long, edit string, turn long, role string, text string")

    def digests(self) -> DataFrame:
        return self._in_order().mapInArrow(_digests, "conv long, sha256 string")


def repair_report(original: DataFrame, rows: DataFrame, work: Workspace) -> DataFrame:
    """One row per conversation of ``original``, whose damaged ``rows`` are repaired."""
    done = Repair(rows, work)
    found = done.conversations.join(done.digests().withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv")))
    ids = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")}
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
