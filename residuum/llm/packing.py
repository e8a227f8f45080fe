"""Documents packed into as few sequences as possible, whole where they fit.

Texts are encoded where they are read; what moves on is one narrow row per
piece.  Only documents longer than a sequence are cut, into full sequences; the
first piece holds what is over.  Because lengths are whole numbers up to the
capacity, the packing problem is a histogram of that many numbers whatever the
size of the corpus: Spark counts it, ``bin_completion`` solves it on the driver,
and the solution's patterns say which of the pieces of one length go where.
Which piece takes which place is its rank among the pieces of its length: its
rank inside its part of the input plus the pieces of that length in earlier
parts.  No length, document or sequence is ever gathered in one task.

Defined cases: a NULL or empty text is the end id alone; NULL ids, repeated ids
and repeated rows are documents of their own; extra columns are ignored; an
empty table gives an empty result.  Very long texts are cut like others.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residuum.llm.bin_completion import NODES, Pattern, complete
from residuum.llm.bytewords import BLANKS, prefix_sums, stretch_hash, text_bytes, words_before
from residuum.llm.shared import Workspace, held, slices
from residuum.llm.words import PieceMemory

#: Bound of one worker's memory of ids; beyond it is emptied.
MAX_IDS = 1 << 23


class BlankLed:
    """Stretches of a slice of texts that a byte-level vocabulary encodes apart:
    each begins with blanks and goes on to the next blank.  Its splitting rule
    lets no token go from another character to a blank, so the ids of a text are
    those of its stretches.  After a blank outside ASCII nothing is cut, as the
    rule takes runs of blanks together."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        blank = BLANKS[data]
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-1] = blank[1:] & ~blank[:-1]
        at = np.flatnonzero(begin)
        one, three = data[at - 1], data[np.maximum(at - 3, 0)]
        wide = ((data[np.maximum(at - 2, 0)] == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three >= 0xE1) & (three <= 0xE3))
        begin[at[wide]] = False
        begin[offsets] = True
        begin[-1] = False
        self.data = data
        self.begins = np.flatnonzero(begin)
        self.ends = np.append(self.begins[1:], len(data)) if len(self.begins) else self.begins
        self.rows = words_before(offsets, self.begins)
        self.keys = stretch_hash(prefix_sums(data), self.begins, self.ends) if len(data) else np.zeros(0, np.uint64)

    def texts(self, at: np.ndarray) -> list[str]:
        raw = self.data.tobytes()
        return [raw[a:b].decode() for a, b in zip(self.begins[at].tolist(), self.ends[at].tolist())]


class ByteEncoder:
    """Encodes slices of texts with a byte-level ``tokenizers`` vocabulary;
    equal to ``encode(text, add_special_tokens=False).ids`` of each text.  Each
    distinct stretch is encoded once per worker, by the library."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.memory = PieceMemory(self._work_out, self.dtype)

    def _work_out(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, self.dtype).tobytes() for at in range(0, len(texts), 1000)
                for e in encode(texts[at:at + 1000], add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the border of each."""
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        if len(self.memory.pool) > MAX_IDS:
            self.memory = PieceMemory(self._work_out, self.dtype)
        pieces = BlankLed(data, offsets)
        at, length = self.memory.look_up(pieces)
        total = np.concatenate([[0], np.cumsum(length)])
        return self.memory.pool[np.repeat(at - total[:-1], length) + np.arange(total[-1])], total[pieces.rows]


def _cuts(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and begin of every piece of documents of these lengths."""
    pieces = -(-lengths // capacity)
    row = np.repeat(np.arange(len(lengths)), pieces)
    number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = lengths - (pieces - 1) * capacity
    return row, number, np.where(number > 0, first[row] + (number - 1) * capacity, 0)


PIECES = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, local long"


def cut_documents(docs: DataFrame, work: Workspace, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id",
                  text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One stored row per piece; ``local`` is its rank among the pieces of its
    length and part.  With ``with_ids`` the ids are stored too."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own = held(f"byte encoder {vocabulary}", lambda: ByteEncoder(vocabulary))
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], own.dtype)
        for whole in batches:
            for batch in slices(whole, "_text"):
                ids, borders = own.encode(*text_bytes(batch.column("_text")))
                ids = np.insert(ids, borders[1:], end)
                borders = borders + np.arange(len(borders))
                row, number, start = _cuts(np.diff(borders), capacity)
                begin = borders[row] + start
                length = np.minimum(borders[row + 1] - begin, np.where(number > 0, capacity, (np.diff(borders)[row] - 1) % capacity + 1))
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
                first = np.flatnonzero(new)
                local = np.empty(len(length), np.int64)
                local[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                wide = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(wide[4 * a:4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist())]
                columns = [pa.array(np.full(len(row), part, np.int32)), batch.column("_id").take(pa.array(row)), pa.array(number.astype(np.int32)),
                           pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(local)]
                names = ["part", "doc_id", "piece", "start", "length", "ids_crc32", "local"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return work.table(src.mapInArrow(run, PIECES + ", ids array<int>" * with_ids), "pieces")


def places(solution: list[tuple[Pattern, int]]) -> np.ndarray:
    """Where the pieces of each length go: rows of size, first rank, pieces a
    sequence, first sequence, offset; sorted by size and rank.  The rows are as
    many as the sizes of the patterns."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in solution:
        offset = 0
        for size, copies in pattern:
            rows.append((size, taken.get(size, 0), copies, sequence, offset))
            taken[size] = taken.get(size, 0) + copies * times
            offset += size * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, work: Workspace, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False, nodes: int = NODES) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every
    piece (and ``ids`` with ``with_ids``, for ``sequences``)."""
    pieces = cut_documents(docs, work, vocabulary, end_id, capacity, id_col, text_col, with_ids)
    counts = work.table(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    # at most `capacity` rows
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(complete(histogram, capacity, nodes))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("local") + F.col("before")).alias("rank"), *["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = table[:, 0]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.empty(len(size), np.int64)
            for s in np.unique(size):
                a, b = np.searchsorted(sizes, [s, s + 1])
                own = size == s
                at[own] = a + np.searchsorted(table[a:b, 1], rank[own], side="right") - 1
            _, first, copies, sequence, offset = table[at].T
            step = rank - first
            placed = [pa.array(sequence + step // copies), pa.array(offset + step % copies * size)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *placed, *map(batch.column, ["ids"] * with_ids)],
                                             names=[*names, "sequence_id", "offset", *["ids"] * with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of a packing with ids; a group is one sequence, so
    it holds at most the capacity."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
