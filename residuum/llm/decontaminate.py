"""Benchmark decontamination with one Aho-Corasick automaton.

Every item of the benchmark (questions and answers alike) is lower-cased and
cut into words; its windows of consecutive words, joined by single blanks, are
the automaton's patterns.  Documents are brought into the same form and each is
scanned once.  Because the positions of all words in the original bytes are
kept beside the normalised text, every occurrence maps back to the original.

The automaton's patterns are broadcast in blocks of bounded size.  A benchmark
that fits one block (the usual case) takes one scan; a larger one takes a scan
for each block, and the hits of a document are put together between scans.

Defined cases: a NULL text has no words; a NULL id is carried through; a NULL
item id stands as ``null`` among the item ids; repeated rows each give a row;
with an empty benchmark nothing is hit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm.bytewords import LOWERED, byte_class, text_bytes, words_before, words_of
from residuum.llm.shared import Workspace, held, slices

WINDOW = 13
#: Bytes of patterns in one automaton; its nodes take some fifty times that.
BLOCK_BYTES = 4 << 20
#: What is not a word: the control and punctuation characters of ASCII.
NOT_WORD = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: After lower-casing; A-Z are word letters before it.
_BREAKS = NOT_WORD[LOWERED]

SPAN = "array<struct<start: int, end: int, item_id: string>>"


def word_text(text: str | None) -> list[str]:
    """The words of one short text (a benchmark item)."""
    data, offsets = text_bytes(pa.array([text or ""]))
    begins, ends = words_of(data, offsets, _BREAKS)
    low = LOWERED[data].tobytes()
    return [low[a:b].decode("latin-1") for a, b in zip(begins.tolist(), ends.tolist())]


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id",
                 text_col: str = "text") -> DataFrame:
    """Distinct ``item, pattern, n_words``: an item's windows, or the whole
    item where it has fewer words, but not none."""
    src = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("_item"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, patterns, sizes = [], [], []
            for item, text in zip(batch.column("_item").to_pylist(), batch.column("_text").to_pylist()):
                words = word_text(text)
                n = min(window, len(words))
                for at in range(len(words) - n + 1 if n else 0):
                    items.append("null" if item is None else item)
                    patterns.append((" " + " ".join(words[at:at + n]) + " ").encode("latin-1"))
                    sizes.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(patterns, pa.binary()), pa.array(sizes, pa.int32())],
                names=["item", "pattern", "n_words"])

    return src.mapInArrow(run, "item string, pattern binary, n_words int").distinct()


class Scanner:
    """The automaton of one block of patterns."""

    def __init__(self, rows: list[tuple[str, bytes, int]]):
        import ahocorasick

        owners: dict[bytes, list] = {}
        for item, pattern, n in rows:
            owners.setdefault(bytes(pattern), [n]).append(item)
        self.automaton = ahocorasick.Automaton()
        self.values = []
        for pattern, (n, *items) in owners.items():
            self.automaton.add_word(pattern.decode("latin-1"), len(self.values))
            self.values.append((n, sorted(items)))
        self.sizes = np.array([n for n, _ in self.values], np.int64)
        if self.values:
            self.automaton.make_automaton()

    def scan(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, rows: np.ndarray):
        """Occurrences as first word, last word and pattern, over a slice whose
        words are given; ``rows`` are the word numbers at the text borders."""
        none = np.zeros(0, np.int64)
        if not self.values or not len(begins):
            return none, none, none
        lengths = ends - begins
        text_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        # each text: a border, a blank, and its words with a blank after each
        place = np.cumsum(lengths + 1) - lengths - 1 + 2 * (text_of + 1)
        out = np.full(int(place[-1] + lengths[-1] + 1), 32, np.uint8)
        firsts = rows[:-1][np.diff(rows) > 0]
        out[place[firsts] - 2] = 10
        source = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        out[np.repeat(place - begins, lengths) + source] = LOWERED[data[source]]
        found = list(self.automaton.iter(out.tobytes().decode("latin-1")))
        if not found:
            return none, none, none
        stops, pattern = np.array(found, np.int64).T
        last = np.searchsorted(place, stops) - 1
        return last - self.sizes[pattern] + 1, last, pattern


def _hits(own: Scanner, column: pa.Array, spans: list[list[tuple]]) -> tuple[np.ndarray, list[int]]:
    """Words and hit words of each text; the block's occurrences are added to
    ``spans``."""
    data, offsets = text_bytes(column)
    begins, ends = words_of(data, offsets, _BREAKS)
    rows = words_before(offsets, begins)
    first, last, pattern = own.scan(data, begins, ends, rows)
    text_of = np.searchsorted(rows, first, "right") - 1
    base = offsets[text_of]
    for t, a, b, p in zip(text_of.tolist(), (begins[first] - base).tolist(), (ends[last] - base).tolist(), pattern.tolist()):
        spans[t] += [(a, b, item) for item in own.values[p][1]]
    return np.diff(rows), [_covered(begins, o, s) if s else 0 for o, s in zip(offsets.tolist(), spans)]


def _scan_block(src: DataFrame, patterns, id_type: str, earlier: bool, keep_text: bool) -> DataFrame:
    """One scan: the spans of a block's patterns, after those found ``earlier``;
    ``keep_text`` carries the texts on to the next block's scan."""
    kept, name = ["_text"] * keep_text, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(f"scanner {name}", lambda: Scanner(patterns.value))
        for whole in batches:
            for batch in slices(whole, "_text"):
                spans: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
                if earlier:
                    spans = [[(s["start"], s["end"], s["item_id"]) for s in x] for x in batch.column("spans").to_pylist()]
                n_words, n_hit = _hits(own, batch.column("_text"), spans)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), *(batch.column(c) for c in kept), pa.array(n_words), pa.array(n_hit, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item_id", pa.string())])))],
                    names=["_id", *kept, "n_words", "n_hit", "spans"])

    schema = f"_id {id_type}, " + "_text string, " * keep_text + f"n_words long, n_hit long, spans {SPAN}"
    return src.mapInArrow(run, schema)


def _covered(begins: np.ndarray, base: int, spans: list[tuple]) -> int:
    """Words of a text inside any of its spans."""
    hit, reach = 0, 0
    for start, end in sorted(s[:2] for s in spans):
        if end > reach:
            inside = np.searchsorted(begins, [base + max(start, reach), base + end])
            hit += int(inside[1] - inside[0])
            reach = end
    return hit


def _blocks(benchmark: DataFrame, work: Workspace | None, window: int, block_bytes: int) -> list:
    """Broadcasts of the patterns, in blocks of bounded size; a function each,
    so that one block at a time comes to the driver."""
    windows = item_windows(benchmark, window)
    size = windows.agg(F.sum(F.length("pattern") + F.length("item"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    if n > 1 and work is None:
        raise ValueError("a benchmark of several blocks needs a workspace for what each scan found")
    at = windows if n == 1 else work.table(windows.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(n))), "windows")

    def block(k: int):
        # at most block_bytes of patterns, give or take the hash's unevenness
        own = at if n == 1 else at.filter(F.col("block") == k)
        return benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in own.select("item", "pattern", "n_words").collect()])

    return [lambda k=k: block(k) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, work: Workspace | None = None, window: int = WINDOW,
                  id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id, n_words, n_hit, item_ids, spans`` of every document.

    ``n_hit`` counts the words inside any occurrence of a window, ``item_ids``
    are the items with occurring windows, sorted as strings, and ``spans`` the
    occurrences as byte ranges of the original text.  ``work`` is needed only
    for a benchmark of more than one block.
    """
    return _contamination(docs, _blocks(benchmark, work, window, block_bytes), work, id_col, text_col)


def _contamination(docs: DataFrame, blocks: list, work: Workspace | None, id_col: str, text_col: str) -> DataFrame:
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    id_type = src.schema["_id"].dataType.simpleString()
    for k, patterns in enumerate(blocks):
        more = k < len(blocks) - 1
        out = _scan_block(src, patterns(), id_type, earlier=k > 0, keep_text=more)
        if more:
            src = work.table(out, f"scan-{k}").select("_id", "_text", "spans")
    return out.select(F.col("_id").alias(id_col), "n_words", "n_hit",
                      F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"]))).alias("item_ids"), "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, work: Workspace | None = None, window: int = WINDOW,
                      text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that the contamination rule leaves, as they are."""
    blocks = _blocks(benchmark, work, window, block_bytes)
    if len(blocks) > 1:
        whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
        return _contamination(whole, blocks, work, "_row", "_text").filter(~is_contaminated()).select("_row.*")
    patterns, place, name = blocks[0](), docs.columns.index(text_col), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(f"scanner {name}", lambda: Scanner(patterns.value))
        for whole in batches:
            for batch in slices(whole, place):
                n_words, n_hit = _hits(own, batch.column(place), [[] for _ in range(batch.num_rows)])
                hit = np.array(n_hit, np.int64)
                yield batch.filter(pa.array((hit == 0) | (20 * hit < n_words)))

    return docs.mapInArrow(run, docs.schema)


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """The contamination rule: at least a twentieth of the words are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
