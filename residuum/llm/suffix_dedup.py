"""Exact substring deduplication by a distributed merge sort of suffixes.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (in
a document of smaller id, or earlier in the same one) is removed.

*Which suffixes.*  A suffix is sorted only at an anchor: the position whose
``GRAM`` bytes have the smallest hash among the positions of some string of
``LENGTH`` bytes.  The choice depends on the string alone, so equal strings
have their anchor at the same place, and about one position in thirty is one.
Anchors whose gram occurs once in the corpus are dropped by an exchange of gram
hashes (once for each chunk of text and gram, so a gram that a third of all
documents have costs an entry a chunk).

*The sort.*  Each task sorts its suffixes into runs.  A run is front-coded: a
suffix is sent as the length of the prefix it shares with the one before and
the bytes that follow.  Runs are dealt out by gram and merged with a loser tree
whose nodes remember the prefix their loser is known to share with the winner;
two suffixes are compared only beyond that, and mostly by two lengths alone.
Suffixes that share an anchor's gram come out side by side; among those a string
(so many bytes before the anchor, the rest behind) is an earlier string's copy
exactly when both parts are equal.  The merge has told how much neighbours share
behind the anchor; sorting the bytes before it backwards tells the same for the
other side, so equality is read off these lengths and never off a hash.

Strings of one task that lie around equal anchors in equal surroundings (compared
byte by byte where their hashes are equal) are settled there: only the earliest is
sent.  For grams with very many different
surroundings each string is a suffix of its own, dealt out by its own bytes, so
no gram gathers in one task.

Later exact copies of a whole text are removed as a whole and not sorted.

Defined cases: a NULL text is empty, with nothing to remove; texts shorter than
``LENGTH`` bytes are kept; documents with a NULL id, or with an id that several
different texts share, have no place in the order, so they are kept whole and
no string counts as occurring earlier because of them; repeated rows (same id
and text) are one document and get the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residuum.llm.bytewords import mix, prefix_sums, stretch_hash, text_bytes
from residuum.llm.shared import Workspace, forget, slices

LENGTH = 100
GRAM = 36
#: Positions of grams in a string, and bytes that may lie before its anchor.
SPAN = LENGTH - GRAM + 1
BEFORE = LENGTH - GRAM
#: Ranges of grams: one for so many bytes of text, and so many at least.
BUCKET_BYTES = 20 << 20
BUCKETS = 512
#: Text of one chunk, in bytes, and of one slice that is hashed at a time.
CHUNK = 32 << 20
SLICE = 2 << 20
#: Grams with more different surroundings than this are sorted string by string.
HOT = 1_000
#: Suffixes of one run.
RUN = 150_000
BROADCAST_IDS = 2_000_000
#: Bits of a gram's hash beside its bucket.
_BITS = 44
_SEVERAL = -1


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a slice: position, first and last start of the strings it is
    the anchor of, and the hash of its gram."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64)
    at = np.arange(n - GRAM + 1)
    sums = prefix_sums(data)
    gram = stretch_hash(sums, at, at + GRAM)
    # the smaller hash first, of equal ones the position further right
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    least, width = key, 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        rest = SPAN - width
        least = np.minimum(least[:-rest], least[rest:])
    starts = np.arange(n - LENGTH + 1)
    inside = np.ones(len(starts), bool)
    # strings that would reach into the next text
    for edge in offsets[1:-1].tolist():
        inside[max(0, edge - LENGTH + 1):edge] = False
    starts = starts[inside]
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    place = (np.uint64(0xFFFFFFFF) - (least[inside] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return place[first], starts[first], starts[last], gram[place[first]]


ROUTED = "bucket int, kind int, data binary"


def _routed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], names=["bucket", "kind", "data"])


def _grams(docs: DataFrame, buckets: int) -> DataFrame:
    """Per chunk and bucket the grams of its anchors: kind 0, one entry a gram
    (with its document and position, or how many there are in the chunk); those
    that a chunk has several of are repeated as they stand: kind 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = turn = 0

        def flush() -> Iterator[pa.RecordBatch]:
            gram, doc, pos = (np.concatenate(x) for x in zip(*held))
            bucket = (gram % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((gram, bucket))
            gram, doc, pos, bucket = gram[order], doc[order], pos[order], bucket[order]
            new = np.concatenate([[True], gram[1:] != gram[:-1]])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(gram)))
            several = np.repeat(count > 1, count)
            rows = []
            for i in range(0, int(several.sum()), 100_000):
                some = np.flatnonzero(several)[i:i + 100_000]
                rows.append(((turn + i // 100_000) % buckets, 3, np.int64([len(some)]).tobytes() + gram[some].tobytes() + doc[some].tobytes() + pos[some].tobytes()))
            many = count > 1
            whose, where = np.where(many, _SEVERAL, doc[at]), np.where(many, count, pos[at]).astype(np.uint32)
            # an id may be negative: what is several is told by a high bit of the gram's six bytes
            edges = np.searchsorted(bucket[at], np.arange(buckets + 1))
            tags = (gram[at] // np.uint64(buckets)) | (many.astype(np.uint64) << np.uint64(47))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                s, e = edges[b], edges[b + 1]
                rows.append((b, 0, np.int64([e - s]).tobytes() + _six(tags[s:e]) + whose[s:e].astype(np.int64).tobytes() + where[s:e].tobytes()))
            yield _routed(rows)

        from pyspark import TaskContext

        forget()
        turn = TaskContext.get().partitionId() * 7
        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                data, offsets = text_bytes(batch.column("_text"))
                place, _, _, gram = anchors(data, offsets)
                if not len(place):
                    continue
                # an anchor can lead the strings of several stretches
                owner = np.searchsorted(offsets, place, "right") - 1
                keep = np.concatenate([[True], place[1:] != place[:-1]])
                ids = batch.column("_id").to_numpy()
                held.append((_short(gram[keep], buckets), ids[owner[keep]], (place - offsets[owner])[keep].astype(np.uint32)))
                size += len(data)
                if size >= CHUNK:
                    yield from flush()
                    held, size, turn = [], 0, turn + 1
        if held:
            yield from flush()

    return docs.mapInArrow(run, ROUTED)


def _short(gram: np.ndarray, buckets: int) -> np.ndarray:
    """A gram's hash with as many bits as are sent beside its bucket."""
    own = np.uint64(buckets)
    return ((gram // own) & np.uint64((1 << _BITS) - 1)) * own + gram % own


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


REPEATED = "kind int, doc long, pos int, gram long"


def _repeated(buckets: int, hot: int):
    """The anchors whose gram occurs again (kind 0), and grams that occur more
    than ``hot`` times (kind 9)."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        grams, docs, places, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, bool)]
        passed = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32))]
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("data")):
            raw = blob.as_buffer().to_pybytes()
            m = int(np.frombuffer(raw, np.int64, 1)[0])
            if kind == 3:
                passed.append((np.frombuffer(raw, np.uint64, m, 8), np.frombuffer(raw, np.int64, m, 8 + 8 * m), np.frombuffer(raw, np.uint32, m, 8 + 16 * m)))
                continue
            tag = _from_six(raw[8:8 + 6 * m])
            grams.append(tag & np.uint64((1 << 47) - 1))
            marks.append(tag >> np.uint64(47) > 0)
            docs.append(np.frombuffer(raw[8 + 6 * m:8 + 14 * m], np.int64))
            places.append(np.frombuffer(raw[8 + 14 * m:], np.uint32))
        gram, doc, pos, several = map(np.concatenate, (grams, docs, places, marks))
        order = np.argsort(gram, kind="stable")
        gram, doc, pos, several = gram[order] * np.uint64(buckets) + np.uint64(bucket), doc[order], pos[order], several[order]
        at = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        times = np.add.reduceat(np.where(several, pos, 1).astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        again = np.repeat(times > 1, np.diff(np.append(at, len(gram)))) & ~several
        often = gram[at][times > hot]
        g = np.concatenate([gram[again], *(x[0] for x in passed), often])
        d = np.concatenate([doc[again], *(x[1] for x in passed), np.zeros(len(often), np.int64)])
        p = np.concatenate([pos[again], *(x[2] for x in passed), np.zeros(len(often), np.uint32)])
        kind = np.zeros(len(g), np.int32)
        kind[len(g) - len(often):] = 9
        return pa.table({"kind": pa.array(kind), "doc": pa.array(d), "pos": pa.array(p.astype(np.int32)), "gram": pa.array(g.astype(np.int64))})

    return run


class Suffixes:
    """Suffixes gathered for one run: the bytes from the anchor on, those before
    it, how few bytes before belong to a string, document and position."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, bytes, bytes, int, int, int]] = []

    def blobs(self) -> list[tuple[int, int, bytes]]:
        """Sorted and front-coded, one run for each bucket."""
        self.rows.sort()
        out, at = [], 0
        while at < len(self.rows):
            end, bucket = at, self.rows[at][0]
            while end < len(self.rows) and self.rows[end][0] == bucket:
                end += 1
            out.append((bucket, 0, front_code(self.rows[at:end])))
            at = end
        self.rows = []
        return out


def front_code(rows: list[tuple[int, bytes, bytes, int, int, int]]) -> bytes:
    """A sorted run as lengths of shared prefixes and the bytes that follow."""
    m = len(rows)
    _, right, left, least, docs, places = zip(*rows)
    size = np.fromiter(map(len, right), np.uint8, m)
    table = np.zeros((m, LENGTH + 1), np.uint8)
    flat = np.frombuffer(b"".join(right), np.uint8)
    inside = np.arange(LENGTH + 1)[None, :] < size[:, None]
    table[inside] = flat
    shared = np.zeros(m, np.uint8)
    if m > 1:
        differ = table[1:] != table[:-1]
        differ[:, LENGTH] = True
        shared[1:] = np.minimum(np.argmax(differ, axis=1), np.minimum(size[1:], size[:-1]))
    rest = table[inside & (np.arange(LENGTH + 1)[None, :] >= shared[:, None])]
    return b"".join([np.int64([m, len(rest)]).tobytes(), size.tobytes(), shared.tobytes(), np.fromiter(map(len, left), np.uint8, m).tobytes(),
                     np.array(least, np.uint8).tobytes(), np.array(docs, np.int64).tobytes(), np.array(places, np.uint32).tobytes(), rest.tobytes(), b"".join(left)])


class Run:
    """A front-coded run taken apart."""

    def __init__(self, raw: bytes):
        m, n = np.frombuffer(raw, np.int64, 2).tolist()
        at = 16
        fields = []
        for dtype in (np.uint8, np.uint8, np.uint8, np.uint8, np.int64, np.uint32):
            width = np.dtype(dtype).itemsize
            fields.append(np.frombuffer(raw[at:at + width * m], dtype))
            at += width * m
        self.size, self.shared, self.before, self.least, self.doc, self.pos = fields
        self.suffixes: list[bytes] = []
        last = b""
        for size, shared in zip(self.size.tolist(), self.shared.tolist()):
            last = last[:shared] + raw[at:at + size - shared]
            at += size - shared
            self.suffixes.append(last)
        self.left: list[bytes] = []
        for size in self.before.tolist():
            self.left.append(raw[at:at + size])
            at += size
        self.prefixes = self.shared.tolist()


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    while a[known:known + 8] == b[known:known + 8]:
        known += 8
    while a[known] == b[known]:
        known += 1
    return known


class PrefixLoserTree:
    """Merges sorted runs.  Each node holds a loser and the length of the prefix
    it shares with the winner that passed it.  The next suffix of a run comes
    with the prefix it shares with the one just given out, which is the winner
    that all losers on its path lost to: of two different lengths the longer
    wins unread, and with equal ones the comparison begins after them."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.at = [0] * len(runs)
        k = len(runs)
        self.node: list[tuple[int, int]] = [(-1, 0)] * max(1, k)
        self.top = (-1, 0)
        for i in range(k):
            self._play(i, 0, building=True)

    def _head(self, i: int) -> bytes | None:
        r = self.runs[i]
        return r.suffixes[self.at[i]] if self.at[i] < len(r.suffixes) else None

    def _play(self, i: int, known: int, building: bool = False) -> None:
        at = (i + len(self.runs)) // 2
        node = self.node
        mine = self._head(i)
        while at >= 1:
            j, theirs = node[at]
            if j < 0 and building:
                node[at] = (i, known)
                return
            other = self._head(j)
            if other is not None:
                if mine is None or theirs > known and not building:
                    node[at], i, known, mine = (i, known), j, theirs, other
                elif building or theirs == known:
                    both = shared_prefix(mine, other, 0 if building else known)
                    if both == len(other) if both == len(mine) else False:
                        swap = j < i
                    else:
                        swap = both == len(other) or both < len(mine) and other[both] < mine[both]
                    if swap:
                        node[at], i, known, mine = (i, both), j, theirs, other
                    else:
                        node[at] = (j, both)
            at //= 2
        self.top = (i, known)

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """Run, place in it, and the prefix shared with the suffix before."""
        while self.top[0] >= 0 and self._head(self.top[0]) is not None:
            i, known = self.top
            yield i, self.at[i], known
            self.at[i] += 1
            r = self.runs[i]
            self._play(i, r.prefixes[self.at[i]] if self.at[i] < len(r.prefixes) else 0)


SPANS = "doc long, start int, stop int"


def _merge(table: pa.Table) -> pa.Table:
    """Merge a bucket's runs and settle the strings of neighbours that share an
    anchor's gram; returns what earlier strings cover."""
    runs, passed = [], []
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("data")):
        raw = blob.as_buffer().to_pybytes()
        if kind == 0:
            runs.append(Run(raw))
        else:
            passed.append(np.frombuffer(raw, np.int64).reshape(-1, 3))
    out = [*passed, np.zeros((0, 3), np.int64)]
    if runs:
        merged = list(PrefixLoserTree(runs))
        run, place, shared = np.array(merged, np.int64).T
        group = np.cumsum(shared < GRAM)
        sizes = np.bincount(group)
        base = np.concatenate([[0], np.cumsum([len(r.size) for r in runs])])
        entry = base[run] + place
        doc, pos, least = (np.concatenate([getattr(r, c) for r in runs]).astype(np.int64)[entry] for c in ("doc", "pos", "least"))
        suffixes, left = [x for r in runs for x in r.suffixes], [x for r in runs for x in r.left]
        # whole groups at a time, some ten thousand suffixes together
        several = np.flatnonzero(sizes[group] > 1)
        at = 0
        while at < len(several):
            end = min(at + 10_000, len(several))
            while end < len(several) and group[several[end]] == group[several[end - 1]]:
                end += 1
            some = several[at:end]
            length = np.fromiter((len(suffixes[i]) for i in entry[some]), np.int64, len(some))
            out.append(_settle(shared[some], length, [left[i] for i in entry[some]], least[some], doc[some], pos[some]))
            at = end
    spans = np.concatenate(out)
    return pa.table({"doc": pa.array(spans[:, 0]), "start": pa.array(spans[:, 1].astype(np.int32)), "stop": pa.array(spans[:, 2].astype(np.int32))})


def _settle(shared: np.ndarray, n_right: np.ndarray, left: list[bytes], least: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The strings of suffixes, in merged order, that also start earlier, as spans.
    ``shared`` is the prefix that each shares with the one before it."""
    m = len(left)
    back = [x[::-1] for x in left]
    n_left = np.fromiter(map(len, back), np.int64, m)
    by_left = np.array(sorted(range(m), key=back.__getitem__))
    common = _common_prefixes([back[i] for i in by_left])
    keys, entries, befores = [], [], []
    side = np.empty(m, np.int64)
    for before in range(BEFORE + 1):
        own = np.flatnonzero((least <= before) & (before <= n_left) & (n_right >= LENGTH - before))
        if len(own):
            # neighbours are equal as far as needed where the prefix they share is that long
            side[by_left] = np.cumsum(common < before)
            behind = np.cumsum(shared < LENGTH - before)
            keys.append((behind[own] * (m + 1) + side[own]) * (BEFORE + 1) + before)
            entries.append(own)
            befores.append(np.full(len(own), before))
    if not keys:
        return np.zeros((0, 3), np.int64)
    key, entry, before = map(np.concatenate, (keys, entries, befores))
    turn = np.empty(m, np.int64)
    turn[np.lexsort((pos, doc))] = np.arange(m)
    # the first of equal strings, by document and position, stays
    by = np.lexsort((turn[entry], key))
    copy = np.zeros(len(key), bool)
    copy[by[1:]] = key[by[1:]] == key[by[:-1]]
    entry, start = entry[copy], pos[entry[copy]] - before[copy]
    return _spans(doc[entry], start)


def _common_prefixes(ordered: list[bytes]) -> np.ndarray:
    """How much each string (of at most ``BEFORE`` bytes) shares with the one before."""
    m = len(ordered)
    size = np.fromiter(map(len, ordered), np.int64, m)
    table = np.zeros((m, BEFORE + 1), np.uint8)
    table[np.arange(BEFORE + 1)[None, :] < size[:, None]] = np.frombuffer(b"".join(ordered), np.uint8)
    out = np.zeros(m, np.int64)
    if m > 1:
        differ = table[1:] != table[:-1]
        differ[:, BEFORE] = True
        out[1:] = np.minimum(np.argmax(differ, axis=1), np.minimum(size[1:], size[:-1]))
    return out


def _spans(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Strings that start one after another, as one span each."""
    if not len(doc):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)]))
    last = np.append(new[1:], len(doc)) - 1
    return np.stack([doc[new], start[new], start[last] + LENGTH], 1)


def _runs(marked: DataFrame, buckets: int) -> DataFrame:
    """Sorted runs of the suffixes at marked anchors (kind 0), and the spans of
    strings that are settled within a task (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pool, seen, done = Suffixes(), {}, []
        forget()
        turn = TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal pool, seen, done
            for key, (bucket, row) in seen.items():
                pool.rows.append((bucket, *row))
            rows = pool.blobs()
            if done:
                spans = np.concatenate(done)
                rows += [((turn + i) % buckets, 1, spans[i * 50_000:(i + 1) * 50_000].tobytes()) for i in range(-(-len(spans) // 50_000))]
            pool, seen, done = Suffixes(), {}, []
            if rows:
                yield _routed(rows)

        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                data, offsets = text_bytes(batch.column("_text"))
                place, lo, hi, gram = anchors(data, offsets)
                lists = batch.column("pos")
                borders = lists.offsets.to_numpy()
                marks = np.repeat(offsets[:-1], np.diff(borders)) + lists.flatten().to_numpy()
                order = np.argsort(marks)
                marks, hot = marks[order], batch.column("hot").flatten().to_numpy(zero_copy_only=False)[order]
                at = np.searchsorted(marks, place)
                hit = at < len(marks)
                hit[hit] = marks[at[hit]] == place[hit]
                place, lo, hi, gram, hot = place[hit], lo[hit], hi[hit], gram[hit], hot[at[hit]]
                if not len(place):
                    continue
                owner = np.searchsorted(offsets, place, "right") - 1
                ids = batch.column("_id").to_numpy()
                raw, text = data.tobytes(), offsets.tolist()
                sums = prefix_sums(data)
                # around equal anchors in equal surroundings only the earliest is sent
                around = stretch_hash(sums, lo, hi + LENGTH) ^ mix((place - lo).astype(np.uint64))
                settled = []
                for a, s, e, g, h, o, key in zip(place.tolist(), lo.tolist(), hi.tolist(), gram.tolist(), hot.tolist(), owner.tolist(), around.tolist()):
                    doc, base = int(ids[o]), text[o]
                    if not h:
                        row = (raw[a:min(e + LENGTH, text[o + 1])], raw[s:a], a - e if a > e else 0, doc, a - base)
                        _earliest(seen, settled, key, g % buckets, row, a - s, e - s)
                        continue
                    each = stretch_hash(sums, np.arange(s, e + 1), np.arange(s, e + 1) + LENGTH).tolist()
                    for p, own in zip(range(s, e + 1), each):
                        row = (raw[p:p + LENGTH], b"", 0, doc, p - base)
                        _earliest(seen, settled, ~own, own % buckets, row, 0, 0)
                if settled:
                    done.append(np.array(settled, np.int64))
                if len(seen) >= RUN:
                    yield from flush()
        yield from flush()

    return marked.mapInArrow(run, ROUTED)


def _earliest(seen: dict, settled: list, key: int, bucket: int, row: tuple, before: int, more: int) -> None:
    """Keep the earlier of equal suffixes; the later one's strings are copies."""
    other = seen.get(key)
    if other is not None and other[1][:3] != row[:3]:      # equal hashes of different bytes
        key = (key, *row[:3])
        other = seen.get(key)
    if other is None:
        seen[key] = (bucket, row)
        return
    later = row
    if row[3:] < other[1][3:]:
        seen[key] = (bucket, row)
        later = other[1]
    settled.append((later[3], later[4] - before, later[4] - before + more + LENGTH))


def remove_repeats(docs: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None,
                   hot: int = HOT) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, spans`` per document;
    ``spans`` are the removed byte ranges."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    each = work.table(src.select("_id", F.octet_length("_text").cast("long").alias("n"), F.sha2("_text", 256).alias("sha")), "documents")
    buckets = buckets or max(BUCKETS, -(-(each.agg(F.sum("n")).first()[0] or 0) // BUCKET_BYTES))
    # documents with a place in the order, and the first of equal texts
    known = work.table(each.filter("_id is not null").groupBy("_id").agg(F.min("sha").alias("sha"), F.max("sha").alias("_other"), F.max("n").alias("n")), "known")
    # only texts that several documents have, stored: broadcast, or joined where one large group can be split
    firsts = work.table(known.filter("sha = _other").groupBy("sha", "n").agg(F.min("_id").alias("first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "firsts")
    placed = work.table(known.withColumn("placed", F.col("sha") == F.col("_other")).join(firsts, ["sha", "n"], "left").select(
        "_id", "placed", F.coalesce(F.col("placed") & (F.col("_id") > F.col("first")) & (F.col("n") >= LENGTH), F.lit(False)).alias("copy")), "placed")

    found = _grams(src.filter(F.col("_id").isNotNull() & (F.octet_length("_text") >= LENGTH)), buckets)
    found = work.table(found.groupBy("bucket").applyInArrow(_repeated(buckets, hot), REPEATED), "repeated")
    often = found.filter("kind = 9").select("gram", F.lit(True).alias("_hot")).distinct()
    marks = (found.filter("kind = 0").join(often, "gram", "left").join(placed.filter("placed and not copy").select(F.col("_id").alias("doc")), "doc")
             .groupBy("doc").agg(F.collect_list(F.struct("pos", F.coalesce("_hot", F.lit(False)).alias("hot"))).alias("m"))
             .select(F.col("doc").alias("_id"), F.col("m.pos").alias("pos"), F.col("m.hot").alias("hot")))
    marks = work.table(marks, "marks")
    marked = _texts_of(src, marks).dropDuplicates(["_id"])
    spans = _runs(marked, buckets).groupBy("bucket").applyInArrow(_merge, SPANS)
    spans = work.table(spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
                       .select(F.col("doc").alias("_id"), "spans"), "spans")
    cut = work.table(_cut(_texts_of(src, spans).dropDuplicates(["_id"])), "cut")

    none = hashlib.sha256(b"").hexdigest()
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("stop")))
    out = each.join(placed, "_id", "left").join(cut, "_id", "left")
    copy = F.coalesce("copy", F.lit(False))
    return out.select(
        F.col("_id").alias(id_col), F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(none)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<start: int, stop: int>>)"))).alias("spans"))


def _texts_of(src: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts that ``rows`` (by ``_id``) need, with its columns: the ids alone
    are broadcast where they are few enough, so other texts are not shuffled."""
    ids = rows.select("_id")
    if ids.count() <= BROADCAST_IDS:
        src = src.join(F.broadcast(ids), "_id", "left_semi")
    return src.hint("merge").join(rows, "_id")


def _cut(found: DataFrame) -> DataFrame:
    """Unite the spans of each text and hash what is left of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                removed, kept, united = [], [], []
                for text, spans in zip(batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                    pieces: list[list[int]] = []
                    for s in spans:
                        if pieces and s["start"] <= pieces[-1][1]:
                            pieces[-1][1] = max(pieces[-1][1], s["stop"])
                        else:
                            pieces.append([s["start"], s["stop"]])
                    digest, last = hashlib.sha256(), 0
                    for start, stop in pieces:
                        digest.update(text[last:start])
                        last = stop
                    digest.update(text[last:])
                    removed.append(sum(b - a for a, b in pieces))
                    kept.append(digest.hexdigest())
                    united.append([tuple(x) for x in pieces])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array(removed, pa.int64()), pa.array(kept),
                     pa.array(united, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["_id", "removed", "kept", "spans"])

    return found.select("_id", "_text", "spans").mapInArrow(run, "_id long, removed long, kept string, spans array<struct<start: int, stop: int>>")
