"""WARC archives with an externally merged capture index.

Writing: identical payloads are found by digest, each task writes its pages as
one archive of gzip members into the shared folder and the records' places,
sorted by URL key, timestamp and page, as one run file beside it.  Merging:
ranges of that key are cut from samples of the runs; the task of a range streams
its stretch of every run file, a row group at a time, and combines the stretches
with a loser tree, so the concatenated ranges are one globally ordered capture
history.  At most ``FAN_IN`` runs are merged at once: more go through rounds that
write longer runs.  A merging task holds a row group of each of its runs, whatever
the size of the index.  Reading goes through that index.

Archives and runs are written under names no other attempt uses, and only those
that a finished task returned are read, so a lost executor leaves at most unread
files.

Defined cases: a NULL payload is empty; a NULL URL has no target line and the
empty key; a NULL page id is written as ``-``, read as NULL and never referred
to, and such a page revisits a record of the same payload that has an id.  Of
rows with the smallest id of a payload all are responses.  An empty table gives
no archive and no captures.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta, timezone
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.llm.shared import Workspace, attempt_name, filesystem, join_path, slices

#: Smaller payloads are always stored.
MIN_REVISIT = 100
#: Runs that are merged at once, rows of a run file's row group, rows that a range
#: aims at, and rows for which a run gives one key to choose the ranges by.
FAN_IN = 64
GROUP_ROWS = 4096
RANGE_ROWS = 1_000_000
SAMPLED = 16_384

# Fixed values of the file format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


class LoserTree:
    """Merges sorted iterators.  Inner nodes hold the losers of past matches, so
    taking the next item replays one path of log2(k) matches."""

    def __init__(self, runs: Iterable[Iterable], key: Callable[[Any], Any]):
        self.key = key
        self.runs = [iter(r) for r in runs]
        k = max(1, len(self.runs))
        self.heads: list = [self._next(i) for i in range(len(self.runs))]
        self.losers = [-1] * k
        self.winner = -1
        for i in range(len(self.runs)):
            self._enter(i, building=True)

    def _next(self, i: int):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and x[:2] < y[:2]

    def _enter(self, i: int, building: bool = False) -> None:
        node = (i + len(self.losers)) // 2
        while node >= 1:
            other = self.losers[node]
            if building and other < 0:
                self.losers[node] = i
                return
            if not self._beats(i, other):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][2]
            self.heads[i] = self._next(i)
            self._enter(i)


def url_key(url: str | None) -> str:
    """The sortable form of a URL: host labels reversed, then path and query,
    without scheme, user, fragment, ``www`` and default ports."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.lower()
    labels = host.removeprefix("www.").split(".")
    key = ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")"
    return key + (parts.path.lower() or "/") + (f"?{parts.query.lower()}" if parts.query else "")


def record(kind: str, page_id: int | None, url: str | None, date: str, digest: str, payload: bytes,
           refers_to: int | None) -> bytes:
    """One WARC record, as a gzip member."""
    name = "-" if page_id is None else str(page_id)
    block = HTTP_HEAD % len(payload) + payload if kind == "response" else HTTP_HEAD % 0
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress(VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header lines and payload of one gzip member."""
    raw = zlib.decompress(member, wbits=31)
    if not raw.startswith(VERSION):
        raise ValueError("not a WARC record")
    head, _, rest = raw[len(VERSION):].partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _page_of(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "-" else int(value)


_EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)
_EPOCH_MICROS = int(_EPOCH.timestamp()) * 1_000_000
CAPTURE = ("url_key string, captured timestamp, page_id long, record_type string, refers_to long, "
           "file string, offset long, length int, run string")
#: The order of captures: URL key, time in microseconds, pages without an id first, run, offset.
KEY = "u: string, t: long, h: int, p: long, r: string, o: long"
MANIFEST = f"run long, seq long, file string, n long, lo struct<{KEY}>, hi struct<{KEY}>, keys array<struct<{KEY}>>"

_RUN_FILE = pa.schema([("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                       ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int32()), ("run", pa.string())])
_KEY_TYPE = pa.struct([("u", pa.string()), ("t", pa.int64()), ("h", pa.int32()), ("p", pa.int64()), ("r", pa.string()), ("o", pa.int64())])


def _key(c: tuple) -> tuple:
    """The key of a row of a run file."""
    return c[0], c[1], int(c[2] is not None), c[2] or 0, c[8], c[6]


class _RunWriter:
    """Writes sorted captures as a run file and keeps what the manifest says."""

    def __init__(self, folder: str):
        self.fs, path = filesystem(folder)
        name = attempt_name("run", ".parquet")
        self.file, self.path = join_path(folder, name), join_path(path, name)
        self.out, self.held, self.n, self.keys, self.last = None, [], 0, [], None

    def add(self, row: tuple) -> None:
        if self.n % SAMPLED == 0:
            self.keys.append(_key(row))
        self.held.append(row)
        self.n, self.last = self.n + 1, row
        if len(self.held) == GROUP_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.out = self.out or pq.ParquetWriter(self.path, _RUN_FILE, filesystem=self.fs, compression="zstd")
            self.out.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.held), _RUN_FILE)], schema=_RUN_FILE))
            self.held = []

    def close(self, run: int, seq: int) -> Iterator[pa.RecordBatch]:
        """The manifest row, if anything was written."""
        self._flush()
        if self.out is not None:
            self.out.close()
            named = [dict(zip("uthpro", k)) for k in (self.keys[0], _key(self.last), *self.keys)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([run]), pa.array([seq]), pa.array([self.file]), pa.array([self.n]), pa.array(named[:1], _KEY_TYPE), pa.array(named[1:2], _KEY_TYPE),
                 pa.array([named[2:]], pa.list_(_KEY_TYPE))], names=["run", "seq", "file", "n", "lo", "hi", "keys"])


def _stretch(files: list[str], lo: tuple | None, hi: tuple | None) -> Iterator[tuple[tuple, tuple]]:
    """Keys and rows of one run from ``lo`` on and before ``hi``, a row group at a
    time; row groups outside are not read."""
    for file in files:
        fs, path = filesystem(file)
        with pq.ParquetFile(path, filesystem=fs) as f:
            for g in range(f.num_row_groups):
                told = f.metadata.row_group(g).column(0).statistics
                if told is not None and told.has_min_max:
                    if lo is not None and told.max < lo[0]:
                        continue
                    if hi is not None and told.min > hi[0]:
                        return
                for row in zip(*(c.to_pylist() for c in f.read_row_group(g).columns)):
                    key = _key(row)
                    if hi is not None and key >= hi:
                        return
                    if lo is None or key >= lo:
                        yield key, row


def write_archives(pages: DataFrame, work: Workspace, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", captured: Column | None = None) -> DataFrame:
    """Write a record per page; returns the manifest of the sorted runs (one per
    task), for ``merge_runs``.

    ``captured`` gives the capture times; without it a page's id counts seconds
    from the year 2000 (a NULL id: 0).
    """
    spark = pages.sparkSession
    when = captured if captured is not None else F.timestamp_seconds(F.lit(int(_EPOCH.timestamp())) + F.coalesce(F.col(f"`{id_col}`").cast("long") % F.lit(1 << 31), F.lit(0)))
    src = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"), when.alias("_when"),
        F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("_payload"),
    ).withColumn("_digest", F.sha2("_payload", 256))
    # one row for each payload that occurs again; pre-aggregated before the exchange
    firsts = (src.filter(F.length("_payload") >= MIN_REVISIT).groupBy("_digest")
              .agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    # stored, so Spark knows their size: they are broadcast, or the pages of a
    # frequent payload are split between tasks
    marked = src.join(work.table(firsts, "repeated"), "_digest", "left").select(
        "_id", "_url", "_when", "_digest", "_payload",
        F.when(F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("_refers"))
    folder, runs = work.folder("archives"), work.folder("runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, path = filesystem(folder)
        name = attempt_name("pages", ".warc.gz")
        out, at, places = None, 0, []
        for whole in batches:
            for batch in slices(whole, "_payload"):
                for r in batch.to_pylist():
                    kind = "response" if r["_refers"] is None else "revisit"
                    date = r["_when"].astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
                    member = record(kind, r["_id"], r["_url"], date, r["_digest"], r["_payload"], r["_refers"])
                    out = out or fs.open_output_stream(join_path(path, name), compression=None)
                    out.write(member)
                    micros = (r["_when"].astimezone(timezone.utc) - _EPOCH) // timedelta(microseconds=1)
                    places.append((url_key(r["_url"]), micros, r["_id"], kind, r["_refers"], join_path(folder, name), at, len(member), name))
                    at += len(member)
        if out is not None:
            out.close()
            places.sort(key=_key)
            written = _RunWriter(runs)
            for place in places:
                written.add(place)
            yield from written.close(TaskContext.get().partitionId(), 0)

    return work.table(marked.mapInArrow(run, MANIFEST), "runs")


def _ranges(pieces: DataFrame) -> DataFrame:
    """``group, part, lo, hi, pieces``: the ranges of every group of runs, and the
    files that reach into each.  Only keys that the runs sampled, one for
    ``SAMPLED`` rows, are ordered."""
    sizes = pieces.groupBy("group").agg(F.ceil(F.sum("n") / F.lit(RANGE_ROWS)).alias("_parts"))
    keys = pieces.select("group", F.explode("keys").alias("k")).join(sizes, "group")
    place = F.row_number().over(Window.partitionBy("group").orderBy("k")) - 1
    share = F.floor(place * F.col("_parts") / F.count("*").over(Window.partitionBy("group")))
    begins = keys.withColumn("_share", share).groupBy("group", "_share").agg(F.min("k").alias("k"))
    by_key = Window.partitionBy("group").orderBy("k")
    begins = begins.select("group", "k", (F.row_number().over(by_key) - 1).alias("part"))
    ranges = begins.select("group", "part", F.when(F.col("part") > 0, F.col("k")).alias("lo"), F.lead("k").over(by_key).alias("hi"))
    # the range in which each file begins and ends: that of the last begin up to its key
    marks = begins.select("group", "k", F.lit(0).alias("kind"), "part", F.lit(None).cast("string").alias("file")).unionByName(
        pieces.select("group", F.inline(F.array(F.struct(F.col("lo").alias("k"), F.lit(1).alias("kind")), F.struct(F.col("hi").alias("k"), F.lit(2).alias("kind")))), "file")
        .withColumn("part", F.lit(None).cast("int")))
    met = F.last("part", ignorenulls=True).over(Window.partitionBy("group").orderBy("k", "kind"))
    reach = (marks.withColumn("_part", F.coalesce(met, F.lit(0))).filter("kind > 0").groupBy("group", "file")
             .agg(F.min("_part").alias("_a"), F.max("_part").alias("_b")))
    within = reach.select("group", "file", F.explode(F.sequence("_a", "_b")).alias("part")).join(pieces.select("group", "file", "run", "seq"), ["group", "file"])
    files = within.groupBy("group", "part").agg(F.array_sort(F.collect_list(F.struct("run", "seq", "file"))).alias("pieces"))
    return ranges.join(files, ["group", "part"])


def _merged(row: dict) -> Iterator[tuple]:
    """The captures of a range in order."""
    lo, hi = (None if row[c] is None else tuple(row[c][x] for x in "uthpro") for c in ("lo", "hi"))
    runs: dict[int, list[str]] = {}
    for piece in row["pieces"]:
        runs.setdefault(piece["run"], []).append(piece["file"])
    for _, capture in LoserTree([_stretch(files, lo, hi) for files in runs.values()], lambda x: x[0]):
        yield capture


def merge_runs(runs: DataFrame, work: Workspace) -> DataFrame:
    """The capture history in global order: ranges follow one another by key, rows
    in a range are sorted.  ``capture`` numbers the rows of a range, ``part`` the
    ranges."""
    pieces = runs
    folder = work.folder("merged")

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                written = _RunWriter(folder)
                for capture in _merged(row):
                    written.add(capture)
                yield from written.close(row["group"], row["part"])

    def history(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*held), _RUN_FILE)]
            columns[1] = columns[1].cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
            return pa.RecordBatch.from_arrays([*columns, pa.array([row["part"]] * len(held), pa.int32()), pa.array(range(n, n + len(held)), pa.int64())],
                                              names=[*_RUN_FILE.names, "part", "capture"])

        for batch in batches:
            for row in batch.to_pylist():
                held, n = [], 0
                for capture in _merged(row):
                    held.append((capture[0], capture[1] + _EPOCH_MICROS, *capture[2:]))
                    if len(held) == GROUP_ROWS:
                        yield flush()
                        n, held = n + len(held), []
                if held:
                    yield flush()

    while (last := pieces.agg(F.max("run")).first()[0]) is not None and last >= FAN_IN:
        grouped = work.table(_ranges(pieces.withColumn("group", F.expr(f"run div {FAN_IN}"))), "ranges")
        pieces = work.table(_each_alone(grouped).mapInArrow(longer, MANIFEST), "runs")
    ranges = work.table(_ranges(pieces.withColumn("group", F.lit(0).cast("long"))), "ranges")
    return work.table(_each_alone(ranges).mapInArrow(history, CAPTURE + ", part int, capture long"), "captures")


def _each_alone(ranges: DataFrame) -> DataFrame:
    """As many partitions as ranges: adaptive execution would join such short rows."""
    return ranges.repartition(max(1, ranges.count()), "group", "part")


def read_archives(captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read the records at the index's places: ``page_id, record_type,
    refers_to, stored_bytes, stored_digest, header_digest`` and, if asked for,
    ``payload``.  A batch reads each file's places in ascending order."""
    schema = ("page_id long, record_type string, refers_to long, stored_bytes long, stored_digest string, "
              "header_digest string" + ", payload binary" * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                by_file.setdefault(file, []).append((offset, length))
            for file, places in by_file.items():
                fs, path = filesystem(file)
                rows, size = [], 0
                with fs.open_input_file(path) as f:
                    for offset, length in sorted(places):
                        fields, payload = parse(f.read_at(length, offset))
                        rows.append((_page_of(fields["WARC-Record-ID"]), fields["WARC-Type"],
                                     _page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
                                     len(payload), hashlib.sha256(payload).hexdigest(),
                                     fields["WARC-Payload-Digest"].removeprefix("sha256:"), payload)[:6 + with_payload])
                        size += len(payload) * with_payload
                        if size > 8 << 20 or len(rows) >= 10_000:
                            yield _read_batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _read_batch(rows)

    return captures.select("file", "offset", "length").mapInArrow(run, schema)


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["page_id", "record_type", "refers_to", "stored_bytes", "stored_digest", "header_digest", "payload"]
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names[:len(cols)])


def resolve_revisits(records: DataFrame, work: Workspace | None = None) -> DataFrame:
    """Give each record the size and digest of its full payload: its own, or
    for a revisit those read from the response it refers to.  ``verified`` tells
    whether that digest is the one in the record's header.

    Only responses that are referred to are looked up; with ``work`` they are
    stored first, so Spark broadcasts them, or splits the revisits of one response.
    """
    named = records.filter("record_type = 'revisit'").select("refers_to", "header_digest").distinct()
    full = (records.filter("record_type = 'response' and page_id is not null")
            .select(F.col("page_id").alias("refers_to"), F.col("stored_digest").alias("header_digest"), "stored_bytes")
            .join(named, ["refers_to", "header_digest"], "left_semi")
            .groupBy("refers_to", "header_digest").agg(F.max("stored_bytes").alias("_bytes")))
    full = work.table(full, "referred") if work is not None else full
    return records.join(full, ["refers_to", "header_digest"], "left").select(
        "page_id",
        F.when(F.col("record_type") == "revisit", F.col("_bytes")).otherwise(F.col("stored_bytes")).alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.when(F.col("_bytes").isNotNull(), F.col("header_digest"))).otherwise(F.col("stored_digest")).alias("payload_digest"),
        "record_type", "refers_to",
        F.when(F.col("record_type") == "revisit", F.col("_bytes").isNotNull()).otherwise(F.col("stored_digest") == F.col("header_digest")).alias("verified"))
