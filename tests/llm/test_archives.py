"""Archives: round trip, global order of the merged index, defined cases."""

import gzip
import hashlib
import random

import pytest

from residuum.llm import warc
from residuum.llm.shared import filesystem
from residuum.llm.warc import LoserTree, merge_runs, parse, read_archives, record, resolve_revisits, url_key, write_archives

PAGES = "page_id long, url string, html string"


def rows():
    rng = random.Random(1)
    same, small = "<p>" + "x" * 200, "<p>tiny"
    out = [(i, f"http://{'www.' * (i % 2)}site{rng.randrange(5)}.example.org:{80 + i % 3}/p{rng.randrange(9)}?q={i}#f", f"<html>{i} é {'y' * rng.randrange(400)}") for i in range(60)]
    out += [(100 + i, "https://a.b/c", same) for i in range(5)] + [(200 + i, None, small) for i in range(3)]
    out += [(300, "http://x/\r\nEvil: 1", None), (301, "", ""), (302, "not a url", "z" * 99), (303, "http://[bad", "z" * 99), (304, "http://u/", "z" * 100), (305, "http://u/", "z" * 100),
            (306, "http://u/long", "long " * 400_000)]
    rng.shuffle(out)
    return out


def expected(data):
    first = {}
    for page, _, html in data:
        b = (html or "").encode()
        if len(b) >= 100 and page is not None:
            first[b] = min(first.get(b, page), page)
    out = []
    for page, _, html in data:
        b = (html or "").encode()
        revisit = b in first and page != first[b]
        out.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def run(spark, work, data):
    captures = merge_runs(write_archives(spark.createDataFrame(data, PAGES).repartition(4), work), work)
    return captures, resolve_revisits(work.table(read_archives(captures), "records"))


def test_round_trip(spark, work):
    data = rows()
    captures, pages = run(spark, work, data)
    assert got(pages) == expected(data) and pages.filter("not verified").count() == 0
    order = [(r.url_key, r.captured, r.page_id) for r in captures.orderBy("part", "capture").collect()]
    assert order == sorted(order) and len(order) == len(data)


@pytest.mark.parametrize("fan_in,range_rows,sampled,group_rows", [(2, 7, 2, 3), (3, 10**6, 5, 4), (64, 5, 1, 2)])
def test_merging_in_rounds_and_ranges(spark, work, monkeypatch, fan_in, range_rows, sampled, group_rows):
    for name, value in (("FAN_IN", fan_in), ("RANGE_ROWS", range_rows), ("SAMPLED", sampled), ("GROUP_ROWS", group_rows)):
        monkeypatch.setattr(warc, name, value)
    data = rows() + [(400 + i, "http://same/", f"{i}" * 30) for i in range(60)] + [(None, None, "n" * 120)] * 5   # a key that most rows have
    runs = write_archives(spark.createDataFrame(data, PAGES).repartition(9), work)
    assert runs.count() == 9
    captures = merge_runs(runs, work)
    got_rows = captures.orderBy("part", "capture").collect()
    key = lambda r: (r.url_key, r.captured, r.page_id is not None, r.page_id or 0, r.run, r.offset)
    assert [key(r) for r in got_rows] == sorted(key(r) for r in got_rows) and len({(r.run, r.offset) for r in got_rows}) == len(data)
    assert len({r.part for r in got_rows}) > 5 if range_rows < 100 else len({r.part for r in got_rows}) == 1
    assert [r.capture for r in got_rows if r.part == 0] == list(range(sum(r.part == 0 for r in got_rows)))
    assert got(resolve_revisits(work.table(read_archives(captures), "r"), work)) == expected(data)


def test_a_merging_task_holds_a_row_group_of_each_run(spark, work, monkeypatch):
    monkeypatch.setattr(warc, "GROUP_ROWS", 10)
    folder = work.folder("streams")
    files = []
    for k in range(4):
        out = warc._RunWriter(folder)
        for i in range(200):
            out.add((f"key{i:05d}", k, i, "response", None, "f", i, 1, f"run{k}"))
        files.append(list(out.close(k, 0))[0].to_pylist()[0]["file"])
    read = []
    whole = warc.pq.ParquetFile.read_row_group
    monkeypatch.setattr(warc.pq.ParquetFile, "read_row_group", lambda self, g, **k: read.append(g) or whole(self, g, **k))
    lo, hi = ("key00095", 0, 0, 0, "", 0), ("key00125", 0, 0, 0, "", 0)
    merged = LoserTree([warc._stretch([f], lo, hi) for f in files], lambda x: x[0])
    assert len(read) == 4                                   # one row group of each run so far
    assert [k[0] for k, _ in merged] == [f"key{i:05d}" for i in range(95, 125) for _ in range(4)]
    assert sorted(set(read)) == [9, 10, 11, 12] and len(read) == 16


def test_archives_are_plain_gzip_members(spark, work):
    data = rows()[:20]
    captures = merge_runs(write_archives(spark.createDataFrame(data, PAGES), work), work)
    for file in {r.file for r in captures.collect()}:
        fs, path = filesystem(file)
        with fs.open_input_file(path) as f:
            raw = gzip.decompress(f.read())
        assert raw.startswith(b"WARC/1.1\r\n") and raw.count(b"WARC/1.1\r\n") == captures.filter(captures.file == file).count()


def test_payloads_come_back(spark, work):
    data = rows()
    captures, _ = run(spark, work, data)
    html = {p: (h or "").encode() for p, _, h in data}
    for r in read_archives(captures, with_payload=True).collect():
        assert bytes(r.payload) == (html[r.page_id] if r.record_type == "response" else b"")


def test_nulls_and_repeated_rows(spark, work):
    big = "b" * 150
    data = [(None, "http://a/", big), (7, "http://a/", big), (7, "http://a/", big), (9, "http://a/", big), (None, "http://b/", "c" * 150), (None, None, None)]
    _, pages = run(spark, work, data)
    assert got(pages) == expected(data)


def test_empty(spark, work):
    captures, pages = run(spark, work, rows()[:1])
    none = merge_runs(write_archives(spark.createDataFrame([], PAGES), work), work)
    assert none.count() == 0 and resolve_revisits(read_archives(none)).count() == 0 and pages.count() == 1


def test_clashing_names(spark, work):
    from .conftest import clashing

    data = rows()[:15]
    pages = clashing(spark.createDataFrame(data, PAGES))
    assert got(resolve_revisits(work.table(read_archives(merge_runs(write_archives(pages, work), work)), "r"))) == expected(data)


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 20))) for _ in range(k)]
        assert list(LoserTree(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_record_and_key():
    fields, payload = parse(record("response", 5, "http://a/\nb", "2020-01-01T00:00:00Z", "ff", b"\r\n\r\nbody", None))
    assert payload == b"\r\n\r\nbody" and fields["WARC-Target-URI"] == "http://a/%0Ab"
    assert url_key("https://www.Example.COM:443/A?B=1#c") == "com,example)/a?b=1" and url_key(None) == "" and url_key("http://h:81") == "h:81)/"
