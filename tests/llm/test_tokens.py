"""Token files and prefix counts against the library."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from residuum.llm import words as W
from residuum.llm.prefix_counts import PrefixCounter, bytes_within, prefix_table, token_counts, tokens_before
from residuum.llm.queries import vocabulary_path
from residuum.llm.shared import filesystem
from residuum.llm.token_files import read_token_files, token_lists, write_token_files

from .conftest import clashing, documents, words

ODD = ["áb Σas ΟΔΥΣΣΕΥΣ don't I'LL x'ReY <|endoftext|> foo<|startoftext|>bar  \t é é İstanbul ŁĄ 12a4 ... ,,! ab cd \x1c x\x85y ﬁ ² 日本語 👨‍👩‍👧 <|ENDOFTEXT|> H̱ ẖ H.̱",
       "", " ", "\n\n", "a\n'\ns", "'s 's'", "word,'s x!'re", None, "A.", "Ab, c.. D,.", "x" * 500, "aab" * 100, "e.g. i.e., U.S.A. 3.14, end."]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def rows():
    rng = random.Random(2)
    return list(enumerate(ODD + [words(rng, 50).title() for _ in range(20)] + ["the quick brown fox, " * 20_000]))


def test_files_equal_the_library(spark, work, library):
    data = rows()
    manifest = write_token_files(clashing(documents(spark, data)), work, vocabulary_path(), 2, group_tokens=300)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(manifest).collect()}
    start = 0
    for doc, text in data:
        ids = [*library(text), 2]
        assert got[doc] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    lists = {r.doc_id: r.ids for r in token_lists(manifest).collect()}
    assert lists[9] == [*library(data[9][1]), 2]
    counts = read_token_files(manifest, columns=()).collect()
    assert {r.doc_id: (r.start, r.n_tokens) for r in counts} == {k: v[:2] for k, v in got.items()}


def test_files_are_read_by_many_tasks(spark, work, library):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # one id for half of the rows, none for a quarter
        data = [(7 if i % 2 else None if i % 4 else i, f"text number {i % 500}") for i in range(2000)]
        manifest = write_token_files(documents(spark, data), work, vocabulary_path(), 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = manifest.collect()
    assert len(files) >= 30 and max(f.n_docs for f in files) <= 300
    back = read_token_files(manifest)
    assert back.rdd.getNumPartitions() == len(files)
    assert back.withColumn("p", F.spark_partition_id()).select("p").distinct().count() >= 15
    assert back.agg(F.sum("n_tokens")).first()[0] == sum(len(library(t)) + 1 for _, t in data) and back.count() == 2000
    starts = sorted((r.start, r.n_tokens) for r in back.collect())
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_file_format(spark, work):
    manifest = write_token_files(documents(spark, rows()), work, vocabulary_path(), 2, group_tokens=300)
    row = max(manifest.collect(), key=lambda r: r.n_tokens)
    fs, path = filesystem(row.file)
    with pq.ParquetFile(path, filesystem=fs) as f:
        meta = f.metadata
        assert meta.num_row_groups >= 1
        ids = meta.row_group(0).column(2)
        assert any("DICTIONARY" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in meta.row_group(0).column(0).encodings
        assert ids.has_offset_index and ids.has_column_index


def test_cases_of_files(spark, work):
    empty = write_token_files(documents(spark, [(1, "x")]).filter("doc_id = 2"), work, vocabulary_path(), 2)
    assert empty.count() == 0 and read_token_files(empty).count() == 0 and token_lists(empty).count() == 0
    again = write_token_files(documents(spark, [(5, "b"), (None, "a"), (5, "b"), (4, None)]), type(work)(spark, "t"), vocabulary_path(), 2)
    out = sorted((r.start, r.doc_id, r.n_tokens) for r in read_token_files(again).select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "start", "n_tokens").collect())
    assert out == [(0, -1, 2), (2, 4, 1), (3, 5, 2), (5, 5, 2)]


def test_counts_equal_the_library(spark, library):
    data = rows()
    got = {r.doc_id: r for r in token_counts(clashing(documents(spark, data)), vocabulary_path(), 40).collect()}
    for doc, text in data:
        r, n = got[doc], len(library(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 40)
        kept = (text or "").encode()[:r.within_bytes].decode()
        assert len(library(kept)) == r.within_tokens <= 40
    empty = token_counts(documents(spark, [(1, "x")]).filter("doc_id = 2"), vocabulary_path(), 9)
    assert empty.count() == 0
    twice = token_counts(documents(spark, [(1, "x y"), (1, "x y"), (None, None)]), vocabulary_path(), 9)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in twice.collect()) == [(0, 0), (1, 2), (1, 2)]


def test_prefix_tables(spark, library):
    text = "Hello, the internationalization of tokens; don't stop 42 times."
    t = prefix_table(documents(spark, [(1, text), (2, None)]), vocabulary_path())
    row = t.filter("doc_id = 1").select("ends", "tokens", tokens_before(20).alias("a"), bytes_within(5).alias("b"), bytes_within(0).alias("c")).first()
    for end, n in zip(row.ends, row.tokens):
        assert len(library(text[:end])) == n
    assert row.a == len(library(text[:max(e for e in row.ends if e <= 20)])) and row.c == 0
    assert len(library(text[:row.b])) <= 5
    assert t.filter("doc_id = 2").first().ends == []


def test_every_prefix_of_a_word(library):
    counter = PrefixCounter(vocabulary_path())
    for word in ("internationalization", "thanerat", "aaaaaaaaaaaa", "zqxjkvbw"):
        assert counter.word_table(word) == [len(library(word[:i])) for i in range(1, len(word) + 1)]


UNBROKEN = ["日本語の文章は空白なしで書かれ、言葉の境は見えません。" * 4, "ภาษาไทยไม่มีช่องว่างระหว่างคำที่นี่น้ำ" * 3, "iVBORw0KGgoAAAANSUhEUgAAB9x+/TQ4w==" * 4,
            "function(a,b){return a.x!=='it'&&b['y']>=3?a:b;}" * 3, "ÀÉÎÕÜ" * 20, "e\u0301a\u0308" * 20, "\u1112\u1161\u11ab\u1100\u1173\u11af" * 12, "don'tI'LLx're" * 6,
            "foo!!<|endoftext|>bar!<|startoftext|>" * 5, "İstanbulΣΑΣ\u3000ﬁ\x85" * 8, "aab" * 60, "a" * 30 + "\u0338<|endoftext|>" * 3, "=" * 90, "👨‍👩‍👧é²12" * 10]


def test_every_prefix_of_a_piece(library):
    counter = PrefixCounter(vocabulary_path())
    for piece in [*UNBROKEN, *(p for t in ODD if t for p in t.split())]:
        want = [len(library(piece[:i])) for i in range(1, len(piece) + 1)]
        assert counter.piece_table(piece) == want
        for most in (0, 3, 17):
            assert [min(n, most + 1) for n in counter.piece_table(piece, most)] == [min(n, most + 1) for n in want]


def test_prefixes_inside_pieces(spark, library):
    data = list(enumerate([*UNBROKEN, "some words, then " + UNBROKEN[0] + " and more", "internationalization " * 30]))
    got = {r.doc_id: r for r in token_counts(documents(spark, data), vocabulary_path(), 23).collect()}
    table = prefix_table(documents(spark, data), vocabulary_path())
    tables = {r.doc_id: r for r in table.select("*", tokens_before(50).alias("a"), bytes_within(23).alias("b")).collect()}
    for doc, text in data:
        n = {len(text[:i].encode()): len(library(text[:i])) for i in range(len(text) + 1)}
        best = max(e for e, k in n.items() if k <= 23)
        if n[len(text.encode())] > 23:
            assert (got[doc].within_bytes, got[doc].within_tokens) == (len(text.encode()[:best].rstrip(b" ")), n[best])
        assert tables[doc].b == len(text.encode()[:best].rstrip(b" "))
        assert tables[doc].a == n[max(e for e in n if e <= 50)]
        assert dict(zip(tables[doc].ends, tables[doc].tokens)).items() <= n.items()


def test_bounded_memories(spark, library, monkeypatch):
    import pyarrow as pa

    from residuum.llm.bytewords import text_bytes

    monkeypatch.setattr(W, "MAX_PIECES", 30)
    e = W.WordEncoder(vocabulary_path())
    rng = random.Random(1)
    for _ in range(5):
        texts = [words(rng, 20) for _ in range(4)]
        ids, borders = e.encode(*text_bytes(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(borders[:-1], borders[1:])] == [library(t) for t in texts]
