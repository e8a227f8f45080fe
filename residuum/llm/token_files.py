"""Token ids as Parquet list columns.

A file holds one row per document: ``doc_id``, ``n_tokens`` and ``ids`` (a list
of unsigned integers).  Ids are dictionary-encoded, the document ids and counts
are delta-encoded; a row group holds a bounded number of tokens and every file
has page indexes, so a reader can take the counts alone, or a range of
documents, without touching other pages.

Documents are range-partitioned and sorted by id, so each file holds an
ascending range and files follow one another.  A task writes its file under a
name that no other attempt uses and returns a manifest row; the manifest is
stored, so only files of finished tasks are read and a lost executor costs its
own files.  ``start`` (the ids of all documents before) is a running sum over
the manifest plus one inside each file.

Defined cases: a NULL or empty text has the end id alone; NULL ids come first;
rows with equal ids follow one another in a fixed order (by a hash of the text,
then the text); an empty table gives an empty manifest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residuum.llm.bytewords import text_bytes
from residuum.llm.shared import Workspace, attempt_name, filesystem, held, join_path, slices
from residuum.llm.words import WordEncoder

#: Tokens of a row group.  At four bytes each this bounds a reader's memory.
GROUP_TOKENS = 4 << 20

def encoder(vocabulary: str) -> WordEncoder:
    """The worker's encoder of a vocabulary; tasks of one worker share it."""
    return held(f"encoder {vocabulary}", lambda: WordEncoder(vocabulary))


FILE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.uint16()))])


def _open(where, fs):
    return pq.ParquetWriter(
        where, FILE_SCHEMA, filesystem=fs, compression="zstd", compression_level=1, write_page_index=True,
        use_dictionary=["ids.list.element"], dictionary_pagesize_limit=4 << 20, data_page_size=256 << 10,
        column_encoding={"doc_id": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"})


MANIFEST = "part int, file string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, work: Workspace, vocabulary: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text", group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Encode every text, append ``end_id`` and write the files; returns the
    manifest ``part, file, n_docs, n_tokens, start`` (``start``: the tokens of
    all files before)."""
    folder = work.folder("tokens")
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    # the text's hash lets rows that share an id, or have none, fall into several ranges
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text")]
    placed = src.repartitionByRange(*order).sortWithinPartitions(*order, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = encoder(vocabulary), TaskContext.get().partitionId()
        fs, path = filesystem(folder)
        name = attempt_name(f"tokens-{part:06d}", ".parquet")
        writer, docs_n, tokens_n, held, waiting = None, 0, 0, 0, []
        end = np.array([end_id], own.dtype)
        for whole in batches:
            for batch in slices(whole, "_text"):
                ids, borders = own.encode(*text_bytes(batch.column("_text")))
                ids = np.insert(ids, borders[1:], end)
                borders = borders + np.arange(len(borders))
                lists = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(ids))
                waiting.append(pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array(np.diff(borders)), lists], schema=FILE_SCHEMA))
                docs_n, tokens_n, held = docs_n + batch.num_rows, tokens_n + len(ids), held + len(ids)
                if held >= group_tokens:
                    writer = writer or _open(join_path(path, name), fs)
                    writer.write_table(pa.Table.from_batches(waiting), row_group_size=len(waiting) * (1 << 20))
                    held, waiting = 0, []
        if waiting:
            writer = writer or _open(join_path(path, name), fs)
            writer.write_table(pa.Table.from_batches(waiting), row_group_size=len(waiting) * (1 << 20))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "file": [join_path(folder, name)], "n_docs": [docs_n], "n_tokens": [tokens_n]})

    manifest = work.table(placed.mapInArrow(run, MANIFEST), "manifest")
    # one row a file: the only global order is over this short table
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Read files back, row group by row group: ``doc_id, start, n_tokens`` and,
    with ``ids`` among the columns, the ids and ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit integers).  Without it the token pages are
    not read."""
    with_ids = "ids" in columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["file"])
                with pq.ParquetFile(path, filesystem=fs) as f:
                    at = row["start"]
                    for group in range(f.num_row_groups):
                        t = f.read_row_group(group, columns=["doc_id", "n_tokens", *["ids"] * with_ids]).combine_chunks()
                        n = t.column("n_tokens").to_numpy()
                        cols = [pa.array(t.column("doc_id").combine_chunks()), pa.array(at + np.cumsum(n) - n), pa.array(n)]
                        names = ["doc_id", "start", "n_tokens"]
                        at += int(n.sum())
                        if with_ids:
                            lists = t.column("ids").combine_chunks()
                            wide = memoryview(lists.flatten().to_numpy().astype("<u4")).cast("B")
                            borders = 4 * np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
                            crc = [zlib.crc32(wide[a:b]) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
                            cols.append(pa.array(crc, pa.int64()))
                            names.append("ids_crc32")
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, start long, n_tokens long" + ", ids_crc32 long" * with_ids
    # a number of its own: adaptive execution would put the short rows of all files into one task
    return manifest.repartition(max(1, manifest.count()), F.col("file")).mapInArrow(run, schema)


def token_lists(manifest: DataFrame) -> DataFrame:
    """The files as a table of ``doc_id, n_tokens, ids`` through Spark's reader.
    The manifest holds one row a file, so its names go through the driver."""
    spark = manifest.sparkSession
    files = [r.file for r in manifest.select("file").collect()]
    if not files:
        return spark.createDataFrame([], "doc_id long, n_tokens long, ids array<int>")
    return spark.read.parquet(*files)
