"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves, each half has its own codebook, and a cell is a
pair of centroids.  A query ranks the centroids of both halves and walks the
pairs by their summed distance with a heap until the cells it has met hold
enough entries; those are reranked by the exact inner product.  What is enough
is measured: the share of the entries that queries of the sample must meet so
that ``target`` of their true neighbours in the sample are among them.  Data in
clusters need a small share, data without structure a large one.

Equal vectors are one entry with their smallest ids: no result needs more than
``k + 1`` of them, so a vector that a third of the rows share costs one entry.
Entries are dealt out in blocks of bounded size, queries follow the blocks
their cells lie in, and a task reads a block's entries and then streams the
queries past it.

The codebooks are fitted on a bounded sample (``SAMPLE`` vectors with the
smallest id hashes); every vector is indexed.

Defined cases: NULL vectors or ids, zero vectors, empty ones and those with
NULL or non-finite components take no part, nor do vectors of another length
than the (most frequent) one searched; repeated ids count as rows of their own;
ties go to the smaller id; fewer candidates than ``k`` give all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residuum.llm.shared import Workspace

SAMPLE = 20_000
CENTROIDS = 64
#: Recall that the walk's length is measured for, by so many queries of the
#: sample, and the entries that it meets at least.
TARGET = 0.95
TRIALS = 300
CANDIDATES = 2_000
BLOCK = 4_096
#: Queries that a task holds while it scores a block.
QUERY_BATCH = 512
#: Queries whose best entries a task holds before it gives them out.
HELD = 20_000


def usable(vector: str):
    """Whether a vector takes part."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def train_codebook(rows: np.ndarray, centroids: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's k-means; an empty cluster restarts at the row farthest off."""
    rng = np.random.default_rng(seed)
    unique = np.unique(rows, axis=0)
    centre = unique[rng.permutation(len(unique))[:centroids]].astype(np.float64)
    for _ in range(rounds):
        near = _distances(rows, centre)
        own = near.argmin(1)
        for c in range(len(centre)):
            mine = rows[own == c]
            if len(mine):
                centre[c] = mine.mean(0)
            else:
                centre[c] = rows[near[np.arange(len(rows)), own].argmax()]
    return centre


def _distances(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return (rows ** 2).sum(1)[:, None] - 2 * rows @ centre.T + (centre ** 2).sum(1)[None]


class MultiIndex:
    """The two codebooks, and how many entries and blocks each cell row has."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray]):
        self.books = books
        self.half = books[0].shape[1]
        self.counts = np.zeros((len(books[0]), len(books[1])), np.int64)
        self.parts = np.ones(len(books[0]), np.int64)

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = vectors.astype(np.float64)
        return (_distances(v[:, :self.half], self.books[0]).argmin(1), _distances(v[:, self.half:], self.books[1]).argmin(1))

    def walk(self, query: np.ndarray, candidates: int) -> dict[int, list[int]]:
        """Cells by first centroid, nearest pairs first.  A pair's distance is
        the sum of its halves'; for inner products that is the sum of the two
        negative products."""
        d1, d2 = -(self.books[0] @ query[:self.half]), -(self.books[1] @ query[self.half:])
        o1, o2 = np.argsort(d1), np.argsort(d2)
        heap, seen, met, out = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, 0, {}
        while heap and met < candidates:
            _, i, j = heapq.heappop(heap)
            a, b = int(o1[i]), int(o2[j])
            if self.counts[a, b]:
                met += int(self.counts[a, b])
                out.setdefault(a, []).append(b)
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(o1) and y < len(o2) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (d1[o1[x]] + d2[o2[y]], x, y))
        return out


def needed_share(index: MultiIndex, rows: np.ndarray, k: int, target: float, trials: int = TRIALS) -> float:
    """The share of all entries that a walk over the sample ``rows`` meets when
    it has met ``target`` of the queries' ``k`` true neighbours."""
    if len(rows) <= k + 1:
        return 1.0
    i, j = index.cells(rows)
    counts = np.zeros(index.counts.shape, np.int64)
    np.add.at(counts, (i, j), 1)
    cell, width = i * counts.shape[1] + j, index.half
    shares = []
    for q in np.linspace(0, len(rows) - 1, min(trials, len(rows))).astype(int):
        score = rows @ rows[q]
        score[q] = -np.inf
        near = np.argpartition(-score, k)[:k]
        far = -(index.books[0] @ rows[q, :width])[:, None] - (index.books[1] @ rows[q, width:])[None]
        order = np.argsort(far.ravel(), kind="stable")
        met = np.empty(len(order), np.int64)
        met[order] = np.cumsum(counts.ravel()[order])
        shares.append(met[cell[near]])
    return float(np.quantile(np.concatenate(shares), target)) / len(rows)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


ENTRY = "block long, tag int, key string, ids array<long>, cells array<int>, vec array<double>"


def _batch(block, tag, key, ids, cells, vec) -> pa.RecordBatch:
    n = len(block)
    return pa.RecordBatch.from_arrays([
        pa.array(block, pa.int64()), pa.array(np.full(n, tag), pa.int32()), pa.array(key, pa.string()), pa.array(ids, pa.list_(pa.int64())),
        pa.array(cells, pa.list_(pa.int32())), pa.array(list(vec), pa.list_(pa.float64()))], names=["block", "tag", "key", "ids", "cells", "vec"])


def search(vectors: DataFrame, work: Workspace, k: int = 20, is_query=None, id_col: str = "vec_id", vector_col: str = "embedding",
           centroids: int = CENTROIDS, target: float = TARGET, least: int = CANDIDATES, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``is_query`` (a
    condition on ``_id``) its ``k`` rows of largest inner product found."""
    spark = vectors.sparkSession
    src = vectors.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("_vec"))
    src = src.filter(F.col("_id").isNotNull() & usable("_vec"))
    sized = src.groupBy(F.size("_vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sized is None:
        return empty
    dim = int(sized["n"])
    src = src.filter(F.size("_vec") == dim).withColumn("_key", F.sha2(F.array_join(F.transform("_vec", lambda x: F.hex(x.cast("string"))), ","), 256))
    src = work.table(src, "vectors")
    queries = src.filter(is_query if is_query is not None else F.lit(True)).select("_key", F.col("_id").alias("query_id"))
    # an entry for each distinct vector, with as many of its ids as a result can hold
    first = F.row_number().over(Window.partitionBy("_key").orderBy("_id"))
    entries = (src.withColumn("_n", first).filter(F.col("_n") <= k + 1).groupBy("_key")
               .agg(F.array_sort(F.collect_list("_id")).alias("_ids"), F.first("_vec").alias("_vec")))
    entries = work.table(entries, "entries")
    chosen = entries.orderBy(F.xxhash64("_key"), "_key").limit(sample).select("_vec").toArrow()["_vec"].combine_chunks()
    rows = _matrix(chosen, dim)
    half = max(1, dim // 2)
    right = rows[:, half:] if dim > 1 else np.zeros((len(rows), 0))
    index = MultiIndex((train_codebook(rows[:, :half], centroids), train_codebook(right, centroids) if dim > 1 else np.zeros((1, 0))))
    books = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                i, j = books.value.cells(_matrix(b.column("_vec"), dim))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32())], names=["_key", "_ids", "_vec", "_i", "_j"])

    placed = work.table(entries.mapInArrow(place, "_key string, _ids array<long>, _vec array<double>, _i int, _j int"), "placed")
    # the directory has at most centroids ** 2 rows, whatever the input
    for r in placed.groupBy("_i", "_j").count().collect():
        index.counts[r._i, r._j] = r["count"]
    candidates = max(least, int(np.ceil(needed_share(index, rows, k, target) * index.counts.sum())))
    index.parts = np.maximum(1, -(-index.counts.sum(1) // block))
    directory = spark.sparkContext.broadcast(index)
    parts = F.element_at(F.array([F.lit(int(p)) for p in index.parts]), F.col("_i") + 1)
    stored = placed.select(
        (F.col("_i").cast("long") * (1 << 32) + F.pmod(F.xxhash64("_key"), parts)).alias("block"), F.lit(0).alias("tag"), F.col("_key").alias("key"),
        F.col("_ids").alias("ids"), F.array("_j").alias("cells"), F.col("_vec").alias("vec"))
    asked = queries.select("_key").distinct().join(entries, "_key").select("_key", "_vec")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = directory.value
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("_vec"), dim)
            out: list[tuple] = []
            for key, q in zip(b.column("_key").to_pylist(), m):
                for i, cells in own.walk(q, candidates).items():
                    out += [((i << 32) + p, key, cells, q) for p in range(int(own.parts[i]))]
                if len(out) > 5000:
                    yield _batch([x[0] for x in out], 1, [x[1] for x in out], [[]] * len(out), [x[2] for x in out], [x[3] for x in out])
                    out = []
            if out:
                yield _batch([x[0] for x in out], 1, [x[1] for x in out], [[]] * len(out), [x[2] for x in out], [x[3] for x in out])

    # an entry's block comes before the queries that visit it
    met = stored.union(asked.mapInArrow(route, ENTRY)).repartition("block").sortWithinPartitions("block", "tag")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = len(index_shape[1])
        now, entries_in, arrays = None, [], None
        best: dict[str, list[tuple]] = {}        # what the task's blocks have for each query
        for whole in batches:
            for at in range(0, whole.num_rows, QUERY_BATCH):
                b = whole.slice(at, QUERY_BATCH)
                blocks, tags = b.column("block").to_numpy(), b.column("tag").to_numpy()
                edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(tags) != 0)) + 1
                for s, e in zip([0, *edges], [*edges, b.num_rows]):
                    part = b.slice(s, e - s)
                    if blocks[s] != now:
                        now, entries_in, arrays = blocks[s], [], None
                    if tags[s] == 0:
                        entries_in.append(part)
                        continue
                    if not entries_in:
                        continue
                    if arrays is None:
                        ids = [x for p in entries_in for x in p.column("ids").to_pylist()]
                        arrays = (np.vstack([_matrix(p.column("vec"), dim) for p in entries_in]), np.concatenate([p.column("cells").flatten().to_numpy() for p in entries_in]),
                                  ids, np.array([x[0] for x in ids]))
                    _best(part, arrays, dim, k + 1, second, best)
                if len(best) > HELD:
                    yield _hits(best)
                    best = {}
        if best:
            yield _hits(best)

    index_shape = (range(len(index.books[0])), range(len(index.books[1])))
    hits = met.mapInArrow(rerank, "key string, score double, ids array<long>")
    top = Window.partitionBy("key").orderBy(F.desc("score"), F.col("ids")[0])
    best = hits.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= k + 1)
    each = best.select("key", "score", F.explode("ids").alias("vec_id"))
    near = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    listed = work.table(each.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= k + 1).drop("_n"), "listed")
    pairs = queries.join(listed, F.col("_key") == F.col("key")).filter("query_id <> vec_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(part: pa.RecordBatch, arrays: tuple, dim: int, k: int, second: int, best: dict[str, list[tuple]]) -> None:
    """For each query of a piece its ``k`` best entries among its cells, put
    together with those it has already."""
    vectors, cell, ids, first = arrays
    queries = _matrix(part.column("vec"), dim)
    rough = queries @ vectors.T
    keys = part.column("key").to_pylist()
    for n, cells in enumerate(part.column("cells").to_pylist()):
        visited = np.zeros(second, bool)
        visited[cells] = True
        at = np.flatnonzero(visited[cell])
        have = best.get(keys[n], [])
        if len(have) == k and len(at):
            # the product above may differ in its last digits from the sum below
            at = at[rough[n, at] >= have[-1][0] - 1e-9 * max(1.0, abs(have[-1][0]))]
        if not len(at):
            continue
        values = rough[n, at]
        if len(at) > k:
            bar = np.partition(values, len(at) - k)[len(at) - k]
            at = at[values >= bar - 1e-9 * max(1.0, abs(bar))]
        exact = (vectors[at] * queries[n]).sum(axis=1)
        found = [(float(x), int(first[a]), ids[a]) for x, a in zip(exact, at)]
        best[keys[n]] = sorted(have + found, key=lambda x: (-x[0], x[1]))[:k]


def _hits(best: dict[str, list[tuple]]) -> pa.RecordBatch:
    rows = [(key, x[0], x[2]) for key, found in best.items() for x in found]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.float64()),
                                       pa.array([x[2] for x in rows], pa.list_(pa.int64()))], names=["key", "score", "ids"])
