"""N-gram Jaccard self-join by vertical partitioning.

The shingles of all documents have one global order, that of their hashes.  The
order is cut into fragments and a pair's overlap is the sum of its partial
overlaps over the fragments.

*First fragment.*  Two sets of Jaccard similarity ``t`` share at least ``t``
of the larger one, so their first ``n - ceil(t n) + l`` shingles in the global
order share at least ``l``; ``l`` is a tenth of the set.  These alone are
exchanged, dealt out by shingle, and come back with the number of documents
that hold them.  A document that shares fewer than ``l`` of them with anybody
links with nobody (most documents end here).  Of the shared ones the most
frequent are skipped, half as many as ``l`` would allow (by the smallest ``l``
of any partner), which keeps passages that very many documents quote from
bringing these together; partners have at least the other half in common.

*Remaining fragments.*  The documents left are laid out in blocks, those with
common rare shingles beside one another.  A document meets another block when
enough of its kept shingles occur there.  Where blocks meet, the overlaps of all
pairs that are there are counted fragment by fragment and summed.  Only what the links amount to
leaves the task: a spanning forest and the number of links of each document, so
a group of thousands of near copies gives thousands of rows and not millions.

Documents with equal sets are one class from the start; components of the
forests give the result.  No pair is left out: every step keeps all pairs that
can reach the threshold, whatever the order or the layout.

Defined cases: a NULL or empty text (or one without words) has the empty set,
links with nothing and is its own component; a document with a NULL id links like
any other, and its component is the smallest id that links reach, or NULL;
repeated ids are documents of their own that share their id; repeated rows link
with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residuum.llm.components import connected_components
from residuum.llm.shared import Workspace, forget, slices
from residuum.llm.shingles import SIZE, shingle_sets, signatures

THRESHOLD = 80
#: Hash ranges that the first fragment is dealt out by: one for so many bytes of
#: text, which keeps a range within a few MB, and so many at least.
BUCKET_BYTES = 10 << 20
BUCKETS = 1024
#: Shingles of a block, and what a document counts for at least.
BLOCK_SHINGLES = 600_000
LEAST_SHINGLES = 250
#: Shingles of one fragment where blocks meet.
FRAGMENT = 4096
#: A shingle of at most so many pairs of documents has them counted one by one.
FEW = 256
#: Up to so many ids the documents left are found with a broadcast of them.
BROADCAST_IDS = 2_000_000
#: Bits of a shingle beside its bucket; equal shingles of the first fragment
#: stay equal, and a chance meeting of others only brings a pair to be counted.
_BITS = 40
#: Text that is hashed at a time, in bytes; bounds a worker's arrays.
SLICE = 4 << 20
_MANY = np.uint32(0xFFFFFFFF)


def _need(n: np.ndarray, threshold: int) -> np.ndarray:
    """What a partner shares at least with a set of ``n``."""
    return -(-threshold * n // 100)


def _extra(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, n // 10)


def _skip(n: np.ndarray, threshold: int) -> np.ndarray:
    """How many of its most frequent shared shingles a set of ``n`` skips.  Of
    two partners' common ones the two skip the same upper end, so what both
    keep is at least ``_extra`` of the larger one's need less its ``_skip``."""
    return (_extra(_need(n, threshold)) - 1) // 2


def _reach(n: np.ndarray, threshold: int) -> np.ndarray:
    """Shingles of a set of ``n`` in the first fragment."""
    return np.where(n > 0, np.minimum(n, n - _need(n, threshold) + _extra(n)), 0)


FIRST = "kind int, bucket int, chunk long, idx int, id long, t long, n long, s1 long, s2 long, data binary"


def bucket_count(texts: DataFrame) -> int:
    """Buckets for the texts of ``_text``, by their bytes."""
    total = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    return max(BUCKETS, -(-total // BUCKET_BYTES))


def _row(kind, bucket, chunk, data) -> tuple:
    return kind, bucket, chunk, None, None, None, None, None, None, data


def _first_fragment(docs: DataFrame, size: int, threshold: int, buckets: int) -> DataFrame:
    """Per document its size and signature (kind 1); per chunk of documents and
    bucket the shingles of the first fragment (kind 0): once each, with the
    document, or without one where several of the chunk have it, which a chunk
    keeps for itself (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        chunk = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                hashes, borders = shingle_sets(batch.column("_text"), size)
                n = np.diff(borders)
                s1, s2 = signatures(hashes, borders)
                rows = len(n)
                yield _first_batch([pa.array(np.ones(rows), pa.int32()), pa.nulls(rows, pa.int32()), pa.array(np.full(rows, chunk)), pa.array(np.arange(rows), pa.int32()),
                                    batch.column("_id"), batch.column("_t"), pa.array(n), pa.array(s1), pa.array(s2), pa.nulls(rows, pa.binary())])
                owner = np.repeat(np.arange(rows, dtype=np.uint32), n)
                early = np.arange(len(hashes)) - np.repeat(borders[:-1], n) < np.repeat(_reach(n, threshold), n)
                own = owner[early]
                # by bucket, then by shingle
                place = (hashes[early] % np.uint64(buckets)).astype(np.int64)
                token = ((hashes[early] // np.uint64(buckets)) & np.uint64((1 << _BITS) - 1)) * np.uint64(buckets) + place.astype(np.uint64)
                order = np.lexsort((token, place))
                token, own, place = token[order], own[order], place[order]
                new = np.ones(len(token), bool)
                new[1:] = token[1:] != token[:-1]
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(token))).astype(np.uint32)
                many = count > 1
                kept = np.repeat(many, count)
                out = [_row(2, None, chunk, np.uint32([rows, kept.sum()]).tobytes() + n.astype(np.uint32).tobytes()
                            + token[kept].tobytes() + own[kept].tobytes())]
                whose = np.where(many, _MANY, own[at])
                edges = np.searchsorted(place[at], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    s, e = edges[b], edges[b + 1]
                    several = count[s:e][many[s:e]]
                    out.append(_row(0, b, chunk, np.uint32([e - s]).tobytes() + _five(token[at[s:e]] // np.uint64(buckets)) + whose[s:e].tobytes() + several.tobytes()))
                yield _first_batch([pa.array(c, t) for c, t in zip(zip(*out), _FIRST_TYPES)])
                chunk += 1

    return docs.mapInArrow(run, FIRST)


_FIRST_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _first_batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FIRST.split(", ")])


def _five(x: np.ndarray) -> bytes:
    """The low five bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view("<u8").ravel()


def _shared_in_bucket(buckets: int):
    """Of a bucket's shingles those that more than one document holds, for each
    chunk that has them: shingle, number of documents, document of the chunk."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        tokens, whose, counts, chunks = [], [], [], []
        names = table.column("chunk").to_numpy()
        for c, blob in enumerate(table.column("data")):
            raw = np.frombuffer(blob.as_buffer(), np.uint8)
            m = int(raw[:4].view(np.uint32)[0])
            tokens.append(_from_five(raw[4:4 + 5 * m]))
            own = np.frombuffer(raw[4 + 5 * m:4 + 9 * m].tobytes(), np.uint32)
            n = np.ones(m, np.uint32)
            n[own == _MANY] = np.frombuffer(raw[4 + 9 * m:].tobytes(), np.uint32)
            whose.append(own)
            counts.append(n)
            chunks.append(np.full(m, c))
        token, own, n, chunk = map(np.concatenate, (tokens, whose, counts, chunks))
        order = np.argsort(token, kind="stable")
        token, own, n, chunk = token[order], own[order], n[order], chunk[order]
        at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        held = np.repeat(np.add.reduceat(n, at), np.diff(np.append(at, len(token))))
        shared = held > 1
        token, own, held, chunk = token[shared] * np.uint64(buckets) + np.uint64(bucket), own[shared], held[shared], chunk[shared]
        order = np.argsort(chunk, kind="stable")
        edges = np.searchsorted(chunk[order], np.arange(len(names) + 1))
        out = [(int(names[c]), np.uint32([e - s]).tobytes() + token[order[s:e]].tobytes() + held[order[s:e]].astype(np.uint32).tobytes() + own[order[s:e]].tobytes())
               for c, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s]
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "kind": pa.array([0] * len(out), pa.int32()), "data": pa.array([x[1] for x in out], pa.binary())})

    return run


def _keepers(threshold: int):
    """Documents of a chunk that share enough of the first fragment, with the
    shared shingles that must bring any partner: all but the most frequent."""

    def run(table: pa.Table) -> pa.Table:
        tokens, held, whose = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        n = many = many_own = np.zeros(0, np.uint32)
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("data")):
            raw = blob.as_buffer()
            if kind == 2:
                rows, k = np.frombuffer(raw, np.uint32, 2)
                n = np.frombuffer(raw, np.uint32, rows, 8)
                many = np.frombuffer(raw[8 + 4 * rows:8 + 4 * rows + 8 * k].to_pybytes(), np.uint64)
                many_own = np.frombuffer(raw[8 + 4 * rows + 8 * k:].to_pybytes(), np.uint32)
                continue
            m = int(np.frombuffer(raw, np.uint32, 1)[0])
            tokens.append(np.frombuffer(raw[4:4 + 8 * m].to_pybytes(), np.uint64))
            held.append(np.frombuffer(raw[4 + 8 * m:4 + 12 * m].to_pybytes(), np.uint32))
            whose.append(np.frombuffer(raw[4 + 12 * m:].to_pybytes(), np.uint32))
        token, df, own = np.concatenate(tokens), np.concatenate(held), np.concatenate(whose)
        several = own == _MANY
        order = np.argsort(token[several])
        known, known_df = token[several][order], df[several][order]
        token = np.concatenate([token[~several], many])
        own = np.concatenate([own[~several], many_own]).astype(np.int64)
        df = np.concatenate([df[~several], known_df[np.searchsorted(known, many)] if len(many) else np.zeros(0, np.uint32)])
        n = n.astype(np.int64)
        shared = np.bincount(own, minlength=len(n))
        need = _need(n, threshold)
        enough = (n > 0) & (shared >= _reach(n, threshold) - (n - need))
        order = np.lexsort((token, df, own))
        token, own = token[order], own[order]
        rank = np.arange(len(own)) - np.concatenate([[0], np.cumsum(shared)])[own]
        take = enough[own] & (rank < (shared - _skip(n, threshold))[own])
        token, own = token[take], own[take]
        idx = np.flatnonzero(enough)
        borders = np.searchsorted(own, np.append(idx, len(n)))
        return pa.table({"chunk": pa.array(np.full(len(idx), table.column("chunk")[0].as_py()), pa.int64()), "idx": pa.array(idx, pa.int32()),
                         "keys": pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(token.astype(np.int64)))})

    return run


def _lay_out(nodes: DataFrame, work: Workspace) -> DataFrame:
    """``node, block``: blocks of bounded size along ``label, n, node``."""
    weight = F.greatest(F.col("n"), F.lit(LEAST_SHINGLES))
    placed = nodes.repartitionByRange("label", "n", "node").sortWithinPartitions("label", "n", "node").select(
        "node", weight.alias("_w"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    placed = work.table(placed, "placed")
    sums = placed.groupBy("_part").agg(F.sum("_w").alias("_sum"))
    # one row a partition: the only global order is over this short table
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    running = F.sum("_w").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    return placed.withColumn("_run", running).join(before, "_part").select("node", F.floor((F.col("_before") + F.col("_run")) / F.lit(BLOCK_SHINGLES)).alias("block"))


def _meet(threshold: int):
    """Links between the documents of two blocks (or within one): the overlaps
    of all pairs, counted fragment by fragment."""

    def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """How many shingles each pair has in common.  A fragment of shingles
        that many have is one product of 0/1 matrices; the pairs of those that
        few have are counted one by one."""
        common = np.intersect1d(np.concatenate(left), np.concatenate(right))
        total = np.zeros(len(left) * len(right), np.float32)     # counts: exact far beyond any set's size
        sides = []
        for each in (left, right):
            tokens, owner = np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])
            at = np.searchsorted(common, tokens)
            hit = at < len(common)
            hit[hit] = common[at[hit]] == tokens[hit]
            at, owner = at[hit], owner[hit]
            order = np.argsort(at, kind="stable")
            sides.append((at[order], owner[order], np.bincount(at, minlength=len(common))))
        (at1, own1, n1), (at2, own2, n2) = sides
        few = n1 * n2 <= FEW
        starts = np.cumsum(n2) - n2
        mine = few[at1]
        a, own = at1[mine], own1[mine]
        for s in range(0, len(a), FRAGMENT * 16):
            part, times = a[s:s + FRAGMENT * 16], n2[a[s:s + FRAGMENT * 16]]
            place = np.repeat(starts[part] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            pairs = np.repeat(own[s:s + FRAGMENT * 16], times) * len(right) + own2[place]
            np.add.at(total, pairs, np.float32(1))
        total = total.reshape(len(left), len(right))
        many = np.flatnonzero(~few)
        column = np.full(len(common), -1)
        column[many] = np.arange(len(many))
        for begin in range(0, len(many), FRAGMENT):
            part = []
            for at, owner, each in ((at1, own1, left), (at2, own2, right)):
                c = column[at]
                here = (c >= begin) & (c < begin + FRAGMENT)
                m = np.zeros((len(each), min(FRAGMENT, len(many) - begin)), np.float32)
                m[owner[here], c[here] - begin] = 1
                part.append(m)
            total += part[0] @ part[1].T
        return total

    def forest(nodes: np.ndarray, copies: np.ndarray, link: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple]:
        """Star edges of the links' components, and each node's links."""
        label = np.arange(len(nodes), dtype=np.int32)
        none = np.int32(len(nodes))
        while True:
            old = label.copy()
            low = np.where(link, label[cols][None, :], none).min(1, initial=none)
            label[rows] = np.minimum(label[rows], low)
            low = np.where(link, label[rows][:, None], none).min(0, initial=none)
            label[cols] = np.minimum(label[cols], low)
            label = label[label]
            if (label == old).all():
                break
        degree = np.zeros(len(nodes), np.int64)
        degree[rows] += link @ copies[cols]
        if rows is not cols:
            degree[cols] += link.T @ copies[rows]
        return [(int(nodes[i]), int(nodes[label[i]]), int(degree[i])) for i in np.flatnonzero(degree)]

    def run(table: pa.Table) -> pa.Table:
        forget()
        b1, b2 = table.column("b1")[0].as_py(), table.column("b2")[0].as_py()
        block, nodes = table.column("block").to_numpy(), table.column("node").to_numpy()
        n, copies = table.column("n").to_numpy(), table.column("copies").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        rows = np.flatnonzero(block == b1)
        cols = rows if b1 == b2 else np.flatnonzero(block == b2)
        out: list[tuple] = []
        if len(rows) and len(cols):
            both = overlaps([sets[i] for i in rows], [sets[i] for i in cols])
            link = np.empty(both.shape, bool)
            for i, row in enumerate(rows):
                mine = both[i].astype(np.int64)
                link[i] = 100 * mine >= threshold * (n[row] + n[cols] - mine)
            if rows is cols:
                np.fill_diagonal(link, False)
            out = forest(nodes, copies, link, rows, cols)
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("a", "b", "n_links"), columns)})

    return run


def jaccard_components(docs: DataFrame, work: Workspace, threshold: int = THRESHOLD, size: int = SIZE,
                       id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``id, n_shingles, component_id, n_links`` per document: its set's size,
    the smallest id that links reach, and how many other documents it links
    with (equal sets included)."""
    out = _members(docs, work, threshold, size, id_col, text_col, buckets)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _text`` and the text's hash ``_t``: id and hash name a row."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).withColumn("_t", F.xxhash64("_text"))


def _members(docs: DataFrame, work: Workspace, threshold: int, size: int, id_col: str, text_col: str, buckets: int | None) -> DataFrame:
    """``id, t, n, member, component_id, n_links`` of every document; ``member``
    is a number of its component (NULL for an empty set)."""
    src = _identified(docs, id_col, text_col)
    buckets = buckets or bucket_count(src)
    first = work.table(_first_fragment(src, size, threshold, buckets), "first")
    each = first.filter("kind = 1").select("chunk", "idx", "id", "t", "n", "s1", "s2")
    same = ["s1", "s2", "n"]
    classes = each.filter("n > 0").groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    # classes are numbered once they are stored
    classes = work.table(work.table(classes, "classes").withColumn("node", F.monotonically_increasing_id()), "nodes-of-classes")

    # the first fragment: what documents share of it
    shared = first.filter("kind = 0").groupBy("bucket").applyInArrow(_shared_in_bucket(buckets), "chunk long, kind int, data binary")
    kept = shared.union(first.filter("kind = 2").select("chunk", "kind", "data")).groupBy("chunk").applyInArrow(
        _keepers(threshold), "chunk long, idx int, keys array<long>")
    kept = work.table(kept, "kept")
    one = (kept.join(each, ["chunk", "idx"]).join(classes, same).filter(F.col("id").eqNullSafe(F.col("rep")))
           .groupBy("node").agg(F.first("id").alias("id"), F.min("t").alias("t"), F.first("s1").alias("s1"), F.first("n").alias("n"), F.first("copies").alias("copies"), F.first("keys").alias("keys")))
    one = work.table(one, "left")
    held = one.select("node", F.explode("keys").alias("key"))
    low = held.groupBy("key").agg(F.count("*").alias("_n"), F.min("node").alias("_low")).filter("_n > 1").drop("_n")
    held = work.table(held.join(low, "key"), "held")
    # labels that bring documents with common keys together; they only shape the layout
    label = held.groupBy("node").agg(F.min("_low").alias("_l"))
    wide = held.join(label, "node").groupBy("key").agg(F.min("_l").alias("_l2"))
    label = held.join(wide, "key").groupBy("node").agg(F.min("_l2").alias("label"))
    nodes = one.select("node", "id", "t", "s1", "n", "copies").join(label, "node")
    nodes = work.table(nodes, "nodes")
    blocks = work.table(_lay_out(nodes, work), "blocks")

    # the whole sets of the documents left
    wanted = nodes.join(blocks, "node").select(F.col("id").alias("_wid"), F.col("t").alias("_wt"), F.col("s1").alias("_s1"), "node", "n", "copies", "block")
    wanted = work.table(wanted, "wanted")
    found = src.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted,
                     F.col("_id").eqNullSafe(F.col("_wid")) & (F.col("_t") == F.col("_wt"))).drop("_id", "_t", "_wid", "_wt")

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for batch in slices(whole, "_text", SLICE):
                hashes, borders = shingle_sets(batch.column("_text"), size)
                s1, _ = signatures(hashes, borders)
                keep = np.flatnonzero(s1 == batch.column("_s1").to_numpy())
                raw = hashes.tobytes()
                sets = [raw[8 * borders[i]:8 * borders[i + 1]] for i in keep]
                part = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("block", "node", "n", "copies")), pa.array(sets, pa.binary())],
                                                 names=["block", "node", "n", "copies", "shingles"])

    sets = found.mapInArrow(whole_sets, "block long, node long, n long, copies long, shingles binary").dropDuplicates(["node"])
    sets = work.table(sets, "sets")
    # a document meets its own block, and those where enough of its keys occur
    held = held.select("key", "node").join(nodes.select("node", "n"), "node").join(blocks, "node")
    per_key = held.select("key", F.col("block").alias("other")).distinct()
    need = F.ceil(F.col("n") * threshold / 100).cast("long")
    extra = F.greatest(F.lit(1), F.floor(need / 10))
    enough = extra - F.floor((extra - 1) / 2)
    away = (held.join(per_key, "key").filter("block <> other").groupBy("node", "n", "block", "other").agg(F.count("*").alias("_keys"))
            .filter(F.col("_keys") >= enough).select("node", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2")))
    home = blocks.select("node", F.col("block").alias("b1"), F.col("block").alias("b2"))
    meetings = work.table(away.union(home), "meetings")
    links = meetings.join(sets, "node").groupBy("b1", "b2").applyInArrow(_meet(threshold), "a long, b long, n_links long")
    links = work.table(links, "links")

    parts = connected_components(links.filter("a <> b").select("a", "b"), work)
    named = classes.select("node", *same, "rep", "copies").join(parts, "node", "left").join(
        links.groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("_links")), "node", "left").withColumn("member", F.coalesce("component", "node"))
    # classes without links keep their own number as key, so they do not meet under NULL
    smallest = parts.join(classes.select("node", "rep"), "node").groupBy(F.col("component").alias("member")).agg(F.min("rep").alias("_smallest"))
    named = named.join(work.table(smallest, "smallest"), "member", "left").select(
        *same, "member", F.coalesce("_smallest", "rep").alias("component_id"), (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return each.join(named, same, "left").select("id", "t", "n", "member", "component_id", "n_links")


def keep_representatives(docs: DataFrame, work: Workspace, threshold: int = THRESHOLD, size: int = SIZE,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does: that
    with the smallest id (one without an id only if none has one; of equal ids
    that with the smaller hash of its text).  A row is known by its id and text,
    so another text under the same id is judged by itself.  Of rows with equal id
    and text one stays."""
    found = work.table(_members(docs, work, threshold, size, id_col, text_col, None).select("id", "t", "n", "member"), "found")
    order = F.struct(F.col("id").isNull().alias("nameless"), F.col("id"), F.col("t"))
    first = work.table(found.filter("n > 0").groupBy("member").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "first-of-groups")
    gone = work.table(found.join(first, "member").filter(~(F.col("id").eqNullSafe(F.col("_first.id")) & (F.col("t") == F.col("_first.t"))))
                      .select(F.col("id").alias("_gid"), F.col("t").alias("_gt")).distinct(), "gone")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"),
                        F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_t"))
    known = lambda other: F.col("_id").eqNullSafe(F.col(f"_{other}id")) & (F.col("_t") == F.col(f"_{other}t"))
    stay = whole.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, known("g"), "left_anti")
    again = found.groupBy("id", "t").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("id").alias("_rid"), F.col("t").alias("_rt"))
    if again.limit(1).count():
        stay = stay.join(again, known("r"), "left_anti").unionByName(stay.join(again, known("r"), "left_semi").dropDuplicates(["_id", "_t"]))
    return stay.select("_row.*")
