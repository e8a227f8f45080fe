"""Whitening of embeddings by incremental eigendecomposition.

Each task updates the spectrum of its vectors (``spectrum``); the spectra of the
tasks are combined a few at a time, each eigenpair as a rank-one update, until
one is left.  That gives the directions almost exactly.  A last distributed pass
measures the covariance in these directions (Rayleigh-Ritz), which brings the
components to double precision.  What moves or reaches the driver is of the
order of the squared number of dimensions, whatever the number of vectors.

A vector's entries are taken as whole numbers ``floor(1024 c) + 100000``, so the
sums and the deviations are exact; every product is of centred numbers.

Defined cases.  Vectors that are NULL, or hold NULL, non-finite or huge entries
(beyond 2**52 when scaled) take no part.  Nor do those of another length than the
most frequent one (the smaller of two), as no covariance holds both.  NULL ids
and repeated rows count like others; extra columns are ignored; no vectors give
no rows.  A component without variance has a NULL ``whitened`` and does not enter
``identity_error``; without any variance ``explained`` and ``identity_error`` are
NULL.  A ``deviation`` beyond a long is NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm.shared import Workspace
from residuum.llm.spectrum import EPS, Spectrum

SCALE, OFFSET = 1024, 100_000
#: Rows that enter a spectrum together (see ``Spectrum.add_rows``).
TOGETHER = 2048
#: Spectra that one task combines.
FAN_IN = 16


def usable(df: DataFrame, vector_col: str, id_col: str) -> DataFrame:
    """``_id, _vec`` of the vectors that take part."""
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("_vec"))
    fits = F.forall("_vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 52) / SCALE))
    whole = src.filter(F.col("_vec").isNotNull() & (F.size("_vec") > 0) & fits)
    length = whole.groupBy(F.size("_vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return whole.filter(F.size("_vec") == (length.d if length else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The whole numbers of a batch, without the offset that all share."""
    flat = pc.list_flatten(batch.column("_vec")).to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat.reshape(batch.num_rows, -1)).astype(np.int64)


SPECTRA = "slot long, n long, sums array<decimal(38,0)>, mean array<double>, eigenvalues array<double>, eigenvectors array<double>"


def _spectrum_row(slot: int, s: Spectrum, sums: list[int]) -> pa.RecordBatch:
    import decimal

    doubles = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array([slot], pa.int64()), pa.array([s.n], pa.int64()), pa.array([[decimal.Decimal(v) for v in sums]], pa.list_(pa.decimal128(38, 0))),
         pa.array([s.mean], doubles), pa.array([s.values], doubles), pa.array([s.vectors.ravel()], doubles)],
        names=["slot", "n", "sums", "mean", "eigenvalues", "eigenvectors"])


def partition_spectra(vectors: DataFrame, together: int = TOGETHER) -> DataFrame:
    """One row per task: its exact sums and the spectrum of its vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, sums, waiting = None, None, []

        def take() -> None:
            own.add_rows(np.concatenate(waiting).astype(float), together)
            waiting.clear()

        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                if own is None:
                    own, sums = Spectrum(x.shape[1]), [0] * x.shape[1]
                sums = [a + int(b) for a, b in zip(sums, x.astype(object).sum(0) if abs(x).max() > 1 << 40 else x.sum(0))]
                waiting.append(x)
                if sum(map(len, waiting)) >= together:
                    take()
        if own is not None:
            if waiting:
                take()
            yield _spectrum_row(TaskContext.get().partitionId(), own, sums)

    return vectors.mapInArrow(run, SPECTRA)


def combine_spectra(spectra: DataFrame, work: Workspace, fan_in: int = FAN_IN) -> Spectrum | None:
    """All spectra of a stored table as one, ``fan_in`` at a time."""
    def run(key, batch):
        rows = sorted(batch.to_pylist(), key=lambda r: r["slot"])
        own = Spectrum.of(*(rows[0][c] for c in ("n", "mean", "eigenvalues", "eigenvectors")))
        for r in rows[1:]:
            own.add(Spectrum.of(*(r[c] for c in ("n", "mean", "eigenvalues", "eigenvectors"))))
        return pa.Table.from_batches([_spectrum_row(key[0].as_py(), own, [])])

    last = spectra.agg(F.max("slot").alias("m")).first().m
    while last:
        spectra = work.table(spectra.withColumn("sums", F.lit(None).cast("array<decimal(38,0)>")).groupBy(F.expr(f"slot div {fan_in}")).applyInArrow(run, SPECTRA), "spectra")
        last //= fan_in
    row = spectra.first()
    return None if row is None else Spectrum.of(row.n, row.mean, row.eigenvalues, row.eigenvectors)


def _sum_by_position(partials: DataFrame) -> np.ndarray:
    """The sum of arrays of one length, by position; as many rows come back."""
    rows = partials.select(F.posexplode("part")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r.pos] = r.v
    return out


@dataclass
class Whitening:
    """The fitted map: exact sums, components as columns, their eigenvalues."""

    n: int
    sums: np.ndarray  # of the whole numbers without the offset, as Python integers
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """``n x - sums``, exact: as long integers if they fit."""
        most = int(abs(x).max()) * self.n + max(map(abs, self.sums))
        if most >= 1 << 62:
            return x.astype(object) * self.n - self.sums
        return x * self.n - self.sums.astype(np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.numerators(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        m = self.numerators(x)
        if m.dtype == object or float(abs(m).max()) ** 2 * m.shape[1] >= 2.0**62:
            exact = (m.astype(object) ** 2).sum(1)
            return [int(v) if v < 1 << 63 else None for v in exact]
        return (m * m).sum(1).tolist()

    @property
    def varies(self) -> np.ndarray:
        return self.eigenvalues > 64 * EPS * max(self.trace, 0) * len(self.sums)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.where(self.varies, self.centred(x) @ self.components / np.sqrt(np.where(self.varies, self.eigenvalues, 1)), np.nan)


def fit(vectors: DataFrame, work: Workspace, n_components: int = 8, together: int = TOGETHER) -> Whitening | None:
    """Spectra of the tasks, combined, refined over all vectors."""
    spectra = work.table(partition_spectra(vectors, together), "spectra")
    rough = combine_spectra(spectra, work)
    if rough is None:
        return None
    totals = spectra.select("n", F.posexplode("sums")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).orderBy("pos").collect()
    basis = rough.vectors[:, ::-1]
    whole = Whitening(totals[0].n, np.array([int(r.s) for r in totals], object), basis, rough.values[::-1], 0.0)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((basis.shape[1],) * 2)
        for batch in batches:
            if batch.num_rows:
                y = whole.centred(_matrix(batch)) @ basis
                own += y.T @ y
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([own.ravel()], pa.list_(pa.float64()))], names=["part"])

    d = len(whole.sums)
    ritz = _sum_by_position(vectors.mapInArrow(moments, "part array<double>"))
    ritz = ritz.reshape(d, d) / whole.n if len(ritz) else np.zeros((d, d))
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    take = np.argsort(-values, kind="stable")[:n_components]
    components = basis @ turn[:, take]
    return Whitening(whole.n, whole.sums, components / np.linalg.norm(components, axis=0), np.maximum(values[take], 0), float(np.trace(ritz)))


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """The largest entry, without sign, of the whitened vectors' covariance minus
    the identity, measured over all vectors."""
    k = int(model.varies.sum())
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((k, k + 1))
        for batch in batches:
            if batch.num_rows:
                w = model.whiten(_matrix(batch))[:, model.varies]
                own[:, :k] += w.T @ w
                own[:, k] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([own.ravel()], pa.list_(pa.float64()))], names=["part"])

    got = _sum_by_position(vectors.mapInArrow(run, "part array<double>")).reshape(k, k + 1) / model.n
    return float(np.abs(got[:, :k] - np.outer(got[:, k], got[:, k]) - np.eye(k)).max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, work: Workspace, n_components: int = 8, vector_col: str = "embedding", id_col: str = "vec_id",
           together: int = TOGETHER) -> DataFrame:
    """One row per vector that takes part and component."""
    vectors = usable(df, vector_col, id_col)
    model = fit(vectors, work, n_components, together)
    if model is None:
        return df.sparkSession.createDataFrame([], OUT)
    error = identity_error(vectors, model)
    k = model.components.shape[1]
    explained = model.eigenvalues / model.trace if model.trace > 0 else np.full(k, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.num_rows
                x = _matrix(batch)
                each = pa.array(np.repeat(np.arange(rows), k))
                nan = lambda v: pa.array(v, pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                     pa.array(np.full(rows * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(each), nan(model.whiten(x).ravel()),
                     nan(np.tile(explained, rows)), pa.array([error] * (rows * k), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, OUT)
