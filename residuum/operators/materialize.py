"""Pinning a frame that several jobs (or several branches of one plan) read,
and deleting what was stored for it.

What a plan stores belongs to the frame it returns: ``release(frame)`` deletes
it, and ``with stored():`` deletes all that was stored inside the block.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

#: Folders that were stored and not released yet.
_live: list[str] = []
_STORES = "_residuum_stores"


def new_store(spark: SparkSession) -> str | None:
    """A fresh folder under the shared checkpoint folder, if one is named."""
    base = checkpoint_dir(spark)
    if base is None:
        return None
    path = f"{base.rstrip('/')}/residuum-{uuid.uuid4().hex}"
    _live.append(path)
    return path


def owns(df: DataFrame, *sources: DataFrame | str | None) -> DataFrame:
    """Let ``df`` own what its sources stored (frames, or paths)."""
    paths = list(getattr(df, _STORES, ()))
    for s in sources:
        paths += [s] if isinstance(s, str) else list(getattr(s, _STORES, ())) if s is not None else []
    setattr(df, _STORES, tuple(dict.fromkeys(paths)))
    return df


def _delete(path: str) -> None:
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    if fs.get_file_info(at).type == pafs.FileType.Directory:
        fs.delete_dir(at)
    if path in _live:
        _live.remove(path)


def release(df: DataFrame | None) -> None:
    """Delete the folders ``df`` owns, or drop it from memory if it is held
    there.  The frame cannot be read afterwards."""
    if df is None:
        return
    for path in getattr(df, _STORES, ()):
        _delete(path)
    setattr(df, _STORES, ())
    if df.storageLevel.useMemory:
        df.unpersist()


@contextmanager
def stored():
    """Delete on leaving whatever was stored inside the block."""
    before = set(_live)
    try:
        yield
    finally:
        for path in [p for p in _live if p not in before]:
            _delete(path)


def materialize(df: DataFrame, how: str = "auto") -> DataFrame:
    """Compute ``df`` once and return a frame that reads the stored result.

    ``table``    a Parquet table in the shared folder named by
                 ``spark.checkpoint.dir``: lineage cut, columns read as needed,
                 a lost executor costs a re-read.  What ``auto`` means.
    ``checkpoint`` Spark's reliable checkpoint into the same folder (whole
                 rows; Spark's cleaner owns its files).
    ``persist``  memory and local disk; a lost executor recomputes its blocks
                 from lineage.
    ``none``     returns ``df`` unchanged.

    ``table`` and ``checkpoint`` raise ``ValueError`` when no shared folder is
    named: which strategy runs never depends on the session.
    """
    if how in ("auto", "table"):
        path = new_store(df.sparkSession)
        if path is None:
            raise ValueError("storing a frame needs spark.checkpoint.dir (or materialise='persist')")
        df.write.mode("errorifexists").parquet(path)
        return owns(df.sparkSession.read.schema(df.schema).parquet(path), path)
    if how == "checkpoint":
        if checkpoint_dir(df.sparkSession) is None:
            raise ValueError("a checkpoint needs spark.checkpoint.dir")
        return df.checkpoint(eager=True)
    if how == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if how == "none":
        return df
    raise ValueError(f"unknown materialisation {how!r}")
