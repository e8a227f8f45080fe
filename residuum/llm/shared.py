"""Shared-folder and Arrow helpers of the training-data operators.

Intermediate tables and files go to the folder that the session names in
``spark.checkpoint.dir``, which the driver and all executors reach.  Only a
local session without that setting gets a scratch folder of its own.
"""

from __future__ import annotations

import ctypes
import posixpath
import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from residuum.llm.bytewords import forget_powers

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Raises ``ValueError`` when it is unset on anything but a local session: no
    other place is known to be reachable from every executor.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local") or "cluster" in spark.conf.get("spark.master"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="residuum-llm-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a folder and the path in it."""
    if urlparse(uri).scheme:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of text that go to a Python worker at a time.  Spark's own default of
#: 10,000 makes batches of some thirty MB, held several times over.
TEXT_ROWS = 2_000


def text_batches(spark: SparkSession) -> None:
    """Let texts go to Python in smaller batches, unless the session says
    otherwise.  Applications call this; the operators leave the session alone."""
    if spark.conf.get(ARROW_ROWS, None) == "10000":
        spark.conf.set(ARROW_ROWS, str(TEXT_ROWS))


class Workspace:
    """A fresh folder under the shared root that owns what an operator stores.

    ``table`` cuts the lineage of a frame with a Parquet table; ``release``
    deletes the folder once the results that read it are no longer needed.  It
    is also a context manager.  ``live`` lists those not released yet.
    """

    live: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.uri = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._used: dict[str, int] = {}
        Workspace.live.append(self)

    def path(self, name: str) -> str:
        """A place in the folder that was not given out before."""
        n = self._used[name] = self._used.get(name, 0) + 1
        return f"{self.uri}/{name}-{n}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return a frame that reads it."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        """Make a folder for files that tasks write themselves."""
        folder = self.path(name)
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        return folder

    def release(self) -> None:
        fs, path = filesystem(self.uri)
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            fs.delete_dir(path)
        if self in Workspace.live:
            Workspace.live.remove(self)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *exc) -> None:
        self.release()


_held: dict[str, object] = {}
#: glibc's way to return free pages; other C libraries do so by themselves.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def held(name: str, make):
    """What a Python worker remembers between tasks: one thing at a time, so
    that operators that follow one another do not add up in its memory."""
    if name not in _held:
        forget()
        _held[name] = make()
    return _held[name]


def _give_back() -> None:
    """Return what was freed to the system: Arrow's pool and the C heap keep it
    otherwise, and an executor's workers and its JVM share one limit."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def forget() -> None:
    """Begin a task of an operator that remembers nothing: give back what an
    earlier one remembered and what freed Arrow buffers still hold."""
    _held.clear()
    forget_powers()
    _give_back()


def attempt_name(prefix: str, suffix: str) -> str:
    """A file name that no other attempt of the task uses; only names that a
    finished task returned are ever read."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


def join_path(folder: str, name: str) -> str:
    return posixpath.join(folder, name)


def slices(batch: pa.RecordBatch, column: str | int, max_bytes: int = 1 << 20):
    """Slices of a batch that hold about ``max_bytes`` of a string or binary
    column each (a longer single value is a slice of its own)."""
    n = batch.num_rows
    col = batch.column(column)
    start, size = 0, 0
    _give_back()
    lengths = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
    for i in range(n):
        if i > start and size + lengths[i] > max_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(lengths[i])
    if start < n:
        yield batch.slice(start, n - start)
