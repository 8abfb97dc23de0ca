"""Lineage cuts and scratch locations on shared storage.

Long jobs reuse a few small intermediate tables (class labels, genre
membership).  Keeping them only in executor memory (``persist``) or on
executor-local disk loses them with the executor; ``checkpoint`` writes them
to the cluster's shared checkpoint folder (``spark.checkpoint.dir``) and cuts
the lineage, so a lost executor costs a re-read, not a recomputation.

Such a table lives until it is released: by ``release``, by the last reader of a ``Shared`` one, or at the end of the
``lifetime`` it was made in.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session: the one set on the context, or ``spark.checkpoint.dir``.

    Only a local session without either (a test) gets a fresh temporary folder; on a cluster the executors could not
    see it, so a missing setting is an error there."""
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session has no local context
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured and sc is not None:
        configured = sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if sc is None or not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError(f"{CHECKPOINT_CONF} is not set: a folder that driver and executors share is needed")
        configured = tempfile.mkdtemp(prefix="readlens-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, configured)
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for written results; it goes with the ``lifetime`` it is
    made in."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    on_end(lambda: delete_folder(spark, path))
    return path


def materialize(df: DataFrame, mode: str = "checkpoint") -> DataFrame:
    """``checkpoint``: write to the shared checkpoint folder and cut lineage;
    ``persist``: keep in executor memory/disk (a lost executor recomputes its
    part from lineage); ``none``: return ``df`` unchanged.

    Within a ``lifetime`` the table is freed when that ends; otherwise ``release`` frees it."""
    if mode == "none":
        return df
    if mode == "persist":
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
    elif mode == "checkpoint":
        checkpoint_dir(df.sparkSession)
        out = df.checkpoint(eager=True)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    on_end(lambda: release(out))
    return out


def checkpoint_folder(df: DataFrame) -> str | None:
    """The folder that ``materialize(df)`` wrote, for the DataFrame it returned; None for any other."""
    try:
        found = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    except Exception:  # not the plan of a checkpoint: nothing to name
        return None
    return found.get() if found.isDefined() else None


def delete_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)


def release(*dfs: DataFrame) -> None:
    """Gives back what ``materialize`` holds: cached blocks, or the files of a checkpoint.  The table, and whatever is
    derived from it and not computed yet, can't be read any more after its checkpoint has gone."""
    for df in dfs:
        df.unpersist()
        folder = checkpoint_folder(df)
        if folder:
            delete_folder(df.sparkSession, folder)


# ---- lifetimes -------------------------------------------------------------------------
_ENDINGS: ContextVar[list[Callable[[], None]] | None] = ContextVar("readlens_endings", default=None)


def on_end(free: Callable[[], None]) -> None:
    """Calls ``free`` when the surrounding ``lifetime`` ends; without one nothing happens, and the session keeps it."""
    endings = _ENDINGS.get()
    if endings is not None:
        endings.append(free)


@contextmanager
def lifetime() -> Iterator[None]:
    """Tables that end together: whatever is materialised, written to scratch or broadcast inside is freed when the
    block ends, the last made first.  Results must be written or collected before.  Lifetimes nest; each frees its
    own."""
    endings: list[Callable[[], None]] = []
    token = _ENDINGS.set(endings)
    try:
        yield
    finally:
        _ENDINGS.reset(token)
        for free in reversed(endings):
            free()


class Shared:
    """A reused table with a known number of readers; the last to finish frees it.

    ``with table.reading() as df:`` is one reader.  A reader that fails counts as finished."""

    def __init__(self, df: DataFrame, readers: int, mode: str = "checkpoint") -> None:
        if readers < 1:
            raise ValueError("a shared table has at least one reader")
        self._table, self._left, self._lock = materialize(df, mode), readers, Lock()

    @property
    def left(self) -> int:
        """Readers that have not finished."""
        return self._left

    @contextmanager
    def reading(self) -> Iterator[DataFrame]:
        if self._left < 1:
            raise RuntimeError("the table was freed by its last reader")
        try:
            yield self._table
        finally:
            with self._lock:
                self._left -= 1
                last = self._left == 0
            if last:
                release(self._table)
