"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: While a table is written: shuffle files go with the execution, as nothing reads them again, and record batches for Python stay small.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
_lock = threading.Lock()
_writers: dict[str, list] = {}
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir.  A temporary one only where that is unset and all tasks run in this process; else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _own:
            own = tempfile.mkdtemp(prefix="orbitlens-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _own["dir"] = "file://" + own
        where = _own["dir"]
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder's owner cleans it
        pass


class Scratch:
    """The tables that `saved` writes while this is the innermost scope of its thread (`with own:`); `close` removes them.

    Tables given to `keep` pass to the scope around it.  Those outside any scope, and those that an outermost one keeps because a lazy result reads them,
    go when the interpreter ends.
    """

    def __init__(self):
        self.tables: dict[str, SparkSession] = {}

    def __enter__(self) -> Scratch:
        _stack().append(self)
        return self

    def __exit__(self, *_) -> None:
        _stack().remove(self)

    def keep(self, df: DataFrame) -> DataFrame:
        spark, around = self.tables.pop(df.scratch_path, None), _stack()
        if spark is not None and self in around and around.index(self):
            around[around.index(self) - 1].tables[df.scratch_path] = spark
        return df

    def close(self) -> None:
        for path, spark in self.tables.items():
            _remove(spark, path)
        self.tables = {}


def _stack() -> list[Scratch]:
    if not hasattr(_scopes, "stack"):
        _scopes.stack = []
    return _scopes.stack


@contextlib.contextmanager
def scratch():
    """A scope whose tables go at its end."""
    with Scratch() as own:
        try:
            yield own
        finally:
            own.close()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


@contextlib.contextmanager
def _writing(spark: SparkSession):
    """The settings of _WRITING hold; what the session had comes back when the last of its writers ends."""
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        state = _writers.setdefault(session, [0, {}])
        if not state[0]:
            state[1] = {k: spark.conf.get(k, None) for k in _WRITING}
        state[0] += 1
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                for k, v in state[1].items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: cuts the lineage, survives lost executors.

    The write's shuffle files go when it has ended, not when the driver next collects garbage; the table goes with its scope (`scratch`).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _stack():
        _stack()[-1].tables[path] = spark
    with _writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `saved` that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df.scratch_path)
