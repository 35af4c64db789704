"""What the operators share: reading tables, the shared folder, row packing and checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A token is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Tables up to this many rows may be broadcast; each caller's rows have a fixed width.
BROADCAST_ROWS = 200_000

#: Most rows of a batch that goes to a Python worker.
DOCUMENTS = 1000

#: What scratch() has collected so far, in the context that runs.
_scope: ContextVar[list[str] | None] = ContextVar("_scope", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder of this
    machine serves a local master, as in tests; a cluster has to name one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def _hadoop(spark: SparkSession, path: str):
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), held


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It goes when the scratch() about it ends, else with the driver (see written)."""
    path = f"{shared_dir(spark).rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"
    if (paths := _scope.get()) is not None:
        paths.append(path)
    return path


def written(spark: SparkSession, path: str) -> str:
    """path, which has been written, to be deleted when the driver's file systems close."""
    fs, held = _hadoop(spark, path)
    fs.deleteOnExit(held)
    return path


def delete(spark: SparkSession, path: str) -> None:
    fs, held = _hadoop(spark, path)
    fs.delete(held, True)


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives the loss of executors. narrow: rows so
    short that Spark is to gather them into files of its usual size first."""
    path = shared_path(df.sparkSession, name)
    (df.hint("rebalance") if narrow else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(written(df.sparkSession, path))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators have stored within it; for callers who write out their results inside."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            delete(spark, path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session's executors, once a session. Rows are whole documents,
    so the batches that go to those workers are kept to DOCUMENTS rows."""
    context = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, DOCUMENTS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", DOCUMENTS)
    if getattr(context, "_millrace_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    with tempfile.NamedTemporaryFile(prefix="millrace-", suffix=".zip", delete=False) as held, zipfile.ZipFile(held, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(held.name)
    context._millrace_sent = True


_made: dict = {}


def remembered(key: str, make, *args):
    """make(*args), kept in a Python worker from task to task under the digest of what it is made of; the last one only."""
    if (make.__qualname__, key) not in _made:
        _made.clear()
        _made[make.__qualname__, key] = make(*args)
    return _made[make.__qualname__, key]


def free() -> None:
    """Gives memory that this process no longer needs back to the system."""
    gc.collect()
    if arrow := sys.modules.get("pyarrow"):
        arrow.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lookup(rows: DataFrame, small: DataFrame, keys: list[str], n_small: int, spread: Column, how: str = "inner") -> DataFrame:
    """rows joined with small on keys, null-safe. small is broadcast if its counted rows are within the bound;
    beyond that it is joined by shuffle, with each key's rows dealt to 16 salts so that no key fills one task."""
    small = small.select([F.col(c).alias(f"__s_{c}") if c in keys else F.col(c) for c in small.columns])
    on = [F.col(k).eqNullSafe(F.col(f"__s_{k}")) for k in keys]
    if n_small <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(small), on, how)
    else:
        salted = small.withColumn("__salt_s", F.explode(F.sequence(F.lit(0), F.lit(15))))
        out = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(16)).cast("int")).join(salted, [*on, F.col("__salt") == F.col("__salt_s")], how).drop("__salt", "__salt_s")
    return out.drop(*[f"__s_{k}" for k in keys])
