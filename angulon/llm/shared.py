"""Where intermediate tables go, and the split of labelled rows."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where none is set, one is made for local sessions, as in tests; on a cluster that is an error, since a folder of one
    machine would hide the rows that other machines write.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        path = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written once as Parquet in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that ``stored`` gave and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def free_exchanges(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that nothing refers to any more; it does so as garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows that a task of a small table takes.
TASK_ROWS = 20_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has about ``rows`` rows, in no more partitions than these need: iterations over small tables would
    else spend their time on empty tasks. Tables with many rows keep their partitions."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


#: Memory of a worker process below which it keeps what it has.
KEPT_MB = 120


def release_memory() -> None:
    """Gives memory that a worker process no longer uses back to the machine: workers outlive their tasks."""
    try:
        with open("/proc/self/statm") as f:
            if int(f.read().split()[1]) * 4096 < KEPT_MB << 20:
                return
    except OSError:  # a system without it
        pass
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library that has it
        return


def releasing(of: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of a task's batches that gives its memory back when the task is done."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from of(batches)
        finally:
            release_memory()

    wrapped.__annotations__ = dict(of.__annotations__)
    return wrapped


def id_remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def scratch(names: list[str], *wanted: str) -> list[str]:
    """For each wanted name one that no column has, whatever the case: Spark's names differ by more than case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
