"""What the operators share: intermediate tables in the shared folder, Arrow batches, column checks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


#: Rows (some tens of bytes each) up to which a side of a join is broadcast.
MOST_SIDE = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on one machine (as in
    tests) takes a local folder; any other needs the setting, as its executors do not see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"{tempfile.gettempdir()}/checkpoints").rstrip("/")


def side(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast to a join if it has few rows; else it is met by shuffle."""
    return F.broadcast(table) if table.limit(MOST_SIDE + 1).count() <= MOST_SIDE else table


def release(result: DataFrame, paths: list[str]) -> None:
    """Delete those of the tables at paths that result does not read."""
    read = result.inputFiles()
    names = {part for file in read for part in file.split("/")}
    remove(result.sparkSession, [p for p in paths if p.rsplit("/", 1)[-1] not in names])


def unique() -> str:
    return uuid.uuid4().hex


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{unique()}"
    _written.append(path)
    return path


def materialize(df: DataFrame, tag: str, group_mb: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and an executor that is
    lost afterwards takes nothing with it. group_mb bounds row groups: where rows are long, a reader's batch is a row group."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    out = df.write.option("compression", "zstd")
    (out.option("parquet.block.size", group_mb << 20) if group_mb else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def written() -> Iterator[list[str]]:
    """The paths of the tables that are written inside the block."""
    before, found = len(_written), []
    yield found
    found += _written[before:]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that no frame still needs."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(hadoop).delete(path, True)
    paths.clear()


def free(spark: SparkSession) -> None:
    """Let the shuffle files of finished steps go: Spark deletes them when no frame on the driver refers to them any more. The
    second collection sees what the first one, and Python's own, have let go in the meantime."""
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.5)
    spark._jvm.System.gc()


def arrow_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 16) -> None:
    """Bound the batches that go to and from Python, for this session: workers and the JVM hold some at a time, whatever the
    texts' length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)


def give_back() -> None:
    """Return memory that a reused Python worker still holds from earlier tasks to the system, where that is possible."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives memory back when its task ends, as its worker may idle beside others."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def emit(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
