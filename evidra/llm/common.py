"""Shared folders, written intermediate tables and size-checked joins."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that end a word here.
SPACE = r"[\x20\x09-\x0D]"
#: Rows and bytes up to which a side of a join may be broadcast; measured before each use.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir.

    Where that setting is absent, a local session (as in tests) gets a temporary
    folder, set once; on a cluster that is an error, for each executor would write
    to its own disk. All folders of an application lie in one; see clean.
    """
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="evidra-"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/evidra-{sc.applicationId}"


def kept(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again; with by, a folder for each value of that column.

    It cuts lineage as a checkpoint does, but columnar and compressed, and later
    readers prune columns. Losing an executor loses nothing of it.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    out = df.write.partitionBy(by) if by else df.write
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def remove(df: DataFrame) -> None:
    """Delete the files of a kept table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete all kept tables of this application: for its owner to call when the results are written.

    Results read kept tables when they are computed, so an operator can't delete
    those itself; it removes what only its own loops read.
    """
    _delete(spark, _own_dir(spark))


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of their values about: one aggregate."""
    width, sums = 0, []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            sums.append(F.sum(F.octet_length(f.name) + 16))
        elif kind == "array":
            sums.append(F.sum(8 * F.size(f.name) + 16))
        else:
            width += 8
    row = df.agg(F.count("*"), *sums).first()
    return row[0], width * row[0] + sum(x or 0 for x in row[1:])


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", size: tuple[int, int] | None = None) -> DataFrame:
    """Join where right may be small: broadcast when its measured rows and bytes are few.

    Otherwise Spark shuffles both sides, and its adaptive execution splits
    partitions that one key fills. size: what measured says of right, or more.
    """
    n, width = measured(right) if size is None else size
    return left.join(F.broadcast(right) if n <= BROADCAST_ROWS and width <= BROADCAST_BYTES else right, on, how)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, a function for mapInArrow, that gives the memory it no longer uses back to the system when a task ends.

    Spark keeps a task's Python worker for a minute, so what its allocators hold counts
    beside the stage that runs then.
    """

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            trimmed()

    return run


def trimmed() -> None:
    """Give memory that Python and Arrow hold unused back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other systems have none
    if trim:
        trim(0)


def text_of(column: str = "text") -> Column:
    """The text, or the empty one for a null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
