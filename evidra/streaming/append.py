"""A store's log as a stream: micro-batches are commits, and a batch that comes again changes nothing.

Each micro-batch writes the partition of its number, replacing what an attempt before
it left there. Rows seen before are dropped by the stream's state, so the log holds
each row once whatever is sent again, and reading it merges rows of one key as a batch
merge does: the largest stays, in whatever order they came. Registers keep the row
with the latest clock in the stream's state and write what a batch changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import last_writer, merged

#: The column that names the micro-batch of a row.
BATCH = "batch"


def _commits(rows: DataFrame, path: str, checkpoint: str, mode: str, trigger: dict | None) -> StreamingQuery:
    def commit(batch: DataFrame, number: int) -> None:
        # a partition of its own, so that an attempt before this one is replaced as a whole
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(commit).trigger(**(trigger or {"availableNow": True})).start()


def append(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, event_time: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Starts the stream `rows` into the log at path; rows seen before are dropped.

    The state holds a digest of every row; with event_time only those of the last
    `late`, and a row that comes again after that is dropped when the log is read.
    Both path and checkpoint lie in a folder that all machines share.
    """
    digest = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256)
    keyed = rows.withColumn("evidra_digest", digest)
    fresh = keyed.dropDuplicates(["evidra_digest"]) if event_time is None else keyed.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["evidra_digest"])
    return _commits(fresh.drop("evidra_digest"), path, checkpoint, "append", trigger)


def register(rows: DataFrame, path: str, checkpoint: str, key: list[str], clock: list[str], trigger: dict | None = None) -> StreamingQuery:
    """Starts a stream of registers: of each key the row with the latest clock, the largest of equal ones."""
    return _commits(last_writer(rows, key, clock).select(*rows.columns), path, checkpoint, "update", trigger)


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def log(spark: SparkSession, path: str, schema, key: list[str]) -> DataFrame:
    """The log's rows, those of one key merged; the same as one batch merge of all that was sent."""
    rows = _read(spark, path, schema)
    return merged(rows, rows.limit(0), key)


def registers(spark: SparkSession, path: str, schema, key: list[str], clock: list[str]) -> DataFrame:
    """The registers as of the last commit: what a later batch wrote for a key has the later clock."""
    return last_writer(_read(spark, path, schema), key, clock).select(*schema.names)
