"""Streams of shuffled and repeated micro-batches against one batch."""

import random

from evidra.operators import merge
from evidra.streaming import append

SCHEMA = "uid string, wall long, agent string, value int"


def sent(spark, tmp_path, seed):
    """Files of rows, some sent several times, in any order; a micro-batch each."""
    rng = random.Random(seed)
    rows = [(f"u{rng.randint(0, 9)}", rng.randint(0, 20), rng.choice("ab"), rng.choice([None, 1, 2, 3])) for _ in range(60)]
    every = rows + rng.choices(rows, k=60)
    rng.shuffle(every)
    for i in range(0, len(every), 20):
        spark.createDataFrame(every[i : i + 20], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return spark.createDataFrame(rows, SCHEMA), stream


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_log_equals_one_merge(spark, tmp_path):
    rows, stream = sent(spark, tmp_path, 1)
    out, checkpoint = f"{tmp_path}/log", f"{tmp_path}/checkpoint"
    append.append(stream, out, checkpoint).awaitTermination()
    got = append.log(spark, out, rows.schema, ["uid", "wall"])
    assert table(got.select(*rows.columns)) == table(merge.merged(rows, rows.limit(0), ["uid", "wall"]).select(*rows.columns))
    kept = spark.read.parquet(out)
    assert kept.count() == rows.distinct().count() and kept.select("batch").distinct().count() >= 4


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """A stream that lost its last commit's record sends that batch again; more rows then go on from there."""
    rows, stream = sent(spark, tmp_path, 2)
    out, checkpoint = f"{tmp_path}/log", f"{tmp_path}/checkpoint"
    append.append(stream, out, checkpoint).awaitTermination()
    before = table(spark.read.parquet(out))
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    append.append(stream, out, checkpoint).awaitTermination()
    assert table(spark.read.parquet(out)) == before
    spark.createDataFrame([("new", 1, "a", 1), tuple(rows.first())], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    append.append(stream, out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == len(before) + 1


def test_registers(spark, tmp_path):
    rows, stream = sent(spark, tmp_path, 3)
    out = f"{tmp_path}/registers"
    append.register(stream, out, f"{tmp_path}/checkpoint", ["uid"], ["wall", "agent"]).awaitTermination()
    got = append.registers(spark, out, rows.schema, ["uid"], ["wall", "agent"])
    assert table(got) == table(merge.last_writer(rows, ["uid"], ["wall", "agent"]).select(*rows.columns))
