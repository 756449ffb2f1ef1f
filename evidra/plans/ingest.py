"""Queries over what comes in: answers in JSON and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import batches
from ..sources import store as T
from ..streaming import append
from .prelude import sql
from .registry import query

ORDERS = """asked as (select 'c:'||o_custkey batch, o_orderkey k, o_orderpriority gist, row_number() over (partition by o_custkey order by o_orderkey) - 1 i from orders),
seen as (select *, lag(k) over (partition by batch order by i) p, (k % 7 = 0 or k % 11 = 0)::int own, sum((k % 7 = 0 or k % 11 = 0)::int) over (partition by batch, i // 3 order by i) bad from asked)"""


def answers(spark, d):
    """(batch, text): each customer's orders as one answer, fenced for odd customers.

    Two of three orders rest on the one before; every seventh has a type that isn't
    one, every eleventh no gist, and what rests on those falls with them.
    """
    o, key = T.table(spark, d, "orders"), F.col("o_orderkey")
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rests = i % 3 != 0
    rows = o.select(
        "o_custkey", i.alias("i"), F.when(key % 7 == 0, "thought").otherwise("finding").alias("type"), F.concat(F.lit("o"), key).alias("label"), F.when(key % 11 == 0, "").otherwise(F.col("o_orderpriority")).alias("gist"),
        F.when(rests, "inferred").otherwise("speculative").alias("status"), F.when(rests, F.array(F.concat(F.lit("o"), before))).alias("grounds"),
    )
    unit = F.struct("i", F.struct("type", "label", "gist", "status", "grounds").alias("unit"))
    one = rows.groupBy("o_custkey").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(unit)), lambda x: x["unit"]).alias("units"))).alias("text"))
    return one.select(T.node("c", "o_custkey").alias("batch"), F.when(F.col("o_custkey") % 2 == 1, F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).otherwise(F.col("text")).alias("text"))


@query(sql("select batch, i, 'j:'||batch||'-'||i uid, 'o'||k \"label\", gist, case when i % 3 = 0 then 1 else 2 end status, case when i % 3 <> 0 then 'j:'||batch||'-'||(i - 1) end ground from seen where bad = 0", ORDERS))
def batch_units(spark, d):
    """The units of answers that are sound and rest on sound ones."""
    made = batches.convert(answers(spark, d))
    return made.units.join(made.edges.select("batch", F.col("src").alias("uid"), F.col("dst").alias("ground")), ["batch", "uid"], "left").select("batch", "i", "uid", "label", "gist", "status", "ground")


@query(sql("""select batch, 'unit' part, i, 'E001' code, 'thought is no type' message from seen where k % 7 = 0
  union all select batch, 'unit', i, 'E001', 'missing or empty gist' from seen where k % 11 = 0
  union all select batch, 'unit', i, 'E060', 'grounds names unknown o'||p from seen where i % 3 <> 0 and bad > own""", ORDERS))
def batch_diagnostics(spark, d):
    """What is wrong with the others, each fault by itself."""
    return batches.convert(answers(spark, d)).diagnostics


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc, event_type desc) n from events) where n = 1")
def stream_registers(spark, d):
    """Events as a stream into registers: each user's latest."""
    path, key, clock = f"{T._own_dir(spark)}/{uuid.uuid4().hex}", ["user_id"], ["ts", "event_id"]
    events = T.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    stream = spark.readStream.schema(T.table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet").select(*events.columns)  # a pattern, for a single file is no base folder
    append.register(stream, f"{path}/log", f"{path}/checkpoint", key, clock).awaitTermination()
    return append.registers(spark, f"{path}/log", events.schema, key, clock).select("user_id", "event_type", "event_id")
