"""Order-dependent operators: row numbers over a whole table, running totals, prefixes, decimation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Size of a range partition by the optimiser's estimate, and how many there are at most.
PART_BYTES, MOST_PARTS = 128 << 20, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a default only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if not have.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all machines share")
        sc.setCheckpointDir(named or "/tmp/checkpoints")
        have = sc._jsc.sc().getCheckpointDir()
    return have.get()


def staged(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/order-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *keys: Column, name: str = "index", totals: dict[str, Column] | None = None) -> DataFrame:
    """1-based row numbers in the order of ``keys`` (which must be unique), and running sums of ``totals``.

    Range-partitioned by one shuffle into parts of about PART_BYTES, so no task orders the whole table: each
    partition is sorted and numbers its own rows, and adds the sums of those before it, one row a partition.
    Only running totals need their partition once more. The sorted table is staged, since the bounds of a
    range partitioning are sampled and a second evaluation might cut elsewhere.
    """
    totals = totals or {}
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PART_BYTES), MOST_PARTS))
    # the number of a row in its sorted partition is in the low 33 bits
    cut = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_order_at", F.monotonically_increasing_id())
    cut = staged(cut).withColumn("_order_part", F.shiftright("_order_at", 33))
    sums = [F.count(F.lit(1)).alias("_order_n"), *[F.sum(c).alias(f"_order_sum_{k}") for k, c in totals.items()]]
    before = Window.orderBy("_order_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("_order_part").agg(*sums)
    shift = [F.coalesce(F.sum("_order_n").over(before), F.lit(0)).alias("_order_before"), *[F.coalesce(F.sum(f"_order_sum_{k}").over(before), F.lit(0)).alias(f"_order_before_{k}") for k in totals]]
    # one row a partition: never more than MOST_PARTS or spark.sql.shuffle.partitions
    offsets = F.broadcast(offsets.select("_order_part", *shift))
    inside = Window.partitionBy("_order_part").orderBy("_order_at").rowsBetween(Window.unboundedPreceding, 0)
    out = cut.select("*", *[F.sum(c).over(inside).alias(f"_order_run_{k}") for k, c in totals.items()]).join(offsets, "_order_part")
    number = F.col("_order_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.col("_order_before")
    return out.select(*df.columns, number.cast("long").alias(name), *[(F.col(f"_order_run_{k}") + F.col(f"_order_before_{k}")).alias(k) for k in totals])


def top_k(df: DataFrame, k: int, *keys: Column) -> DataFrame:
    """The k smallest by ``keys``: a bounded heap a task, merged by the driver's plan, never a full sort."""
    return df.orderBy(*keys).limit(k)


def decimated(df: DataFrame, capacity: int, *keys: Column) -> DataFrame:
    """At most ``capacity`` rows at an even stride, the smallest power of two that fits; the first row stays."""
    rows = numbered(df, *keys, name="_index")
    n = rows.count()
    stride = 1
    while (n - 1) // stride + 1 > capacity and n:
        stride *= 2
    return rows.where((F.col("_index") - 1) % stride == 0).withColumn("position", F.col("_index") - 1).drop("_index")


def last_of_consecutive(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """Of neighbours in order with an equal key only the last; a row is kept if its successor differs.

    Successors are found by row number in a join on the number, so no task sees the whole order.
    """
    rows = numbered(df, *order, name="_index")
    after = rows.select((F.col("_index") - 1).alias("_index"), F.col(key).alias("_next"), F.lit(True).alias("_has"))
    joined = rows.join(after, "_index", "left")
    return joined.where(F.col("_has").isNull() | ~F.col(key).eqNullSafe(F.col("_next"))).select(*df.columns)
