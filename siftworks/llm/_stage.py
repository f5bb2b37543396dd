"""Shared-folder staging, input sizing and distributed connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a default is set, but only if driver and executors are one machine.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all machines share")
        named = "/tmp/checkpoints"
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


#: Paths of staged tables that are still there, by application.
_STAGED: dict[str, list[str]] = {}


def staged_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path  # type: ignore[attr-defined]
    return out


def unstage(df: DataFrame | None) -> None:
    """Delete a staged table that no later step reads."""
    path = getattr(df, "_staged_at", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    own = _STAGED.get(spark.sparkContext.applicationId, [])
    if path in own:
        own.remove(path)


def clear(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Delete all staged tables of this application but ``keep``: for callers whose results are written.

    A result that is not written yet may still read staged tables, so operators themselves only delete
    what nothing reads any more.
    """
    for path in list(_STAGED.get(spark.sparkContext.applicationId, [])):
        if path != getattr(keep, "_staged_at", None):
            _delete(spark, path)


def bounded_batches(spark: SparkSession) -> None:
    """Send rows to Python in batches of a few megabytes, however long the texts are.

    The default of 10,000 rows is some 30 MB of text, held several times over on both sides.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def pieces(df: DataFrame, least: int = 128) -> int:
    """Number of work blocks: follows the number of input splits, so a block's size stays the same at any scale."""
    spark = df.sparkSession
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return max(least, splits, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def _edge_state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges``: columns u, v (long). Returns (node, root), root the smallest node of the component,
    for every node that has an edge. Every round is two grouped minima and a join whose skewed side
    AQE may split; the edge set is staged in the shared folder after each round, and the former one
    deleted, so lineage and disk stay bounded. Nulls and self-loops are ignored; an empty input gives
    an empty result.
    """
    edges = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    current = stage(edges, "cc")
    before = _edge_state(current)
    for _ in range(max_rounds):
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # least(u, m) = v's new parent; a node with no larger neighbour keeps its edge from the other side
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = stage(small, "cc")
        unstage(current)
        current, state = after, _edge_state(after)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = current.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
