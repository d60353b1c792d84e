"""Helpers that the operators share: durable intermediate tables, exact components, byte utilities."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lakequill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lakequill/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    Cuts the lineage so that a lost executor costs a reread, never a recomputation of what stands above, and lets
    the planner see real sizes.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared store through Spark's own file system layer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def path_of(df: DataFrame) -> str:
    return df.inputFiles()[0].rsplit("/", 1)[0] if df.inputFiles() else ""


def release(*settled: DataFrame) -> None:
    """Delete settled tables that nothing will read again: all that used them has been settled itself."""
    for df in settled:
        if path := path_of(df):
            remove_path(df.sparkSession, path)


#: Bytes of an Arrow batch between the JVM and Python; a longer row is a batch of its own.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded by bytes, not by rows alone; a bound that is set already stays.

    Ten thousand texts in a batch, held by both sides and copied as buffers grow, else decide an executor's memory.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Types of the columns that operators add.
LONG, TEXT, FLAG, INTS = LongType(), StringType(), BooleanType(), ArrayType(IntegerType())


def wider(schema: StructType, *added: tuple[str, DataType]) -> StructType:
    """A new schema with more fields at its end."""
    return StructType([*schema.fields, *[StructField(n, t) for n, t in added]])


#: Bits of the map below: fixed, so that what is broadcast never grows (at most BITS / 64 rows).
BITS = 1 << 24
#: Columns of the map, under names that no table has.
WORD, MARKS = "__map word", "__map bits"


def may_hold(ids: DataFrame, key: str) -> DataFrame:
    """A map of fixed size (word, bits) that marks every id of ids, and others by chance, to be broadcast."""
    spot = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(BITS))
    spots = ids.select(spot.alias("spot")).select(F.expr("cast(spot div 64 as int)").alias(WORD), F.expr("shiftleft(1L, cast(spot % 64 as int))").alias("bit"))
    return spots.groupBy(WORD).agg(F.bit_or("bit").alias(MARKS))


def marked(rows: DataFrame, key: str, map_: DataFrame, held: bool = True) -> DataFrame:
    """The rows whose key the map marks (or those that it does not). No row moves."""
    spot = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(BITS))
    hit = (F.col(f"`{WORD}`") == (spot / 64).cast("int")) & (F.getbit(F.col(f"`{MARKS}`"), (spot % 64).cast("int")) == 1)
    return rows.join(F.broadcast(map_), hit, "left_semi" if held else "left_anti")


#: A node of more edges than this is dealt to SPREAD keys, by the hash of its neighbours.
HUB, SPREAD = 1 << 20, 64


def _told(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m of least (u, m, n: its number of edges); which nodes are hubs, every edge asks of n itself.

    A hub's rows carry the hash of their neighbour as a second key, and its minimum is repeated for each value of it. An
    edge does not know whether its node is a hub, so hubs are named by a table of at most 2 * edges / HUB rows.
    """
    hubs = least.where(F.col("n") > HUB).select(F.col("u").alias("_hub"))
    salted = edges.join(F.broadcast(hubs), F.col("u") == F.col("_hub"), "left").withColumn("_salt", F.when(F.col("_hub").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.lit(SPREAD))).cast("int")).drop("_hub")
    keys = least.withColumn("_salt", F.explode(F.when(F.col("n") > HUB, F.expr(f"sequence(0, {SPREAD - 1})")).otherwise(F.array(F.lit(0)))))
    return salted.join(keys.drop("n"), ["u", "_salt"]).drop("_salt")


def components(edges: DataFrame, what: str = "cc", rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b: long): one row (node, comp) per node, comp the smallest node reachable.

    Alternates large-star and small-star until the edge set is stable; every step is one shuffle of slim rows keyed by
    node, and each round goes to the shared store. Minima are partial aggregates. In the joins that hand a node's minimum to
    its neighbours, a hub (a node of more than HUB edges; there are at most 2 * edges / HUB of them) is dealt by
    neighbour too, so no task gathers a hub's neighbours.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), what)
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == before:
            break
        before = mark
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _told(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (
            _told(large, least)
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        old, now = now, settle(small, what)
        release(old)
    else:
        raise RuntimeError("components did not settle")
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(tops)
