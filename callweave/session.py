"""Session builder, the shared scratch folder, and the size checks behind every broadcast."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, NumericType, StringType, StructType

# A side is broadcast only when it has been shown to hold at most so many rows, and so many bytes as rows in memory.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20
# Word lists up to this length become an IN-set literal; longer ones are joined.
LITERAL_WORDS = 20_000
# A model (centres, projection) travels to the tasks only below this many bytes.
MODEL_BYTES = 64 << 20


def build_session(app: str = "callweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a temporary folder of its own; on a cluster
    a missing setting is an error, because a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    own = tempfile.mkdtemp(prefix="callweave-")
    spark.sparkContext.setCheckpointDir(own)
    return (spark.sparkContext.getCheckpointDir() or own).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a frame feeds several jobs. It cuts the lineage, survives the loss of executors and
    lets later readers prune columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory: its strings and arrays by their length, and eight bytes a field."""
    sizes = [F.lit(32 + 16 * len(df.columns))]
    for field in df.schema.fields:
        kind, c = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (StringType, BinaryType)):
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(kind, ArrayType) and isinstance(kind.elementType, NumericType):
            sizes.append(8 * F.coalesce(F.array_size(c), F.lit(0)))
        elif isinstance(kind, (ArrayType, MapType, StructType)):
            sizes.append(4 * F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)))
    return reduce(lambda a, b: a + b, sizes).cast("long")


def is_small(df: DataFrame) -> bool:
    """True when ``df`` has at most ``BROADCAST_ROWS`` rows, which take at most ``BROADCAST_BYTES``; reads no more rows than that plus one."""
    head = df.limit(BROADCAST_ROWS + 1)
    rows, held = head.select(held_bytes(df).alias("b")).agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES


def checked_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a side whose size has been measured; leave it to a shuffle join beyond the bound.

    The side is written first, so measuring it and joining it do not compute it twice.
    """
    side = materialise(df, "side")
    return F.broadcast(side) if is_small(side) else side


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key into the configured number of partitions.

    The number is explicit, so adaptive execution does not merge partitions that look small before
    their rows are exploded. Later groupings that include the key reuse this partitioning.
    """
    return df.repartition(shuffle_partitions(df.sparkSession), *keys)


def fill_slots(df: DataFrame, *key: str) -> DataFrame:
    """Spread a scan that has fewer splits than there are task slots, evenly if no key is given; leave any larger scan alone.

    A small file with one row group is one task otherwise, however costly the work on its rows.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, *key) if df.rdd.getNumPartitions() < slots else df
