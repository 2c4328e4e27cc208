"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even if a later aggregate must then shuffle again.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
#: Tables estimated larger than this are never broadcast: built on the driver, a hash table takes about thirty
#: times the bytes of narrow rows (10 MB of points made 327 MB), and a query holds several at once.
MOST_BROADCAST = 1024 * 1024
#: Parquet files are taken for this many times their bytes where Spark estimates a table's size: a column of keys
#: packs into a byte a row, so that rows for hundreds of MB of hash tables were estimated below the limit.
UNPACKED = 30.0
BROADCASTS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def _bytes(size: str) -> int:
    """Bytes of a size as Spark writes it: 10485760b, 10MB, 256k, -1."""
    number = size.strip().lower().removesuffix("b")
    power = "kmgt".find(number[-1:]) + 1 if number else 0
    return int(number[:-1] if power else number) << (10 * power)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built; its own lower broadcast limit holds."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    factor = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(factor)) < UNPACKED:
        spark.conf.set(factor, str(UNPACKED))
    for key in BROADCASTS:
        own = spark.conf.get(key, None)
        if own is not None and _bytes(own) > MOST_BROADCAST:
            spark.conf.set(key, str(MOST_BROADCAST))
    return spark


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tileloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tileloom-ckpt-")
    context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Blocks already written survive the loss of the executor that wrote them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and go on from there.

    For wide tables: smaller than a checkpoint, and a later step reads only its own columns. Shuffle files of steps
    that are done go when the driver's JVM collects its garbage, which is asked for here, before more are written.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    spark.sparkContext._jvm.System.gc()
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
