"""Session construction with the settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "strandlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, skew-join handling, UTC timestamps and ANSI arithmetic.

    Shuffle width stays with the caller's cluster settings: AQE coalesces upwards from it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go where spark.checkpoint.dir says.

    Only where it says nothing and driver and executors are one process a local folder is set (tests); on a cluster an
    unset folder is an error.
    """
    import re
    import tempfile

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="strandlake-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the session ends."""
    import uuid

    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def parts(df, times: int = 1) -> int:
    """The number of shuffle partitions, as often as times says: given to repartition, it holds whatever size is dealt."""
    return times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def kept(df):
    """The rows of df from a table written once to the shared folder: lineage ends and later plans know its size.

    checkpoint() would compute df twice, to count and to write. The table goes when the session ends.
    """
    path = shared_path(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
