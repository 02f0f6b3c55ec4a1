"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on. All of them are runtime re-planning switches, so the
# same jobs work on a laptop and on a cluster that sets its own parallelism.
JOB_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Join by hashing where every shuffled partition turns out this small, else by sorting.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(app: str = "snaplytics", cores: str = "8", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and measurements."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call sites of every column cost time
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in {**JOB_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is not set, a local session gets one in its warehouse folder; a cluster has to name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def apply_job_settings(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere, as on a cluster, the settings the jobs rely on."""
    for key, value in JOB_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the written rows.

    Used before a table is read several times (ranks, model fit, season totals), so
    that the fact tables are scanned once and a lost executor costs no recomputation. The files go when
    nothing refers to them any more, where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
