"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("effectframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; without it, one in the session's warehouse.

    Both are shared by all executors; a machine-local temporary folder is never used.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/_checkpoints")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor.

    Runs a job. The written rows are fixed, so values which depend on the
    physical layout (partition ids) stay the same in every later reader.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage_placed(df: DataFrame) -> DataFrame:
    """:func:`cut_lineage` which keeps how the rows are placed and sorted, so that no later join moves them.

    The plan of an adaptive run does not say how its result is placed, and its checkpoint
    forgets it: this one job is planned without it. Give ``df`` a ``repartition`` with a number.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # A new frame: the plan of the given one may be made already.
        return cut_lineage(df.select("*"))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)
