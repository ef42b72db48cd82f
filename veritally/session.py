"""Session settings the plans rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    # Trip timestamps are wall-clock values without an offset; UTC keeps them as written.
    "spark.sql.session.timeZone": "UTC",
}
# A rule pack is one very wide projection. Fused into one generated method it passes the JVM's
# limit for compilation (8000 bytes) and runs interpreted; past this setting's limit Spark
# generates it in small methods instead (4.0 s against 1.6 s on 600,000 trips). Executors
# started with the flag below compile huge methods too, which is the fastest on large data,
# so then the setting stays as it is.
HUGE_METHODS = ("spark.sql.codegen.hugeMethodLimit", "8000")
COMPILES_HUGE = "-XX:-DontCompileHugeMethods"


def local_session(cpus: int | str = 8, app: str = "veritally", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Put the settings on a session made elsewhere; all of them can change at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if COMPILES_HUGE not in spark.conf.get("spark.executor.extraJavaOptions", ""):
        spark.conf.set(*HUGE_METHODS)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the cluster names in spark.checkpoint.dir.

    A session on one machine that names none gets a new folder; a cluster that names none is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="veritally-"))
        current = context.getCheckpointDir()
    return named or current
