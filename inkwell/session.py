"""Session construction, table loading and materialisation helpers.

Everything that cuts lineage goes through :func:`materialize`, which writes a
Parquet table below ``spark.checkpoint.dir`` (a folder every executor and the
driver share) and reads it back, so a lost executor never loses the rows.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def get_session(app: str = "inkwell", cpus: str | int | None = None) -> SparkSession:
    """A local session with the settings the engine is tuned for; on a cluster use its own session."""
    n = str(cpus or os.environ.get("BENCH_CPUS") or "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", n if n.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder. Only Spark's reader touches the path, so any store it knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew where it has fewer partitions than there are cores, as a file of one row group has; else as it is, so
    a large table does not move."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def dealt(df: DataFrame) -> DataFrame:
    """df dealt anew over four times as many partitions as there are cores, or as many as it has: for functions that take much
    longer over a row than moving it does, as splits of a file may hold no row group, or all of them."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir. Where it is unset, a local session, whose driver and
    executors are one process, gets a temporary one, and any other session an error."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="inkwell-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/inkwell/{tag}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its file system: that of Hadoop's default one where it has none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


#: Spark deletes the shuffle files of a query when it ends; nothing reads them after a table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write once, read back: the shared-storage cut of a lineage. Rows survive the loss of executors."""
    spark = df.sparkSession
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """A written table at a fresh scratch path, for callers that keep it; operators use Scratch."""
    return write_table(df, scratch_path(df.sparkSession, tag))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Scratch:
    """The written tables of one operator's run, deleted after their last reader."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """df as a written table; a tag that is used again does not delete the table before."""
        path = scratch_path(self.spark, tag)
        self.paths.setdefault(tag, []).append(path)
        return write_table(df, path)

    def drop(self, *tags: str, but: str | None = None) -> None:
        """Delete the tables of the tags, or, without tags, all but those of one tag."""
        for tag in tags or [t for t in self.paths if t != but]:
            for path in self.paths.pop(tag, []):
                remove(self.spark, path)
