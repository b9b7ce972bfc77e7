"""Session helpers: a tuned local session for tests/bench and checkpoint-dir handling.

On a cluster the session comes from the launcher; we only *read* its settings.
``ensure_checkpoint_dir`` sets a directory only when the cluster did not name one
(tests, local bench), so lineage cuts always land in the shared folder the cluster
configured under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale; every one is a plain Spark SQL conf.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Bytes of a generated method beyond which HotSpot runs it uncompiled. Spark's own limit is 65535, its documentation names
#: this one for HotSpot: an operator whose method would be longer works in several short ones.
METHOD_BYTES = ("spark.sql.codegen.hugeMethodLimit", "8000")


def keep_methods_compiled(spark: SparkSession) -> None:
    """Long chains of column expressions stay compiled, where the session does not set a limit itself."""
    if spark.conf.get(METHOD_BYTES[0], None) is None:
        spark.conf.set(*METHOD_BYTES)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "farelake") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    A local session (tests, bench) without one gets a scratch folder: its executors are the driver's own threads.
    On a cluster that would be each machine's own disk, so there a missing setting is an error.
    """
    current = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="farelake-ckpt-", dir=os.environ.get("FARELAKE_SCRATCH", "/tmp"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss) into the configured checkpoint dir."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting to remove the shuffle files of an execution when it ends. Else they stay until the driver's garbage is collected.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Executions planned within leave no shuffle files: for writes, whose plans are never run again."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def written_table(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back: later plans start from files, with
    column pruning, filters pushed down and sizes that Spark knows when it picks a join."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    out = df.write.partitionBy(partition_by) if partition_by else df.write
    with shuffles_removed(spark):
        out.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def table_state(spark: SparkSession, folder: str) -> tuple:
    """Size and change time of what lies in a folder, so that a table derived from it is not used for new data."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in store.listStatus(path)))


def table_exists(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written to its end there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))
