"""Session construction and the shared-folder rule."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "partwise", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use.

    On a cluster the session comes from ``spark-submit`` and this isn't called.
    """
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver see (``spark.checkpoint.dir``).

    Only in a local session that names none, as in tests, a temporary one is set;
    on a cluster a missing name is an error, since executors don't share the
    driver's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="partwise-checkpoint-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files, which outlive any executor.

    The plan that made it is forgotten, its inferred constraints included, and
    the size of the files is known to the planner.  They go when ``discard`` is
    told so, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def _place(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can write."""
    place, system = _place(spark, path)
    system.delete(place, True)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application ends."""
    place, system = _place(spark, path)
    system.deleteOnExit(place)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` wrote, once nothing will read them any more."""
    for table in tables:
        remove(table.sparkSession, table._cut_path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
