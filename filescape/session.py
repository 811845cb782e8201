"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: What was written for each application, and the table behind each frame `cut` returned.
_written: dict[str, list[str]] = {}
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "filescape", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for; `conf` overrides them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{key: str(value) for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one in the warehouse.

    The library makes no temporary folder: on a cluster that of one machine cannot be read
    by the others, while the warehouse is shared by definition.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured and context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured or context.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; `release` deletes what is written there."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/filescape/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to a table in the shared folder and continue from the written rows.

    Used where rows are read more than once, and between the rounds of a loop. The table
    is columnar, so later steps read only their columns, and its size is known to the
    planner, which then broadcasts small tables without a shuffle of the other side. The
    shuffle files behind the table are deleted once it is written.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    before = spark.conf.get(_FILE_CLEANUP, None)
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        if before is None:
            spark.conf.unset(_FILE_CLEANUP)
        else:
            spark.conf.set(_FILE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _tables[table] = path
    return table


def free(*tables: DataFrame) -> None:
    """Delete tables `cut` wrote that no frame reads any more, such as a loop's last round."""
    for table in tables:
        path = _tables.pop(table, None)
        if path is not None:
            spark = table.sparkSession
            _delete(spark, path)
            _written[spark.sparkContext.applicationId].remove(path)


def release(spark: SparkSession) -> int:
    """Delete everything written below the shared folder for this application; frames built
    on it are void."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        _delete(spark, name)
    return len(paths)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # the driver's JVM may be gone by now
            release(spark)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
