"""Session builder for programs and tests that bring no session of their own."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; conf keys use "_" for "."."""
    builder = SparkSession.builder.appName("siftline")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Queries started within have these settings (with "_" for "."); the session's own come back after."""
    names = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def shared_root(spark) -> str:
    """This application's folder under spark.checkpoint.dir, which driver and executors share; set here only where it
    is unset and the master is local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/checkpoints/siftline"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/siftline-{spark.sparkContext.applicationId}"


#: The folder, within the shared one, of what is deleted when a maker of settle_each has ended.
_MAKING: ContextVar[str] = ContextVar("making", default="")


def shared_folder(spark, label: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_root(spark)}/{_MAKING.get()}{label}-{uuid.uuid4().hex}"


def settle(df, label: str = "settled"):
    """df written as a table in the shared folder and read again.

    It cuts the lineage, is computed once however often it is used, and survives lost executors.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_each(spark, makers: Iterable[Callable], label: str = "settled"):
    """The rows of the DataFrame that each maker gives, as one table; makers are called one after another.

    All other tables and files that a maker puts into the shared folder are deleted before the next is called, and what it
    shuffles when it is written, so that only one's take room at a time. At least one maker, all of one schema.
    """
    path, schema = shared_folder(spark, label), None
    for make in makers:
        making = _MAKING.set(f"{_MAKING.get()}making-{uuid.uuid4().hex}/")
        folder = f"{shared_root(spark)}/{_MAKING.get()}"
        try:
            with settings(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true"):
                df = make()
                df.write.mode("append").parquet(path)
            schema = schema or df.schema
        finally:
            _MAKING.reset(making)
            deleted(spark, folder)
    return spark.read.schema(schema).parquet(path)


def small_batches(spark) -> None:
    """Arrow batches bounded by rows and bytes, so that a batch of long contents fits into a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


#: Rows of a task that makes or parses a file of each, about.
TASK_ROWS = 10_000


def spread(df, *keys: str):
    """df dealt by key over as many tasks as an exchange has, and more where there are many rows, whatever its bytes: for
    rows of few bytes that are much work. They are counted, so df should be a table or little more.

    The number is given, for partitions that are only small in bytes would be joined again.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-df.count() // TASK_ROWS)), *keys)


def tidy(spark) -> bool:
    """Deletes what this application settled. Results that were not written elsewhere may need it: call it last."""
    return deleted(spark, shared_root(spark))


def deleted(spark, folder: str) -> bool:
    """Deletes a folder and all in it; False if there was none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
