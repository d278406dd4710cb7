"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths that are removed when the driver ends, and the session of each.
_LEFT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, one machine makes do with a temporary one;
    a cluster can't, as its executors wouldn't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.conf.get("tesserae.own.checkpoint.dir", None)
        if not named:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="tesserae-")
            spark.conf.set("tesserae.own.checkpoint.dir", named)
            _LEFT[named] = spark
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _remove_what_is_left() -> None:
    for path, spark in _LEFT.items():
        try:
            _remove(spark, path)
        except Exception:  # the session has gone, and so have its files' readers
            return


def cut(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return it reread.

    A lost executor then costs a reread, not a recomputation, and a loop's plan stays short. Void columns aren't
    allowed. ``options`` are the writer's. The table is removed by ``discard``, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _LEFT[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from ``cut`` that no later plan reads."""
    for name in df.inputFiles()[:1]:
        path = name.rsplit("/", 1)[0]
        _remove(df.sparkSession, path)
        for left in [p for p in _LEFT if p.rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]]:
            del _LEFT[left]


def settle(spark: SparkSession) -> None:
    """Between the stages of a long job: let the driver's JVM and Python give back what finished stages held, such as
    generated classes, broadcasts and collected rows, and what their allocators keep of it; then the executors' JVMs,
    whose heaps otherwise stay as large as any stage made them, beside the Python workers of the next one."""
    gc.collect()
    jvm = spark._jvm
    jvm.java.lang.System.gc()
    with contextlib.suppress(Exception):  # a JVM before 17.0.9, or one without management, has no such command
        kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        types, values = spark.sparkContext._gateway.new_array(jvm.java.lang.Class, 4), spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        for k, kind in enumerate(kinds):
            types[k] = jvm.java.lang.Class.forName(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface's method, as the server's own class isn't open
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1  # the driver is in it, too
    if executors > 0:  # idle executors are offered tasks in turn, so each gets one
        spark.range(0, executors, 1, executors).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()
