"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session names none and runs on one machine (tests), a temporary folder is made,
    and removed when the process ends; a cluster without a shared folder is an error.
    """
    global _own
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="quern-shared-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return _own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The committed files outlive any executor, unlike a cached or locally checkpointed table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    release_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system; workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def release_driver(spark: SparkSession) -> bool:
    """Give memory that the driver no longer uses back to the system: its Python's, and what its JVM took outside the heap.

    Planning and compiling many queries leaves much of the latter free, but still held. A JVM that cannot return it (before 17.0.9) keeps it: False.
    """
    from py4j.protocol import Py4JError

    release()
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        # by reflection: the server's own class is not open to callers
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        given, kinds, values = new_array(jvm.java.lang.Object, 1), new_array(jvm.java.lang.String, 1), new_array(jvm.java.lang.Object, 4)
        given[0], kinds[0] = new_array(jvm.java.lang.String, 0), "[Ljava.lang.String;"
        values[0], values[1], values[2], values[3] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", given, kinds
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False
    return True


def free(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """``names``, with as many underscores added as make them no columns of ``docs``."""
    taken, tail = {c.lower() for c in docs.columns}, ""
    while any((n + tail).lower() in taken for n in names):
        tail += "_"
    return tuple(n + tail for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
