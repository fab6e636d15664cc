"""Session helpers: how code reaches executors and where shared intermediate tables live."""

from __future__ import annotations

import contextlib
import gc
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors, once per context, unless PYTHONPATH already does."""
    sc = spark.sparkContext
    root = str(_PACKAGE.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_loomgraph_shipped", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for file in sorted(_PACKAGE.rglob("*.py")):
            z.write(file, str(file.relative_to(_PACKAGE.parent)))
    target = Path(tempfile.mkdtemp(prefix="loomgraph-")) / f"loomgraph-{uuid.uuid4().hex[:8]}.zip"
    target.write_bytes(packed.getvalue())
    sc.addPyFile(str(target))  # served by the driver, so it needs no shared folder
    sc._loomgraph_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder all nodes see. Only a session without spark.checkpoint.dir (tests) gets one of our own."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not getattr(sc, "_loomgraph_shared", None):
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        sc._loomgraph_shared = "file://" + tempfile.mkdtemp(prefix="loomgraph-shared-")
        sc.setCheckpointDir(sc._loomgraph_shared)
    return sc._loomgraph_shared


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, most: int | None) -> Iterator[None]:
    """Arrow batches of about `most` bytes at most, a row at least, for what runs inside. By default one has 10,000 rows, whatever
    their size, and an executor holds it several times over: as vectors, as the stream's buffer and in the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(key, None)
    if most is None or (given is not None and given.isdigit() and int(given) <= most):
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, given) if given is not None else spark.conf.unset(key)


@contextlib.contextmanager
def writers(spark: SparkSession, most: int) -> Iterator[None]:
    """A task writes to so many folders at once, instead of sorting its rows by folder first."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    given = spark.conf.get(key)
    spark.conf.set(key, str(max(most, int(given))))
    try:
        yield
    finally:
        spark.conf.set(key, given)


def trim(spark: SparkSession) -> None:
    """Return what the driver's JVM has freed outside its heap (by Netty, zstd, its compiler) to the system: hundreds of threads
    allocate there, and glibc keeps what they free. A diagnostic command of the JDK on Linux, from 17.0.9 on; others do nothing."""
    sc = spark.sparkContext
    jvm, array = sc._jvm, sc._gateway.new_array
    with contextlib.suppress(Py4JError):
        beans = jvm.java.lang.Class.forName("javax.management.MBeanServer")  # the server's own class is closed to reflection
        invoke = next(m for m in beans.getMethods() if m.getName() == "invoke")
        args = array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


class Scratch:
    """Tables of one operator run, written to the shared folder: they cut lineage and outlive lost executors. batch: the bytes
    of an Arrow batch, see arrow_batches."""

    def __init__(self, spark: SparkSession, name: str, batch: int | None = None):
        self.spark, self.path, self.batch = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}", batch

    def write(self, df: DataFrame, name: str, parts: str | None = None, **options: str) -> DataFrame:
        """parts: a column by which the files are dealt into folders, that can be dropped one by one."""
        with arrow_batches(self.spark, self.batch), writers(self.spark, 4 if parts else 0):
            df.write.mode("overwrite").option("compression", "zstd").options(**options).partitionBy(*[parts] if parts else []).parquet(f"{self.path}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(f"{self.path}/{name}")

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps now, not at some later collection, and shrink the driver."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        trim(self.spark)

    def drop(self, *names: str) -> None:
        sc = self.spark.sparkContext
        for name in names:
            path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
