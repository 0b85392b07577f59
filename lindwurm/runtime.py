"""Session access, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


#: Share of the driver's heap from which it is settled after a table is written.
FULL_SHARE = 0.33


def local_session(cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lindwurm")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make the package importable on the workers, once per context.

    The driver serves it as a zip, so that nothing need be installed there.
    """
    context = spark.sparkContext
    if getattr(context, "_lindwurm_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lindwurm-package-")
    atexit.register(shutil.rmtree, folder, True)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "lindwurm_package"), "zip", root, "lindwurm"))
    context._lindwurm_shipped = True  # type: ignore[attr-defined]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset on a local master (tests, single machine) a temporary
    folder is chosen and put into the session, so that every later call sees
    the same one; on a cluster that is an error, as its machines share no
    temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lindwurm-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of executors and is read back with
    column pruning; ``drop`` frees the disk as soon as a later table replaces
    it, and whatever is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(self.clear)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        back._scratch_path = path  # type: ignore[attr-defined]
        heap = self.spark._jvm.Runtime.getRuntime()
        if heap.totalMemory() - heap.freeMemory() > FULL_SHARE * heap.maxMemory():
            self.settle()
        return back

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            self._delete(path)

    def settle(self) -> None:
        """Collect the driver's garbage: finished plans, which else fill its heap, and with them their shuffle files on the executors.

        What the driver's C library keeps of freed memory, mostly the compilers',
        goes back to the system as well, where its JVM has a command for that.
        """
        gc.collect()
        jvm = self.spark._jvm
        jvm.System.gc()
        try:
            commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
            jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(commands, "systemTrimNativeHeap", None, None)
        except Py4JError:  # another JVM or system
            pass

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone already
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
