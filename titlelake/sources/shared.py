"""Folders that every executor can reach, and the few file operations that need no Spark job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="titlelake-")
    return f"{root.rstrip('/')}/titlelake-{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written to the shared folder and read back: computed once, and lineage ends here."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Jobs that :func:`together` runs at once.
JOBS = 4


def together(spark: SparkSession, jobs: list[Callable[[], object]]) -> list:
    """The results of jobs that don't need each other; those that wait for a last task leave the cores to the others.

    All jobs end before the first error, if any, is raised.
    """
    with ThreadPoolExecutor(JOBS) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [job.result() for job in started]


class Taken(RuntimeError):
    """A file that should have been new is there: another writer was first."""


class Files:
    """Small files in a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        if getattr(spark, "_jvm", None) is None:
            raise RuntimeError("saved catalogues and stores need a session in this process, not a Connect client")
        self._jvm, self.folder = spark._jvm, folder
        self._system = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str = "") -> bool:
        return self._system.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, none if it is missing."""
        place = self._path(name)
        return sorted(f.getPath().getName() for f in self._system.listStatus(place)) if self._system.exists(place) else []

    def read(self, name: str) -> str:
        stream = self._system.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a file that must be new; of several writers one succeeds, the others raise :class:`Taken`."""
        try:
            out = self._system.create(self._path(name), False)
        except Py4JJavaError as error:
            if self.exists(name):
                raise Taken(f"{self.folder}/{name} is there already") from error
            raise
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()

    def delete(self, name: str) -> None:
        self._system.delete(self._path(name), True)
