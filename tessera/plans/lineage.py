"""Cutting lineage with tables written to the cluster's shared folder.

Iterative operators write each round as Parquet below ``spark.checkpoint.dir`` and read
it back.  A written table survives the loss of any executor, prunes columns on re-read
and gives the optimizer true sizes, which a cached or locally checkpointed plan does not.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own (tests);
    a cluster without it is refused, since a machine-local path would lose data.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Workspace:
    """Names the tables one operator call writes; everything is removed at exit.

    ``tidy``: the shuffle files of a table go as soon as it is written, not when the driver
    happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, label: str, tidy: bool = False):
        self.spark = spark
        self.tidy = tidy
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._count = 0
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` once and return a scan of the written table."""
        path = self.path(name)
        with self.tidied() if self.tidy else nullcontext():
            writer = df.write.mode("overwrite")
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextmanager
    def tidied(self) -> Iterator[None]:
        """The shuffle files of an action in here are removed at its end; the session's own setting comes back."""
        name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(name, None)
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(name) if before is None else self.spark.conf.set(name, before)

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def drop(self, df: DataFrame) -> None:
        """Delete the files below a table this workspace wrote and nothing reads any more."""
        for uri in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if self.root.split("://")[-1].lstrip("/") in uri:
                self._delete(uri)

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM may be gone at interpreter exit
            pass

    def _delete(self, uri: str) -> None:
        jvm = self.spark._jvm
        if self.spark.sparkContext._jsc is None:
            return
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
