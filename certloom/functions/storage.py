"""Tables between the rounds of iterative jobs, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

#: Schemes of Hadoop's connectors, and how pyarrow names the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A new local one only where that is unset and the session itself is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there, and losing an executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared storage with all that is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(stored: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    delete(stored.sparkSession, stored.stored_at)


def finished(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in a folder whose writing jobs were completed; none if it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    found = [s.getPath() for s in system.listStatus(path) if s.isDirectory()]
    return sorted(p.getName() for p in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with the scheme that Spark itself resolves it by, so that tasks never take one without a scheme for a local one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a qualified URI and the path in it. Credentials are those of the machine; a scheme that pyarrow does not know is an error."""
    scheme, colon, rest = uri.partition(":")
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)
