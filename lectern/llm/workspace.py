"""Shared storage between the driver and the executors.

Intermediate tables cut lineage: they are Parquet under the folder that the
session names in ``spark.checkpoint.dir``.  A machine-local folder is made only
where the setting is absent and driver and executors are one process, which is
the case in tests and notebooks; a cluster without the setting raises.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: The paths that this driver has made, in their order.
_MADE: list[str] = []
#: Bytes of one Arrow batch, so that long rows can't fill a Python worker.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_BYTES; queries and stages call it first.

    The setting stays, since their plans run after they return.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL["dir"] = tempfile.mkdtemp(prefix="lectern-")
            atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
        found = _LOCAL["dir"]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    _MADE.append(path)
    return path


class Scratch:
    """The stored tables that the steps of a job have made, so that a step can remove those of earlier ones."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    @contextlib.contextmanager
    def collect(self) -> Iterator[None]:
        """What is stored inside belongs to this job."""
        before = len(_MADE)
        yield
        self.paths += _MADE[before:]

    def release(self, spark: SparkSession, keep: DataFrame) -> None:
        """Remove the job's tables but those that ``keep`` reads."""
        files = keep.inputFiles()
        used = [p for p in self.paths if any(re.sub("^file:/+", "/", p) + "/" in re.sub("^file:/+", "/", f) for f in files)]
        for path in set(self.paths) - set(used):
            remove(spark, path)
        self.paths = used


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a shared Parquet table and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM may have ended before
        pass


def drop(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        remove(df.sparkSession, path)
