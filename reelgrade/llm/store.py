"""Tables written between the jobs of an operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

#: The folder of each local session without a configured one, by application id.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary folder (its one
    process reads all that it writes); any other session is refused, as its executors share no local folder."""
    if found := spark.conf.get(SETTING, None):
        return found.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='reelgrade-')}"
        atexit.register(_remove, spark, _own[context.applicationId])
    return _own[context.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder is the cluster's to clean
        pass


class Workspace:
    """Names the tables of one run of one operator. What no later job reads is dropped; the rest goes with the session."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/reelgrade/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        atexit.register(_remove, spark, self.root)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write and reread: cuts the lineage, and survives the loss of any executor."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(made)] = made, path
        return made

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this workspace that neither a later job nor the result reads."""
        for df in tables:
            if id(df) in self._paths:
                _remove(self.spark, self._paths.pop(id(df))[1])
