"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (`spark.checkpoint.dir`); where it is unset, a local one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _local.get(spark.sparkContext.applicationId)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = _local[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tandem-")
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete every table that the operators have left in the shared folder; to be called when their results have been read."""
    for path in list(_made):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _made.discard(path)


#: Rows of one key that may become one array.
MAX_LISTED = 1_000_000


def bounded(df: DataFrame, keys: list[str], limit: int) -> None:
    """Raise if a key has more than `limit` rows: one counted row comes to the driver."""
    most = df.groupBy(*keys).count().agg({"count": "max"}).first()[0] or 0
    if most > limit:
        raise ValueError(f"{most} rows share one {', '.join(keys)}; {limit} may be listed")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: all readers see the same rows, also after lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
