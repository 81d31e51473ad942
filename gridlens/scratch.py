"""Tables that a computation writes and reads back, in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under the one that the cluster names in spark.checkpoint.dir.  Where it names none, a temporary
    one, if all executors are on this machine."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/gridlens-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="gridlens-")
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: computed once, and a lost executor does not send its readers back to its sources."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all that this application has written; its DataFrames cannot be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
