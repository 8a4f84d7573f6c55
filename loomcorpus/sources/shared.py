"""The folder for tables between jobs."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where the tables of this process lie.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def place(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``. Where that is unset: a temporary folder in local
    mode, and the warehouse, which a cluster shares, elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        base = "file://" + tempfile.mkdtemp(prefix="loom-")
    base = base or spark.conf.get("spark.sql.warehouse.dir") + "/_loom"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in that folder, so later jobs read it and a lost executor loses none of it."""
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def removed(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            delete(table.sparkSession, path)
