"""Tables written between jobs, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a temporary folder in local
    mode and the warehouse on a cluster."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        base = "file://" + tempfile.mkdtemp(prefix="loom-")
    else:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_loom"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Where the tables of this process lie.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage: a
    lost executor costs the tasks that ran on it, never what was written."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As ``materialize``, the rows being dealt over the session's shuffle partitions by ``key``, so
    that joins on it leave them where they are."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}-{uuid.uuid4().hex}".replace("-", "_")
    path = f"{folder(spark)}/{table}"
    writer = df.repartition(n, key).write.option("compression", "zstd").option("path", path)
    writer.bucketBy(n, key).saveAsTable(table)
    out = spark.table(table)
    _paths[out], _tables[out] = path, table
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for table in tables:
        path = _paths.pop(table, None)
        if table in _tables:
            table.sparkSession.sql(f"DROP TABLE {_tables.pop(table)}")
        if path:
            jvm = table.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
