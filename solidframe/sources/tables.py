"""Tables that a job writes once and reads again, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: How Parquet writes these tables. Rows may be whole archives: by itself it looks at the size of what it holds only after 100 rows,
#: and keeps, writes and reads these at once; here a page ends with the row that fills it, and row groups, which a task holds, are small.
_WRITTEN = {"compression": "zstd", "parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}

_own_dirs: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where it is unset: one below the warehouse, which
    executors share too; in local mode, where driver and executors are one process, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _own_dirs:
        local = spark.sparkContext.master.split("[")[0] == "local"
        _own_dirs[key] = "file://" + tempfile.mkdtemp(prefix="solidframe-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + f"/solidframe-{key}"
    return _own_dirs[key]


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders, on whatever store they are; what is gone already is no error."""
    for path in paths:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session has ended; its folder goes with it
            pass


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    It cuts the lineage, is computed once however often it is used, and survives the loss of
    executors. The files go at the end of the ``scratch`` around the call, by ``release``, or when the driver's
    Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/solidframe-{uuid.uuid4().hex}"
    df.write.options(**_WRITTEN).parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    else:
        atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._own_files = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``materialize`` gave and nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._own_files)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """At its end the tables written inside are deleted: write or collect what is to stay before."""
    _scopes.append([])
    try:
        yield
    finally:
        remove(spark, *_scopes.pop())
