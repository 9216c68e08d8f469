"""Archives that arrive in a folder, as a stream of their entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.archives import _CATALOG, _parse, _schema, whole_heads


def arriving_archives(spark: SparkSession, path: str, pattern: str = "*.7z", per_trigger: int = 100) -> DataFrame:
    """Headers of new archives below ``path``: the rows of ``catalog``, as a stream."""
    kind = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)
    return whole_heads(files.select(F.col("path").alias("archive"), "content")).mapInArrow(_parse(1 << 20, False), _schema(_CATALOG))
