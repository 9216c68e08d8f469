"""Which solid block (folder) each entry of an archive goes to."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("solid", "nonsolid", "limit")


def assign_folders(entries: DataFrame, solid: str = "solid", max_files: int | None = None, max_bytes: int | None = None, streaming: bool = False) -> DataFrame:
    """``entries`` (archive, entry_index, has_stream, size) with ``folder``, from 0 in each archive.

    Preplanned limits start a folder when an entry would exceed one; with ``streaming`` a folder is sealed once a
    limit is reached, so it may overshoot the bytes. Entries without a stream belong to the current folder.
    Counts alone are window arithmetic. A limit on bytes depends on where the last folder began, an ordered fold
    over an archive's sizes: rows stream through sorted by archive, a task keeps two counters.
    """
    if solid not in MODES:
        raise ValueError(f"solid mode {solid}")
    order = Window.partitionBy("archive").orderBy("entry_index")
    nth = F.sum(F.col("has_stream").cast("long")).over(order)
    if solid == "solid":
        return entries.withColumn("folder", F.lit(0).cast("long"))
    if solid == "nonsolid":
        max_files, max_bytes = 1, None
    if max_bytes is None:
        k = max_files or (1 << 62)
        current: Column = F.when(F.col("has_stream"), F.floor((nth - 1) / k)).when(nth == 0, 0).otherwise(F.floor((nth - 1) / k) if not streaming and solid != "nonsolid" else F.floor(nth / k))
        return entries.withColumn("folder", current.cast("long"))
    rows = entries.repartition("archive").sortWithinPartitions("archive", "entry_index")
    kind = dict(rows.dtypes)
    ddl = ", ".join(f"{c} {t}" for c, t in kind.items()) + ", folder bigint"
    return rows.mapInArrow(_fold(max_files, max_bytes, streaming), ddl)


def _fold(max_files: int | None, max_bytes: int, streaming: bool):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, folder, files, size = object(), 0, 0, 0
        for batch in batches:
            out = []
            for archive, stream, n in zip(batch.column("archive").to_pylist(), batch.column("has_stream").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if archive != now:
                    now, folder, files, size = archive, 0, 0, 0
                if stream and not streaming and files and (size + n > max_bytes or max_files is not None and files + 1 > max_files):
                    folder, files, size = folder + 1, 0, 0
                out.append(folder)
                if stream:
                    files, size = files + 1, size + n
                    if streaming and (size >= max_bytes or max_files is not None and files >= max_files):
                        folder, files, size = folder + 1, 0, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "folder"])

    return fold
