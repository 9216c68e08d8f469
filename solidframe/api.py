"""What users call: list, verify, extract, create, update and delete, over archives that Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import pack, selection, update
from .sources import archives as A
from .sources.coders import ArchiveError
from .sources.disk import disk_entries
from .sources.tables import materialize

#: Exit states of a command: sound, some entries failed, nothing could be done.
OK, WARNING, FATAL = 0, 1, 2


class Archives:
    """Archives of a path or of rows (archive, content), with their views. Headers are read once."""

    def __init__(self, archives: DataFrame, mode: str = "PERMISSIVE", password: str | None = None):
        self.archives, self.mode, self._password = archives, mode, password
        self.catalog = A.catalog(archives, mode, password=password)
        self.summary, self.blocks = A.archives_view(self.catalog), A.blocks_view(self.catalog)
        self.entries = A.entries_view(self.catalog, self.blocks)

    @classmethod
    def open(cls, spark: SparkSession, path: str, pattern: str = "*.7z", volumes: bool = False, **options) -> Archives:
        """Archives below ``path``; with ``volumes`` its sets ``name.001, name.002, ...``."""
        return cls(A.join_volumes(spark, path) if volumes else A.read_archives(spark, path, pattern), **options)

    def list(self, *patterns: str) -> DataFrame:
        return selection.by_pattern(self.entries, list(patterns)).orderBy("archive", "entry_index")

    def decoded(self) -> DataFrame:
        return A.decoded_blocks(self.archives, self.blocks, self.mode, self._password)

    def content(self, *patterns: str) -> DataFrame:
        """Entries with their bytes; only the blocks that hold a selected entry are decoded."""
        return A.content_view(selection.by_pattern(self.entries, list(patterns)), self.decoded())

    def symlinks(self) -> DataFrame:
        """(archive, entry_index, path, target) of symbolic links."""
        links = A.content_view(self.entries.filter(F.col("entry_type").isin("Symlink", "EmptySymlink")), self.decoded())
        return links.select("archive", "entry_index", "path", F.decode("content", "UTF-8").alias("target"))

    def verify(self) -> DataFrame:
        return A.verify_view(self.entries, self.decoded())

    def state(self) -> int:
        """Exit state of a test: a damaged block is a warning, an unreadable archive fatal."""
        if not self.summary.filter("error IS NOT NULL").isEmpty():
            return FATAL
        return OK if self.verify().filter("error IS NOT NULL").isEmpty() else WARNING

    def extract(self, folder: str, *patterns: str, mode: str = "overwrite") -> tuple[int, int]:
        """Writes folders, files and symbolic links below ``folder``; how many, and how many that were there stayed (``mode``)."""
        chosen = self.content(*patterns)
        if patterns and chosen.isEmpty():
            raise ArchiveError("EntryNotFound", ", ".join(patterns))
        return pack.extract(materialize(chosen), folder, selection.by_pattern(self.entries, list(patterns)), mode)

    def updated(self, added: DataFrame | None = None, deleted: list[str] | None = None, **options) -> DataFrame:
        """(archive, content) of the archives with entries added or replaced by name, and others deleted by pattern. Blocks
        that stay whole are copied as they are; the others are packed with ``options``."""
        return update.rewrite(self.archives, self.entries, self.blocks, self.decoded(), added, deleted, **options)


def create(spark: SparkSession, folder: str, archive: str = "archive", pattern: str | None = None, **options) -> DataFrame:
    """(archive, content) of the files below ``folder``."""
    return pack.pack_archives(disk_entries(spark, folder, archive, pattern), **options)
