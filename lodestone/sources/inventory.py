"""File inventories as a data source, and file contents through Spark's own reader.

``file_inventory`` walks a shared folder: one partition per top-level entry, ignored folders
skipped, rules of ignore files kept, symbolic links not followed, failures reported as rows with an issue instead of errors.
Every executor has to see the folder. Stores that only Spark reads go through contents().
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.functions import names
from lodestone.functions import text as X
from lodestone.sources.ignore import Rule, ignored, rules_of

#: Folders that a scan leaves out.
IGNORED = ("node_modules", "venv", ".venv", "__pycache__", "target", ".git")
SNIFF = 1024
BATCH = 4096
SCHEMA = "path string, name string, extension string, size bigint, modified bigint, kind string, is_binary boolean, issue string, device bigint, inode bigint, links int"


class Inventory(DataSource):
    """Format ``file_inventory``. Options: path, hidden (false), depth (no limit), ignore (true: rules of ignore files hold)."""

    @classmethod
    def name(cls) -> str:
        return "file_inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        root = os.path.realpath(self.options["path"].removeprefix("file://"))
        if not os.path.isdir(root):
            raise ValueError(f"not a folder: {root}")
        depth = self.options.get("depth")
        return _Walk(root, self.options.get("hidden", "false").lower() == "true", int(depth) if depth else None, self.options.get("ignore", "true").lower() == "true")


@dataclass
class _Entry(InputPartition):
    name: str


class _Walk(DataSourceReader):
    def __init__(self, root: str, hidden: bool, depth: int | None, ignore: bool):
        self.root, self.hidden, self.depth, self.ignore = root, hidden, depth, ignore

    def partitions(self) -> list[_Entry]:
        return [_Entry(n) for n in sorted(os.listdir(self.root)) if self._wanted(n)] or [_Entry("")]

    def _wanted(self, name: str) -> bool:
        return name not in IGNORED and (self.hidden or not name.startswith("."))

    def read(self, partition: _Entry) -> Iterator[pa.RecordBatch]:
        rows = []
        rules = rules_of(self.root, "") if self.ignore else []
        for row in self._visit(partition.name, rules) if partition.name else ():
            rows.append(row)
            if len(rows) >= BATCH:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _visit(self, path: str, rules: list[Rule]) -> Iterator[tuple]:
        full = os.path.join(self.root, path)
        name = os.path.basename(path)
        try:
            info = os.lstat(full)
            if stat.S_ISLNK(info.st_mode):
                return
            if ignored(path, stat.S_ISDIR(info.st_mode), rules):
                return
            if stat.S_ISDIR(info.st_mode):
                if self.ignore:
                    rules = [*rules, *rules_of(full, path + "/")]
                if self.depth is None or path.count("/") < self.depth:
                    for child in sorted(os.listdir(full)):
                        if self._wanted(child):
                            yield from self._visit(f"{path}/{child}", rules)
                return
            with open(full, "rb") as f:
                binary = b"\0" in f.read(SNIFF)
            ext = name.rpartition(".")[2].lower() if "." in name[1:] else ""
            yield (path, name, ext, info.st_size, int(info.st_mtime), "binary" if binary else "file", binary, None, info.st_dev, info.st_ino, info.st_nlink)
        except OSError as e:
            yield (path, name, None, None, None, None, None, e.strerror or str(e), None, None, None)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int32())
        labels = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=labels)


def inventory(spark: SparkSession, root: str, hidden: bool = False, depth: int | None = None, ignore: bool = True) -> DataFrame:
    spark.dataSource.register(Inventory)
    reader = spark.read.format("file_inventory").option("path", root).option("hidden", str(hidden).lower()).option("ignore", str(ignore).lower())
    return (reader.option("depth", depth) if depth is not None else reader).load()


def contents(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, name, extension, size, modified, is_binary, sha256, text and content of files below root.

    text is null for binary files and for those that are no UTF-8. Columns that nothing asks for are never read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    raw = raw.filter(~F.col("path").rlike("/(" + "|".join(n.replace(".", r"\.") for n in IGNORED) + ")/"))
    name = F.substring_index("path", "/", -1)
    is_binary = X.binary(F.col("content"))
    return raw.select(
        "path",
        name.alias("name"),
        names.extension(name).alias("extension"),
        F.col("length").alias("size"),
        F.unix_seconds("modificationTime").alias("modified"),
        is_binary.alias("is_binary"),
        F.sha2("content", 256).alias("sha256"),
        F.when(~is_binary & F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("text"),
        "content",
    )
