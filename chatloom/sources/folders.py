"""Listings of folder trees by a data source, and copies of the files that Spark's own readers hide.

Spark's readers leave out files and folders whose names start with `_`, and scans leave out empty files. The tree is
therefore listed level by level: each level is one read of a data source that lists its folders in parallel, some
folders to a partition. Only names of folders come to the driver, to be the next level. Files that Spark hides
are copied, on the executors, to the shared folder under names that it shows; readers get both folders and the copies'
rows carry the original paths.

Folders are opened with pyarrow's file systems, which know local and mounted folders, HDFS, S3 and GCS.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import shared_path, stored
from .files import Chosen

ENTRY_SCHEMA = "path string, length bigint, modified bigint, folder boolean, place string"
#: Folders listed by one partition, so that a level of very many small folders is not as many tasks.
FOLDERS_PER_PARTITION = 64
COPY_BYTES = 8 << 20


def opened(uri: str):
    """(file system, path in it, what to put before its paths to name them as Spark does)."""
    from pyarrow import fs

    if "://" not in uri:
        path = os.path.abspath(uri.removeprefix("file:"))
        return fs.LocalFileSystem(), path, "file:"
    if uri.startswith("file://"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file://").lstrip("/"), "file:"
    system, path = fs.FileSystem.from_uri(uri)
    rest = uri.split("://", 1)[1].rstrip("/")
    return system, path, uri.split("://", 1)[0] + "://" + rest[: len(rest) - len(path.strip("/"))]


def can_open(uri: str) -> bool:
    """Whether pyarrow knows the file system of a path."""
    try:
        opened(uri)
    except (OSError, ValueError):
        return False
    return True


class _Folders(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.names = json.loads(options["folders"])

    def partitions(self):
        return [_Folders(self.names[i : i + FOLDERS_PER_PARTITION]) for i in range(0, len(self.names), FOLDERS_PER_PARTITION)]

    def read(self, partition: _Folders):
        from pyarrow import fs

        for name in partition.names:
            system, path, before = opened(name)
            here = system.get_file_info(path)
            if here.type == fs.FileType.NotFound:
                raise FileNotFoundError(f"path does not exist: {name}")
            found = [here] if here.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
            for entry in found:
                folder = entry.type == fs.FileType.Directory
                # links to a folder lead to one place; elsewhere than in a local file system there are none
                place = os.path.realpath(entry.path) if before == "file:" and folder else entry.path
                yield before + entry.path, entry.size or 0, (entry.mtime_ns or 0) // 1000, folder, place


class FolderSource(DataSource):
    """Entries of the folders named by the option `folders`, a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "folder_entries"

    def schema(self) -> str:
        return ENTRY_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)


def list_tree(spark: SparkSession, root: str, max_levels: int | None = None, once: bool = True) -> DataFrame:
    """``path, length, modified`` of every file below `root` (or of the file `root`), empty ones and `_` names included.

    ``modified`` is in microseconds. Folders whose names start with a dot are not entered. With `once`, a folder that links
    lead to more than once is listed where it is met first, in the order of names, level by level; without it, give
    `max_levels`, as links may form a circle. No file contents are read.
    """
    spark.dataSource.register(FolderSource)
    frontier, seen, levels = [root], set(), []
    while frontier and (max_levels is None or len(levels) < max_levels):
        level = stored(spark.read.format("folder_entries").option("folders", json.dumps(frontier)).load(), "folders")
        levels.append(level.where("not folder").select("path", "length", "modified"))
        frontier = []
        inside = level.where("folder").select("path", "place").orderBy("path")
        for row in inside.toLocalIterator():
            if not (once and row["place"] in seen) and not row["path"].rsplit("/", 1)[-1].startswith("."):
                seen.add(row["place"])
                frontier.append(row["path"])
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return whole


def hidden_from_spark(relative: Column) -> Column:
    """Whether a file or one of its folders below the root starts with `_`; names with `=` are partitions and are shown."""
    return F.exists(F.split(relative, "/"), lambda part: F.startswith(part, F.lit("_")) & ~F.contains(part, F.lit("=")))


class ShownFiles:
    """What readers need to read a tree whole: `paths` for Spark's readers, and ``restored`` for what they give."""

    def __init__(self, spark: SparkSession, root: str, hidden: DataFrame | None = None):
        """`hidden` (path, name) are the files to copy; ``name`` is the path below `root`."""
        self.paths, self.root, self.copies = root, root.rstrip("/"), None
        if hidden is None or hidden.isEmpty():
            return
        target = shared_path(spark, "shown")

        def copy(batches):
            import pyarrow as pa

            for batch in batches:
                for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    # every part of the name gets a letter in front, so none is hidden and all can be named back
                    to = target + "/" + "/".join("v" + part for part in name.split("/"))
                    system, source, _ = opened(path)
                    out, place, _ = opened(to)
                    out.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    # written aside and then moved: a repeated or lost task leaves no half file under the name
                    aside = f"{place.rsplit('/', 1)[0]}/.{place.rsplit('/', 1)[1]}.{os.getpid()}"
                    with system.open_input_stream(source) as read, out.open_output_stream(aside) as write:
                        while piece := read.read(COPY_BYTES):
                            write.write(piece)
                    out.move(aside, place)
                yield pa.RecordBatch.from_arrays([batch.column(0)], ["path"])

        stored(hidden.select("path", "name").mapInArrow(copy, "path string"), "copied")
        self.copies = target
        self.paths = [root, target]

    def only(self, wanted: DataFrame) -> None:
        """Let readers open just the files of `wanted` (path), and the copies."""
        paths = self.paths if isinstance(self.paths, list) else [self.paths]
        self.paths = Chosen(paths, wanted, f"{self.copies}/" if self.copies else "")

    def restored(self, rows: DataFrame, column: str = "path") -> DataFrame:
        """`rows` with the original paths of copies."""
        if self.copies is None:
            return rows
        inside = F.regexp_extract(F.col(column), "/shown-[0-9a-f]{32}/(.*)$", 1)
        name = F.regexp_replace(inside, "(^|/)v", "$1")
        base = opened(self.root)
        whole = F.concat(F.lit(base[2] + base[1] + "/"), name)
        return rows.withColumn(column, F.when(inside != "", whole).otherwise(F.col(column)))


def has_hidden_names(folder: str) -> bool:
    """Whether a folder directly holds files that Spark hides; only looked for where pyarrow can open the folder."""
    from pyarrow import fs

    try:
        system, path, _ = opened(folder)
        if system.get_file_info(path).type != fs.FileType.Directory:
            return False
        return any(e.base_name.startswith("_") and "=" not in e.base_name and not e.base_name.startswith("_SUCCESS")
                   and e.type == fs.FileType.File for e in system.get_file_info(fs.FileSelector(path)))
    except (OSError, ValueError):
        return False


def shown_files(spark: SparkSession, folder: str) -> ShownFiles:
    """The files directly in a folder."""
    if not has_hidden_names(folder):
        return ShownFiles(spark, folder)
    listed = list_tree(spark, folder, 1).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return ShownFiles(spark, folder, listed.where(hidden_from_spark(F.col("name")) & (F.col("name") != "_SUCCESS")))
