"""File rows with their place, and stitching of records that span splits.

A file of up to one split is read whole by one task. A larger file is cut into
splits as usual. One scan leaves a summary per split; from the summaries every split
knows how it starts, and a second scan joins pieces to records as it goes. Only the
records at the edges of splits meet in a shuffle, so no task ever needs a whole file.

Every reader returns ``path``, ``pos`` and a payload. ``pos`` is a struct
(block, row, item) that orders the records of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import prepare, stored

WHOLE_FILE_BYTES = 64 * 1024 * 1024


def _reader(spark: SparkSession, glob: str | None, recursive: bool):
    reader = prepare(spark).read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return reader


def readable(uri: Column) -> Column:
    """A file URI as a path: names with blanks and other marks come percent-encoded."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(uri, F.lit("%")), decoded).otherwise(uri)


def file_path() -> Column:
    """Path of the file a row was read from."""
    return readable(F.col("_metadata.file_path"))


class Chosen(list):
    """Paths to read, and a mark of 2**20 bits for the files wanted below them.

    The mark is a test on file metadata, so the file index leaves other files out before any is opened. It has one
    size whatever the number of files; a file may pass it unwanted (by a hash), so callers still join with what they want.
    """

    BITS = 1 << 20

    def __init__(self, paths: list[str], wanted: DataFrame, besides: str = ""):
        """`wanted` has a column ``path``; files with `besides` in their path are wanted as well."""
        super().__init__(paths)
        place_ = self._place(F.col("path")) + 1
        parts = wanted.groupBy(F.bitmap_bucket_number(place_).alias("part")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(place_)).alias("bits"))
        self.bits, self.besides = bytearray(self.BITS // 8), besides
        for row in parts.collect():  # at most 32 rows of 4 KB
            begin = (row["part"] - 1) * len(row["bits"])
            self.bits[begin : begin + len(row["bits"])] = row["bits"]

    @classmethod
    def _place(cls, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(cls.BITS))

    def keeps(self, path: Column) -> Column:
        place_ = self._place(path)
        byte = F.substring(F.lit(bytes(self.bits)), F.shiftright(place_, 3).cast("int") + 1, F.lit(1))
        number = F.conv(F.hex(byte), 16, 10).cast("int")
        kept = F.pmod(F.floor(number / F.pow(F.lit(2.0), F.pmod(place_, F.lit(8)))), F.lit(2)) == 1
        return kept | F.contains(path, F.lit(self.besides)) if self.besides else kept


def plain_paths(path):
    """`path` as Spark's readers take it, which know strings and plain lists."""
    return path if isinstance(path, str) else list(path)


def chosen_only(df: DataFrame, path) -> DataFrame:
    """`df`, just read from `path`, without files that a ``Chosen`` path leaves out."""
    return df.where(path.keeps(file_path())) if isinstance(path, Chosen) else df


def list_files(spark: SparkSession, path, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """``path, length`` of every file. File contents are not read."""
    files = chosen_only(_reader(spark, glob, recursive).format("binaryFile").load(plain_paths(path)), path)
    return files.select(file_path().alias("path"), F.col("_metadata.file_size").alias("length"))


def has_larger_files(spark, path, limit: int, glob=None, recursive=False) -> bool:
    return not list_files(spark, path, glob, recursive).where(F.col("length") > limit).isEmpty()


def read_lines(
    spark: SparkSession,
    path,
    glob: str | None = None,
    recursive: bool = False,
    line_sep: str | None = None,
    larger_than: int | None = None,
    up_to: int | None = None,
) -> DataFrame:
    """``path, block, row, value``: splittable line scan; ``row`` orders lines within a split.

    The size bounds filter on file metadata, so files outside them are not opened.
    """
    reader = _reader(spark, glob, recursive)
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    lines = chosen_only(reader.text(plain_paths(path)), path)
    if larger_than is not None:
        lines = lines.where(F.col("_metadata.file_size") > larger_than)
    if up_to is not None:
        lines = lines.where(F.col("_metadata.file_size") <= up_to)
    return lines.select(
        file_path().alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )


def read_whole(spark, path, glob=None, recursive=False, up_to: int | None = None) -> DataFrame:
    """``path, value``: one row per file."""
    files = chosen_only(_reader(spark, glob, recursive).text(plain_paths(path), wholetext=True), path)
    if up_to is not None:
        files = files.where(F.col("_metadata.file_size") <= up_to)
    return files.select(file_path().alias("path"), "value")


def position(block, row, item=None) -> Column:
    item = F.lit(0) if item is None else item
    return F.struct(
        F.lit(block).cast("bigint").alias("block") if not isinstance(block, Column) else block.alias("block"),
        row.cast("bigint").alias("row"),
        item.cast("int").alias("item"),
    )


def place(lines: DataFrame) -> DataFrame:
    """Lines as records: ``path, pos, value``."""
    return lines.select("path", position(F.col("block"), F.col("row")).alias("pos"), "value")


# ---- carrying state across the splits of a file ---------------------------

SPLIT = ("path", "block")


def _file_window():
    return W.partitionBy("path").orderBy("block")


def attach_split_state(rows: DataFrame, per_split: DataFrame, *columns: str) -> DataFrame:
    """Join one summary row per split back to the rows of the split; a missing summary fails."""
    joined = rows.join(per_split.select(*SPLIT, F.lit(True).alias("_has"), *columns), list(SPLIT), "left")
    check = F.when(F.col("_has"), F.col("row")).otherwise(
        F.raise_error(F.lit("split boundaries changed between two scans")).cast("bigint")
    )
    return joined.withColumn("row", check).drop("_has")


#: Pieces handled at once by a Python worker, and bytes of the records it holds before it hands them on.
PIECES_AT_ONCE = 512
HELD_BYTES = 4 << 20


def _pieces(batches):
    """Rows of Arrow batches as tuples, some at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, PIECES_AT_ONCE):
            part = batch.slice(begin, PIECES_AT_ONCE)
            yield from zip(*[column.to_pylist() for column in part.columns], strict=True)


def split_summaries(pieces: DataFrame, begin, schema: str, label: str = "splits") -> DataFrame:
    """A small table of ``path, block`` and the columns of `schema`: what the pieces of each split come to.

    ``begin()`` gives a pair: a function called with the bytes of every piece in file order, and one that gives the
    values of `schema` at the split's end.
    """
    def run(batches):
        import pyarrow as pa

        found, at, finish = [], None, None
        for path, block, value in _pieces(batches):
            if (path, block) != at:
                if at:
                    found.append((*at, *finish()))
                at, (add, finish) = (path, block), begin()
            add(value)
        if at:
            found.append((*at, *finish()))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*found, strict=True)], names)

    names = ["path", "block", *[part.split()[0] for part in schema.split(", ")]]
    lines = pieces.select("path", "block", F.col("value").cast("binary").alias("value"))
    return stored(lines.mapInArrow(run, f"path string, block bigint, {schema}"), label)


def cut_records(
    pieces: DataFrame, begin, separator: str, splits: DataFrame | None = None, start: tuple[str, ...] = (),
    kept: str | None = None, first_only: bool = False,
) -> DataFrame:
    """``path, pos, value, ended, first``: pieces of files joined to records, without moving the pieces.

    ``begin(*start)`` gives a function of a piece's bytes: True if a record ends with it, False if not, None to leave it
    out. `splits` has a row per split, with the columns `start` that tell how it starts and `kept`, whether its file is
    wanted. ``ended`` is false for what follows the last end of a file, ``first`` marks a file's first record; with
    `first_only` no others are given.
    """
    glue = separator.encode()

    def run(edges: bool):
        def cut(batches):
            import pyarrow as pa

            out, size, at, held, lead, step, row_ = [], 0, None, [], True, None, None

            def add(ended):
                nonlocal size
                if (lead or not ended) == edges:
                    out.append((*at, row_, glue.join(held), ended))
                    size += len(out[-1][3])

            def batch():
                columns = zip(*out, strict=True)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "block", "row", "value", "ended"])

            for path, block, row, value, *state in _pieces(batches):
                if (path, block) != at:
                    if held:
                        add(False)
                    at, held, lead, step = (path, block), [], True, begin(*state)
                ends = step(value)
                if ends is None:
                    continue
                if not held:
                    row_ = row
                if edges and not lead and ends:  # a record that lies inside the split
                    held = []
                    continue
                held.append(value)
                if ends:
                    add(True)
                    held, lead = [], False
                if size > HELD_BYTES:
                    yield batch()
                    out, size = [], 0
            if held:
                add(False)
            if out:
                yield batch()

        return cut

    rows = pieces
    if splits is not None:
        # one small row per split, shipped to the scans: the order of the pieces is kept
        columns = [*start, kept] if kept else list(start)
        rows = attach_split_state(rows, F.broadcast(splits.select(*SPLIT, *columns)), *columns)
        rows = rows.where(kept) if kept else rows
    rows = rows.select("path", "block", "row", F.col("value").cast("binary").alias("value"), *start)
    schema = "path string, block bigint, row bigint, value binary, ended boolean"
    # at most two records per split, kept so that no later use of the records scans for them again
    edges = stored(rows.mapInArrow(run(True), schema), "edges")
    before = W.partitionBy("path").orderBy("block", "row").rowsBetween(W.unboundedPreceding, -1)
    edges = edges.withColumn("part", F.coalesce(F.sum(F.col("ended").cast("int")).over(before), F.lit(0)))
    piece = F.struct("block", "row", F.col("value").cast("string").alias("v"))
    ordered = F.array_sort(F.collect_list(piece))
    edges = edges.where("part = 0") if first_only else edges
    edges = edges.groupBy("path", "part").agg(ordered.alias("p"), F.max("ended").alias("ended")).select(
        "path", position(F.col("p")[0]["block"], F.col("p")[0]["row"]).alias("pos"),
        F.array_join(F.transform("p", lambda p: p["v"]), separator).alias("value"), "ended", (F.col("part") == 0).alias("first"),
    )
    if first_only:
        return edges
    inside = rows.mapInArrow(run(False), schema)
    return edges.unionByName(inside.select(
        "path", position(F.col("block"), F.col("row")).alias("pos"), F.col("value").cast("string").alias("value"), "ended",
        F.lit(False).alias("first"),
    ))


def with_ordinal(records: DataFrame, name: str = "ordinal") -> DataFrame:
    """0-based number of each record in its file, whatever the splits.

    Records are counted per split first; only the counts cross splits.
    """
    rows = records.withColumn("block", F.col("pos.block"))
    counts = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(_file_window().rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("path", "block", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    inside = F.row_number().over(W.partitionBy("path", "block").orderBy("pos")) - 1
    rows = rows.withColumn("row", inside.cast("bigint"))
    rows = attach_split_state(rows, counts, "_earlier")
    return rows.withColumn(name, F.col("row") + F.col("_earlier")).drop("block", "row", "_earlier")


def sample_id(records: DataFrame) -> DataFrame:
    """Add ``sample_id``: file path and record number, independent of the cluster's size."""
    numbered = with_ordinal(records, "_ordinal")
    return numbered.withColumn(
        "sample_id", F.concat("path", F.lit("#"), F.col("_ordinal").cast("string"))
    ).drop("_ordinal")
