"""Files of fixed-size blocks of records, as a Spark data source.

A file is a sequence of blocks. Each block has a header, a fixed number of
record slots and a trailer; numbers are little-endian. ``BlockFileSource`` splits
files into ranges of whole blocks, so executors read them in parallel, as Arrow
batches. Paths go through pyarrow's file systems: a plain path or a URI such as
file:, hdfs: or s3:, which every executor must be able to open.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graniteq.deploy import ship_package
from graniteq.records import RECORD_SCHEMA, ROWS_PER_BLOCK, STRING_WIDTH

# Fixed values of the format.
RECORD = np.dtype(
    {
        "names": ["recid", "num", "str", "valid"],
        "formats": ["<u4", "<u4", f"V{STRING_WIDTH}", "u1"],
        "offsets": [0, 4, 8, 128],
        "itemsize": 132,
    }
)
BLOCK = np.dtype(
    {
        "names": ["blockid", "nreserved", "entries", "valid", "misc", "next_blockid", "dummy"],
        "formats": ["<u4", "<u4", (RECORD, ROWS_PER_BLOCK), "u1", "u1", "<u4", "<u4"],
        "offsets": [0, 4, 8, 13208, 13209, 13212, 13216],
        "itemsize": 13220,
    }
)

BLOCKS_PER_SPLIT = 5_000


BLOCKS_AT_ONCE = 64
SUFFIX = ".blocks"


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if re.match(r"file:/+", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class BlockRange(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        super().__init__((path, first, count))
        self.path, self.first, self.count = path, first, count


class BlockFileReader(DataSourceReader):
    def __init__(self, path: str, blocks_per_split: int):
        self.path, self.blocks_per_split = path, blocks_per_split

    def partitions(self):
        system, path = _located(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else sorted((f for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(SUFFIX)), key=lambda f: f.path)
        out, step = [], self.blocks_per_split
        for f in files:
            if f.size % BLOCK.itemsize:
                raise ValueError(f"{f.path}: {f.size} bytes are not a whole number of blocks of {BLOCK.itemsize}")
            total = f.size // BLOCK.itemsize
            out += [BlockRange(f.path, i, min(step, total - i)) for i in range(0, total, step)]
        return out or [BlockRange("", 0, 0)]

    def read(self, partition):
        if not partition.count:
            return
        system, _ = _located(self.path)
        with system.open_input_file(partition.path) as f:
            for at in range(partition.first, partition.first + partition.count, BLOCKS_AT_ONCE):
                n = min(BLOCKS_AT_ONCE, partition.first + partition.count - at)
                yield _records(np.frombuffer(f.read_at(n * BLOCK.itemsize, at * BLOCK.itemsize), BLOCK), at)


def _records(blocks: np.ndarray, first: int) -> pa.RecordBatch:
    """The reserved slots of blocks, the first of which has number ``first`` in its file."""
    reserved = np.arange(ROWS_PER_BLOCK) < blocks["nreserved"][:, None]
    block, slot = np.nonzero(reserved)
    r = blocks["entries"][block, slot]
    text = [x.split(b"\0", 1)[0].decode("utf-8", "replace") for x in np.ascontiguousarray(r["str"]).view(f"S{STRING_WIDTH}").ravel().tolist()]
    columns = [
        pa.array(r["recid"].astype(np.int64)),
        pa.array(r["num"].astype(np.int64)),
        pa.array(text, pa.string()),
        pa.array(r["valid"].astype(bool)),
        pa.array(block + first, pa.int64()),
        pa.array(blocks["valid"][block].astype(bool)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=RECORD_SCHEMA.names)


class BlockFileSource(DataSource):
    """Options: ``path``, and ``blocks_per_split`` for the size of a partition."""

    @classmethod
    def name(cls):
        return "blockfile"

    def schema(self):
        return RECORD_SCHEMA

    def reader(self, schema):
        return BlockFileReader(self.options["path"], int(self.options.get("blocks_per_split", BLOCKS_PER_SPLIT)))


def read_blocks(spark: SparkSession, path: str, blocks_per_split: int = BLOCKS_PER_SPLIT) -> DataFrame:
    """The reserved slots of a block file, or of all those in a folder, valid or not, with ``block_id`` (within its file) and ``block_valid``."""
    ship_package(spark)
    spark.dataSource.register(BlockFileSource)
    return spark.read.format("blockfile").option("path", path).option("blocks_per_split", blocks_per_split).load()


def write_blocks(df: DataFrame, folder: str) -> None:
    """Write records (recid, num, str, valid; others are ignored) as block files into a new folder.

    Each partition becomes one file ``part-<n>.blocks``, put in place by a rename
    once it is whole, so a task that is run again leaves one file. The folder
    must be one that all executors share.
    """
    ship_package(df.sparkSession)
    system, inside = _located(folder)
    if system.get_file_info(inside).type != fs.FileType.NotFound:
        raise FileExistsError(folder)
    system.create_dir(inside)
    rows = df.select("recid", "num", "str", F.col("valid") if "valid" in df.columns else F.lit(True).alias("valid"))

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        system, inside = _located(folder)
        out = f"{inside}/part-{context.partitionId():05d}{SUFFIX}"
        part = f"{out}.{context.taskAttemptId()}"
        written, held = 0, pa.table({})

        with system.open_output_stream(part) as f:
            for batch in batches:
                new = pa.Table.from_batches([batch])
                held = pa.concat_tables([held, new]) if len(held) else new
                whole = len(held) // ROWS_PER_BLOCK * ROWS_PER_BLOCK
                if whole:
                    f.write(_blocks_of(held.slice(0, whole), written))
                    written += whole // ROWS_PER_BLOCK
                    held = held.slice(whole)
            if len(held):
                f.write(_blocks_of(held, written))
        system.move(part, out)
        return iter(())

    rows.mapInArrow(write, rows.schema).write.format("noop").mode("overwrite").save()


def _blocks_of(rows: pa.Table, first: int) -> bytes:
    """Block images of records, numbered from ``first``; only the last may be partly filled."""
    n = len(rows)
    raw = [x.encode() for x in rows.column("str").to_pylist()]
    longest = max(range(n), key=lambda i: len(raw[i]))
    if len(raw[longest]) >= STRING_WIDTH:
        raise ValueError(f"recid {rows.column('recid')[longest].as_py()}: {len(raw[longest])} bytes of text; at most {STRING_WIDTH - 1} fit")
    count = -(-n // ROWS_PER_BLOCK)
    entries = np.zeros(count * ROWS_PER_BLOCK, RECORD)
    entries["recid"][:n], entries["num"][:n], entries["valid"][:n] = (rows.column(c).to_numpy() for c in ("recid", "num", "valid"))
    entries["str"][:n] = np.array(raw, f"S{STRING_WIDTH}").view(f"V{STRING_WIDTH}")
    blocks = np.zeros(count, BLOCK)
    blocks["blockid"], blocks["valid"], blocks["entries"] = np.arange(first, first + count), 1, entries.reshape(count, ROWS_PER_BLOCK)
    blocks["nreserved"] = np.minimum(ROWS_PER_BLOCK, n - ROWS_PER_BLOCK * np.arange(count))
    return blocks.tobytes()
