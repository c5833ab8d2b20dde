"""Records of a fixed number of bytes as a Python data source: files are planned in byte ranges and read as Arrow batches.

Every range holds whole records, so a file of any size is read by many tasks and a part of a record at its
end is left out.  The files are listed by Spark; their bytes are read by pyarrow's file systems (local and
mounted paths, S3, GCS, HDFS).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and of one batch of it.
RANGE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20

#: Schemes whose files the tasks can open.
SCHEMES = ("", "file", "s3", "s3a", "gs", "gcs", "hdfs")


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    length: int


def ranges(files: list[tuple[str, int]], size: int, most: int) -> list[ByteRange]:
    """Ranges of whole records of ``size`` bytes, each of at most ``most`` bytes (one record at least)."""
    step = max(size, most // size * size)
    return [ByteRange(path, at, min(step, length // size * size - at)) for path, length in files for at in range(0, length // size * size, step)]


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options["files"])
        self.size, self.most = int(options["size"]), int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        return ranges(self.files, self.size, self.most)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        files, path = FileSystem.from_uri(partition.path.replace("s3a:", "s3:", 1))
        step = max(self.size, BATCH_BYTES // self.size * self.size)
        with files.open_input_file(path) as file:
            for at in range(0, partition.length, step):
                data = file.read_at(min(step, partition.length - at), partition.start + at)
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(self.size), len(data) // self.size, [None, pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([rows.cast(pa.binary())], names=["record"])


class RecordSource(DataSource):
    """Options: ``files`` (a JSON list of [URI, bytes]), ``size`` of a record, ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "record binary"

    def reader(self, schema) -> RecordReader:
        return RecordReader({k.lower(): v for k, v in self.options.items()})


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files below a path; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    return [(uri(r.path), r.length) for r in files.select("path", "length").orderBy("path").collect()]


def uri(path: str) -> str:
    """Hadoop writes local files with one slash."""
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def read_records(spark: SparkSession, path: str, size: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(record): every ``size`` bytes of the files below ``path``.

    A store that only Spark can open (a view file system, say) is read by Spark's own record reader, which
    takes files of whole records only.
    """
    if size < 1:
        raise ValueError("a record has at least one byte")
    files = listed(spark, path)
    if any(urlparse(name).scheme not in SCHEMES for name, _ in files):
        odd = [name for name, length in files if length % size]
        if odd:
            raise ValueError(f"{odd[0]} is not of whole records of {size} bytes, and only Spark can open it")
        return spark.createDataFrame(spark.sparkContext.binaryRecords(path, size).map(lambda r: (bytearray(r),)), "record binary")
    if not files:
        return spark.createDataFrame([], "record binary")
    spark.dataSource.register(RecordSource)
    return spark.read.format("records").option("files", json.dumps(files)).option("size", size).option("rangeBytes", range_bytes).load().select(F.col("record"))
