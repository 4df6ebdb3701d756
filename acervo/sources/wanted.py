"""A Python data source of files that a table of paths asks for.

The paths lie in the shared folder as small Parquet files; each of these is a
partition, and the task that gets it opens its files itself. Nothing is listed
or opened on the driver, however many paths there are. Every path gives a row:
a file that isn't there or can't be read is one with an error code.

Files must lie in a store that pyarrow opens (a mounted folder, HDFS, S3, GCS
or Azure).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from acervo.session import qualified, shared_dir

# --- fixed values -----------------------------------------------------------
MISSING = "PDF_REQUIRED"
UNREADABLE = "UPLOAD_PROCESSING_FAILED"
TOO_LARGE = "PDF_TOO_LARGE"
# ----------------------------------------------------------------------------

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary, error_code string"
PATHS_A_TASK = 64
BATCH_BYTES = 16 << 20


def opened(path: str, default_store: str):
    """The store of a path and its place there; a path without a scheme lies in the default store."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        # As Hadoop has it: file:/ or hdfs://host:port/
        scheme, _, root = default_store.partition(":")
        rest = path if scheme == "file" else root.rstrip("/") + path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{rest}")


class WantedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.default_store = options["requests"], options["defaultStore"]
        self.max_bytes = int(options["maxBytes"]) if options.get("maxBytes") else None

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, folder = opened(self.folder, self.default_store)
        found = store.get_file_info(fs.FileSelector(folder))
        return [InputPartition(f.path) for f in found if f.path.endswith(".parquet")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        store, _ = opened(self.folder, self.default_store)
        schema = pa.schema(
            [("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary()), ("error_code", pa.string())]
        )
        rows, size = [], 0
        for path in parquet.read_table(partition.value, filesystem=store, partitioning=None).column("path").to_pylist():
            rows.append(self._row(path))
            size += len(rows[-1][3] or b"")
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def _row(self, path: str) -> tuple:
        from pyarrow import fs

        try:
            store, at = opened(path, self.default_store)
            info = store.get_file_info(at)
            if info.type != fs.FileType.File:
                return path, None, None, None, MISSING
            if self.max_bytes is not None and info.size > self.max_bytes:
                return path, info.mtime, info.size, None, TOO_LARGE
            with store.open_input_stream(at) as stream:
                return path, info.mtime, info.size, stream.read(), None
        except Exception:  # one bad file is a row, not a failure
            return path, None, None, None, UNREADABLE


class WantedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "acervo_wanted_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WantedReader:
        return WantedReader(self.options)


def load(spark: SparkSession, paths: DataFrame, max_bytes: int | None = None, paths_a_task: int = PATHS_A_TASK) -> DataFrame:
    """A row for each path of a table (``path``): path, modificationTime, length, content, error_code."""
    folder = shared_dir(spark, "wanted")
    paths.select("path").write.option("maxRecordsPerFile", paths_a_task).parquet(folder)
    spark.dataSource.register(WantedFiles)
    options = {"requests": qualified(spark, folder), "defaultStore": qualified(spark, "/")}
    return spark.read.format(WantedFiles.name()).options(**options, **({"maxBytes": str(max_bytes)} if max_bytes is not None else {})).load()
