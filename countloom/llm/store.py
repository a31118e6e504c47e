"""Files in the folder that driver and executors share, and bounds on batches."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

from ..sources.shared import discard, drop_unread, fresh_path, materialise, shared_dir

__all__ = ["attempt_name", "discard", "drop_unread", "fresh_path", "materialise", "open_fs", "read_bytes", "shared_dir", "small_batches", "write_bytes"]

_BATCH, _ROWS = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"


def small_batches(spark: SparkSession, mb: int = 8, rows: int = 512) -> None:
    """Bounds the bytes of the Arrow batches that go to Python workers and the rows of a reader's batch, where texts may be long. A lower bound that is set stays."""
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > mb << 20:
        spark.conf.set(_BATCH, str(mb << 20))
    if int(spark.conf.get(_ROWS)) > rows:
        spark.conf.set(_ROWS, str(rows))


def open_fs(uri: str):
    """(file system, path) of a URI, on the driver or an executor."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    # Hadoop's names of one store.
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def attempt_name(shard: int) -> str:
    """A file name of this attempt's own: the driver's list of what tasks report says which attempt counts."""
    return f"{shard:06d}-{uuid.uuid4().hex[:12]}"


def write_bytes(uri: str, data: bytes) -> None:
    """Writes a whole new file; no other writer has its name."""
    where, path = open_fs(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(path) as out:
        out.write(data)


def read_bytes(uri: str) -> bytes:
    where, path = open_fs(uri)
    with where.open_input_file(path) as src:
        return src.read()
