"""Named files written by the executors and published as a whole.

A file is given as pieces (path, part, content) and holds them in order of part, so that a report over all documents of a
batch is never one value in memory: rows are dealt out by path, sorted, and streamed into their files. A task
writes under a name of its attempt and renames, so retries and speculative copies leave the same file. When all
are written, the folder gets its name by one rename; until then nobody sees any of it.

Paths must be on a file system that both Spark and pyarrow know (local or mounted folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources import files

LISTED = "path string, bytes long, crc32 long"
#: The list of the files, among them.
LISTING = "_files"


def write_files(pieces: DataFrame, folder: str) -> bool:
    """Writes the files of pieces (path, part, content) below a folder; False if the folder is there already.

    Null contents are empty. Parts of one number have any order. The folder also holds a listing, see listing().
    """
    spark = pieces.sparkSession
    if files.exists(spark, folder):
        return False
    staged = f"{folder.rstrip('/')}-staged-{uuid.uuid4().hex}"
    target = files.qualified(spark, staged)
    fs.FileSystem.from_uri(target)  # refuses what executors could not write

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(target)
        attempt, path, out, size, crc = TaskContext.get().taskAttemptId(), None, None, 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            system.move(f"{root}/{path}.{attempt}", f"{root}/{path}")
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([crc], pa.int64())], names=["path", "bytes", "crc32"])

        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != path:
                    if out:
                        yield done()
                    path, size, crc = p, 0, 0
                    system.create_dir(f"{root}/{p}".rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(f"{root}/{p}.{attempt}")
                data = (content.as_py() or "").encode()
                out.write(data)
                size, crc = size + len(data), zlib.crc32(data, crc)
        if out:
            yield done()

    ordered = pieces.where("path IS NOT NULL").repartition("path").sortWithinPartitions("path", "part").select("path", F.col("content").cast("string"))
    ordered.mapInArrow(write, LISTED).write.json(f"{staged}/{LISTING}")
    if files.rename(spark, staged, folder):
        return True
    files.delete(spark, staged)
    return False


def listing(spark, folder: str) -> DataFrame:
    """path, bytes, crc32 of the files of a folder."""
    return spark.read.schema(LISTED).json(f"{folder}/{LISTING}")
