"""Small driver-side files on any Hadoop file system (local, s3a, gs, abfss): manifests are written aside and renamed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def read_bytes(spark: SparkSession, path: str, start: int = 0, length: int | None = None) -> bytes:
    """A range of a file (all of it by default)."""
    fs, p, jvm = _fs(spark, path)
    size = fs.getFileStatus(p).getLen()
    n = max(0, min(size - start, size if length is None else length))
    stream = fs.open(p)
    try:
        stream.seek(start)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
    finally:
        stream.close()


def length(spark: SparkSession, path: str) -> int:
    fs, p, _ = _fs(spark, path)
    return fs.getFileStatus(p).getLen() if fs.getFileStatus(p).isFile() else fs.getContentSummary(p).getLength()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Readers see the old file or the new one, never a part."""
    fs, p, jvm = _fs(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(data)
    out.hsync()
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(aside, p):
        raise OSError(f"can't write {path}")


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_bytes(spark, path))


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_bytes(spark, path, json.dumps(value, sort_keys=True, indent=1).encode())
