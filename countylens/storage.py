"""Folders and small records in any store that Spark reaches, and tables that cut a long lineage.

Work tables of a run lie in one folder, named by the application, under the folder all executors share.
They are removed one by one when their maker says so, and all together when the session's process
ends; what a killed driver leaves behind can be told by its application's name.
"""

from __future__ import annotations

import atexit
import json
import re
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

from countylens.session import shared_dir

_LEFT: set[str] = set()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file(spark, path)
    return files.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies right inside a folder, in order; nothing where there is none."""
    files, at = _file(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """The folders that match a pattern, as paths that take no character for a pattern."""
    files, at = _file(spark, pattern)
    return sorted(_literal(f.getPath().toString()) for f in files.globStatus(at) or () if f.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    files, at = _file(spark, path)
    files.delete(at, True)


def rename(spark: SparkSession, path: str, new: str) -> None:
    files, at = _file(spark, path)
    to = spark._jvm.org.apache.hadoop.fs.Path(new)
    files.mkdirs(to.getParent())
    if not files.rename(at, to):
        raise OSError(f"{path} could not be named {new}")


def put_record(spark: SparkSession, path: str, record: dict) -> bool:
    """A record as JSON, put in place whole: written beside it and renamed. False if there is one already.

    Two writers at once need a store whose rename refuses a taken name, as HDFS does.
    """
    files, at = _file(spark, path)
    if files.exists(at):
        return False
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    files.mkdirs(at.getParent())
    out = files.create(beside, True)
    out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
    out.close()
    placed = files.rename(beside, at)
    if not placed:
        files.delete(beside, False)
    return placed


def record(spark: SparkSession, path: str) -> dict:
    """A record put in place by ``put_record``."""
    files, at = _file(spark, path)
    held = files.open(at)
    try:
        return json.loads(bytes(held.readAllBytes()).decode())
    finally:
        held.close()


def first_lines(spark: SparkSession, path: str, count: int) -> list[str] | None:
    """The first lines of a text file, packed or not, of which no more is read; None for a file of no bytes."""
    files, at = _file(spark, path)
    conf = spark._jsc.hadoopConfiguration()
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    stream = files.open(at)
    try:
        plain = codec.createInputStream(stream) if codec else stream
        held = b""
        while held.count(b"\n") < count:
            more = bytes(plain.readNBytes(1 << 16))
            if not more:
                break
            held += more
    finally:
        stream.close()
    return re.split("\r\n|\n|\r", held.decode("utf-8-sig", "replace"))[:count] if held else None


def data_files(df: DataFrame) -> list[str]:
    """The files a scan reads, as paths that take no character for a pattern."""
    jvm = df.sparkSession._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in df.inputFiles()]
    return sorted(map(_literal, paths))


def _literal(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for work tables, removed at the end of the process at the latest."""
    if not _LEFT:
        atexit.register(clear, spark)
    root = f"{shared_dir(spark).rstrip('/')}/countylens-{spark.sparkContext.applicationId}"
    _LEFT.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str, codec: str = "snappy") -> DataFrame:
    """The rows written to a path and read from there: a lost executor costs a reread, not a new run.

    What was shuffled for it is removed once it is written; else such files stay on the executors' disks until
    the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path, compression=codec)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all work tables made so far; tables built on them can be read no more."""
    while _LEFT:
        with suppress(Exception):  # the store may be gone by the end of the process
            remove(spark, _LEFT.pop())
