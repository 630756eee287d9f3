"""Small control files on the file system of their path: configurations, cursors, submissions. They are written
to a temporary name and renamed over the old file in one step, so a reader sees the old file or the new one, and a
crash loses neither."""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, where, fs = _file(spark, path)
    return fs.exists(where)


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    jvm, where, fs = _file(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    jvm, where, fs = _file(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    options = jvm.org.apache.hadoop.fs.Options
    replace = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    replace[0] = getattr(options, "Rename").OVERWRITE
    try:
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(where).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(part), fs.makeQualified(where), replace)
    finally:
        fs.delete(part, False)


def read(spark: SparkSession, path: str) -> Any:
    data = read_bytes(spark, path)
    return None if data is None else json.loads(data)


def write(spark: SparkSession, path: str, value: Any) -> None:
    write_bytes(spark, path, (json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode())


def digest(spark: SparkSession, *paths: str) -> str:
    """SHA-256 of what the files under ``paths`` hold, in the order of their names: a changed file under the same path
    makes another run. Contents are read by Spark's tasks; names that begin with _ or . are no data."""
    from pyspark.sql import functions as F

    whole = hashlib.sha256()
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        rows = files.select("path", F.sha2("content", 256).alias("h")).where(~F.col("path").rlike(r"/[_.][^/]*$")).orderBy("path").collect()
        for r in rows:
            whole.update(f"{r['path'].rsplit('/', 1)[-1]}\0{r['h']}\n".encode())
    return whole.hexdigest()


def delete(spark: SparkSession, path: str) -> None:
    _, where, fs = _file(spark, path)
    fs.delete(where, True)


def same_run(spark: SparkSession, path: str, config: dict, state_exists: bool, replace: bool = False) -> None:
    """Keep ``config`` beside the state of a run, or refuse a state of another configuration or of none. With ``replace``
    the state is about to be written anew."""
    known = None if replace else read(spark, path)
    if known is None:
        if state_exists:
            raise ValueError(f"there is state but no configuration at {path}")
        write(spark, path, config)
    elif known != config:
        keys = sorted(k for k in {*known, *config} if known.get(k) != config.get(k))
        raise ValueError(f"state at {path} belongs to another configuration: {', '.join(keys)}")
