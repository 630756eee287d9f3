"""What the operators share: tables, the shared folder, the package on executors, Arrow helpers."""

from __future__ import annotations

import ctypes
import inspect
import os
import re
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "_framesift_shipped"
_TABLE = "_framesift_table"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of ``sf_dir``, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes that go to a Python worker at once, so that neither side holds many texts; the results don't depend on it.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't share the driver's path, and keep Arrow batches small."""
    sc = spark.sparkContext
    for key, value in BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) > int(value):
            spark.conf.set(key, value)
    if getattr(sc, _SHIPPED, False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="framesift-")), "framesift_code.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(d, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(out)
    setattr(sc, _SHIPPED, True)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). One of our own only where that is unset and everything runs in
    one process: on a cluster the parts of a table would land on different machines."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="framesift-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Paths of the tables that ``cut`` wrote and that are still there, oldest first.
_written: list[str] = []


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later plans start there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/framesift-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _TABLE, path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing reads them any more."""
    for df in tables:
        _delete(df.sparkSession, getattr(df, _TABLE))


def mark() -> int:
    """For ``sweep``: what has been written so far."""
    return len(_written)


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables that ``cut`` wrote since a ``mark``, except those to keep. Results of operators read such tables:
    sweep once they have been read or written elsewhere."""
    kept = {getattr(df, _TABLE) for df in keep}
    for path in [p for p in _written[since:] if p not in kept]:
        _delete(spark, path)


def trim() -> None:
    """Give back to the system what a worker holds but doesn't use: workers outlive their tasks, beside other ones."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def lean(step):
    """The step, with a ``trim`` after its last batch; for a function of one or two tables, after each call."""

    def done(out):
        if isinstance(out, pa.Table):
            trim()
            return out
        return _trimmed(out)

    if len(inspect.signature(step).parameters) == 2:  # Spark looks at the number of arguments
        return lambda left, right: done(step(left, right))
    return lambda data: done(step(data))


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches
    trim()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches again, in slices of about ``most`` bytes of ``column`` (one row at least), so that
    what a step derives from a slice stays bounded."""
    for batch in batches:
        _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def by_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches of whole groups of rows sorted by ``keys``, and where each group begins (and the last ends)."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def edges(batch: pa.RecordBatch) -> list[int]:
        key = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows - 1, bool)
        for k in key:
            new |= k[1:] != k[:-1]
        return [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        whole = joined()
        at = edges(whole)
        if len(at) > 2:
            yield whole.slice(0, at[-2]), at[:-1]
        held = [whole.slice(at[-2])]
        rows = held[0].num_rows
        least = max(least, 2 * rows) if len(at) <= 2 else least  # a long group is not joined again and again
    if held:
        whole = joined()
        yield whole, edges(whole)


#: Words of 64 bits of the filter that ``sieve`` sends to all tasks: as many rows at most, however many keys there are.
SIEVE = 1 << 18


def sieve(df: DataFrame, keys: list[str], among: DataFrame) -> DataFrame:
    """All rows of ``df`` whose ``keys`` stand in ``among``, and few others: what a join that follows would drop isn't
    shuffled for it. A Bloom filter of ``among`` (three bits of the word that a hash of the keys names) is sent to the
    rows. It doesn't grow beyond ``SIEVE`` words; with more than some ten keys a word more rows pass, none is lost."""
    hashed = F.xxhash64(*keys)

    def bit(shift: int):
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, shift).bitwiseAND(63).cast("int"))

    word, mask = F.pmod(hashed, F.lit(SIEVE)), bit(46).bitwiseOR(bit(52)).bitwiseOR(bit(58))
    seen = among.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_seen"))
    out = df.withColumns({"_word": word, "_mask": mask}).join(F.broadcast(seen), "_word")
    return out.where(F.col("_seen").bitwiseAND(F.col("_mask")) == F.col("_mask")).select(*df.columns)


def in_blocks(members: DataFrame, keys: list[str], member: str, size: str, block: int) -> DataFrame:
    """Members of groups dealt out so that no task gets a large group whole. A group of more than ``block``
    members (column ``size``) is split into blocks by a hash of ``member``; each block meets itself and every
    other one in a group of its own, named by ``i`` and ``j``; ``side`` 1 is the block ``j`` where the two
    differ. Other groups are one block. ``size`` may be any measure of which a task should get ``block`` at most."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    out = members.withColumn("_blocks", F.greatest(blocks, F.lit(1))).withColumn("_mine", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    out = out.withColumns({"i": F.least("_mine", "_other"), "j": F.greatest("_mine", "_other"), "side": (F.col("_mine") > F.col("_other")).cast("int")})
    return out.drop("_blocks", "_mine", "_other", size)
