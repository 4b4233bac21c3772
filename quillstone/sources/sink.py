"""Files that many tasks write at once: no row, and no encoded byte, goes through the driver.

Tasks encode sorted rows into bodies that are stored with their place in the part they belong to; the parts' sizes,
a number for each task, tell where each body goes. On a POSIX folder that all executors share, tasks write bodies at these
offsets of one file; a task that runs again writes the same bytes to the same place. On other file systems bodies
become files that the file system itself concatenates.
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import stored

_BODY = "part int, at long, rows long, body binary"


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Spark's own."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def bodies(df: DataFrame, encode) -> DataFrame:
    """part, at (bytes before it in its part), rows, body of df's rows in the order of its partitions, stored.
    encode: from an Arrow batch to bytes."""

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            if b.num_rows:
                body = encode(b)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([b.num_rows], pa.int64()), pa.array([body], pa.binary())], names=["part", "at", "rows", "body"])
                at += len(body)

    return stored(df.mapInArrow(run, _BODY))


def rows_of(body: DataFrame) -> int:
    return body.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]


def _write_at(path: str, at: int, body: bytes) -> int:
    """At an offset of a file that is there already."""
    f = os.open(path, os.O_WRONLY)
    try:
        view, done = memoryview(body), 0
        while done < len(view):
            done += os.pwrite(f, view[done:], at + done)
    finally:
        os.close(f)
    return done


def write_file(spark: SparkSession, path: str, head: bytes, parts: list[DataFrame]) -> None:
    """One file: head, and then the bodies of each of parts (as bodies() makes them). A file of that name is replaced."""
    fs, to = hadoop(spark, path)
    sized, total = [], len(head)
    for k, body in enumerate(parts):
        sizes = body.groupBy("part").agg(F.sum(F.length("body")).alias("size")).collect()  # a row for each task
        base = {}
        for r in sorted(sizes, key=lambda r: r["part"]):
            base[r["part"]], total = total, total + r["size"]
        starts = spark.createDataFrame(list(base.items()), "part int, base long")
        sized.append(body.join(F.broadcast(starts), "part").select(F.lit(k).alias("k"), (F.col("base") + F.col("at")).alias("offset"), "body"))
    scratch = f"{path}.{uuid.uuid4().hex}"
    if fs.getScheme() == "file":
        made = _in_place(spark, hadoop(spark, scratch)[1].toUri().getPath(), head, sized)
    else:
        made = _concatenated(spark, fs, scratch, head, sized)
    if made != total - len(head):
        raise OSError(f"{path}: {made} bytes were written, not {total - len(head)}")
    fs.delete(to, False)
    if not fs.rename(hadoop(spark, scratch)[1], to):
        raise OSError(f"{path} can't be written")


def _written_bytes(sized: list[DataFrame], put) -> int:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([put(at, body.as_py()) for at, body in zip(b.column("offset").to_pylist(), b.column("body"))], pa.int64())})

    return sum(x.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] for x in sized)


def _in_place(spark: SparkSession, scratch: str, head: bytes, sized: list[DataFrame]) -> int:
    os.makedirs(os.path.dirname(scratch), exist_ok=True)
    with open(scratch, "wb") as f:
        f.write(head)
    return _written_bytes(sized, lambda at, body: _write_at(scratch, at, body))


def _concatenated(spark: SparkSession, fs, scratch: str, head: bytes, sized: list[DataFrame]) -> int:
    folder = f"{scratch}.parts"

    def put(at: int, body: bytes) -> int:
        from pyarrow import fs as arrow

        own, where = arrow.FileSystem.from_uri(f"{folder}/{at:020d}")  # names in the order of their bytes
        with own.open_output_stream(where) as out:
            out.write(body)
        return len(body)

    fs.mkdirs(hadoop(spark, folder)[1])
    made = _written_bytes(sized, put)
    out = fs.create(hadoop(spark, scratch)[1], True)
    out.write(bytearray(head))
    out.close()
    found = sorted((s.getPath() for s in fs.listStatus(hadoop(spark, folder)[1])), key=str)
    if found:
        array = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, len(found))
        for k, p in enumerate(found):
            array[k] = p
        fs.concat(hadoop(spark, scratch)[1], array)
    fs.delete(hadoop(spark, folder)[1], True)
    return made


def write_named_lines(rows: DataFrame, folder: str, name: str = "name", order: str = "line_no", line: str = "line") -> None:
    """A text file in folder for each value of `name`, of its lines in order. A file is written by one task; the
    driver gives Spark's part files their names, and sees no line."""
    spark = rows.sparkSession
    scratch = f"{folder}.{uuid.uuid4().hex}"
    dealt = rows.repartition(name).sortWithinPartitions(name, order).select(name, F.col(line).alias("value"))
    dealt.write.option("maxRecordsPerFile", 0).partitionBy(name).text(scratch)
    fs, at = hadoop(spark, scratch)
    fs.mkdirs(hadoop(spark, folder)[1])
    for kind in fs.listStatus(at):
        key, _, value = kind.getPath().getName().partition("=")
        if key != name:
            continue
        (part,) = [s.getPath() for s in fs.listStatus(kind.getPath()) if s.getPath().getName().startswith("part-")]
        if not fs.rename(part, hadoop(spark, f"{folder}/{value}")[1]):
            raise OSError(f"{folder}/{value} can't be written")
    fs.delete(at, True)
