"""Matrices, ground truth, logs and raw numbers in files that Spark reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rigid import NAMES
from ..functions.text import model_name
from ..operators.fills import last_known
from ..operators.joins import lookup
from ..operators.tables import stored
from . import ranges, sink


def lines(spark: SparkSession, path: str | list[str], blank: bool = True) -> DataFrame:
    """file, line_no (from 0), line; blank: lines of blanks are counted too.

    Files are read by byte ranges, many tasks to a long one. A task numbers the lines of each range it reads, and the ranges'
    counts, a row each, are summed up to give where a range's numbers begin.
    """
    raw = spark.read.text(path).select(F.regexp_replace("_metadata.file_path", "^file:///", "file:/").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    if not blank:
        raw = raw.filter(F.trim(F.regexp_replace("line", r"\s", " ")) != "")

    def run(batches):
        at, n = None, 0
        for b in batches:
            ends = np.array([b.num_rows]) if b.num_rows else np.empty(0, np.int64)
            for k in (0, 1):
                ends = np.union1d(ends, pc.run_end_encode(b.column(k)).run_ends.to_numpy())
            number, first = np.empty(b.num_rows, np.int64), 0
            for end in ends.tolist():
                now = b.column(0)[first].as_py(), b.column(1)[first].as_py()
                if now != at:
                    at, n = now, 0
                number[first:end] = np.arange(n, n + end - first)
                first, n = end, n + end - first
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(number), b.column(2)], names=["file", "start", "own", "line"])

    own = raw.mapInArrow(run, "file string, start long, own long, line string")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy("file", "start").agg((F.max("own") + 1).alias("n"))
    first = stored(counts.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    return lookup(own, first, ["file", "start"]).select("file", (F.col("first") + F.col("own")).alias("line_no"), "line")


def read_matrices(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file and t11 ... t34 of files of sixteen numbers, row by row."""
    v = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), v.alias("v"))
    return rows.select("file", *[F.col("v")[k].cast("double").alias(n) for k, n in enumerate(NAMES)])


def read_occlusion(spark: SparkSession, path: str) -> DataFrame:
    """scene_num, model, occlusion; the first line is a header."""
    w = F.split(F.trim("line"), r"\s+")
    rows = lines(spark, path).filter((F.col("line_no") > 0) & (F.trim("line") != ""))
    return rows.select(w[0].alias("scene_num"), w[1].alias("model"), w[2].try_cast("double").alias("occlusion"))


def parse_log(rows: DataFrame) -> DataFrame:
    """file, line_no, scene_num, model, trans, rot of each line with a distance; rows: file, line_no, line.

    The model is the one that the last line before it names; long logs are filled in spans of lines.
    """
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    token = F.element_at(F.split(F.trim("line"), r"\s+"), 5)
    named = F.when(F.col("line").contains("Transformations for"), model_name(F.substring_index(F.substring_index(token, "/", -1), "_", 1)))
    told = F.col("line").contains("Transformations for") | F.col("line").contains("Distance")
    out = last_known(rows.filter(told), named, "file", "line_no", "model").filter(F.col("line").contains("Distance"))
    words = F.split(F.trim("line"), r"\s+")
    number = lambda k: F.regexp_replace(F.try_element_at(words, F.lit(k)), "[ ,]", "").try_cast("double")
    scene = F.regexp_extract(name, r"^..([^_]*)_", 1)
    return out.select("file", "line_no", scene.alias("scene_num"), "model", number(6).alias("trans"), number(7).alias("rot"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(lines(spark, path))


def read_floats(spark: SparkSession, path: str, width: int) -> DataFrame:
    """file, row, c0 ... of raw little-endian 32-bit floats, `width` to a row; what is left of a file is no row.
    Long files are read by ranges of rows, many tasks to a file."""
    return ranges.rows(spark, path, np.dtype([(f"c{k}", "<f4") for k in range(width)]))


def write_bytes(spark: SparkSession, path: str, chunks) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        for c in chunks:
            out.write(bytearray(c))
    finally:
        out.close()


def write_floats(df: DataFrame, columns: list[str], order: str, path: str) -> None:
    """The columns of each row, in order, as raw little-endian 32-bit floats in one file that all tasks write."""

    def encode(b):
        return np.stack([b.column(c).to_numpy(zero_copy_only=False).astype("<f4") for c in columns], axis=1).tobytes()

    sink.write_file(df.sparkSession, path, b"", [sink.bodies(df.orderBy(order).select(*columns), encode)])


def write_shift(shift: DataFrame, path: str) -> None:
    """The row tx, ty, tz as one line beside a cloud's file."""
    r = shift.first()
    write_bytes(shift.sparkSession, path, [f"{r['tx']:f} {r['ty']:f} {r['tz']:f}\n".encode("ascii")])


def largest_difference(a: DataFrame, b: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """The largest absolute difference of each column of two tables."""
    b = b.select(*on, *[F.col(c).alias("b_" + c) for c in columns])
    return a.join(b, on).agg(*[F.max(F.abs(F.col(c) - F.col("b_" + c))).alias(c) for c in columns])
