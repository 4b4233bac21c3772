"""Rows of one width in binary files, read by byte ranges: many tasks to a long file.

Tasks open files through pyarrow's file systems (POSIX, HDFS, S3, GCS). Stores that it doesn't know are read whole, a file to
a task, through Spark's binaryFile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sink import hadoop

#: Bytes of a range, about, and rows that leave a task at once.
RANGE, PORTION = 64 << 20, 50_000

_SPARK = {"i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}


def listed(spark: SparkSession, path: str | list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path, a folder, a pattern or several of them name."""
    out = set()
    for one in [path] if isinstance(path, str) else path:
        fs, where = hadoop(spark, one)
        for s in fs.globStatus(where) or []:
            for f in fs.listStatus(s.getPath()) if s.isDirectory() else [s]:
                if f.isFile() and not f.getPath().getName().startswith(("_", ".")):
                    out.add((f.getPath().toString(), f.getLen()))
    return sorted(out)


def opened(path: str):
    """A file to read from any place of."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    own, where = fs.FileSystem.from_uri(path)
    return own.open_input_file(where)


def reachable(path: str) -> bool:
    """Whether tasks can open files of a path on their own."""
    try:
        opened(path).close()
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def rows(spark: SparkSession, path: str, kind: np.dtype) -> DataFrame:
    """file, row (from 0), and the fields of `kind` in each row."""
    files = listed(spark, path)
    names = ["file", "row", *kind.names]
    shape = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), *(T.StructField(n, _SPARK[kind[n].str[1:]]) for n in kind.names)])

    def batch(file: str, first: int, table: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array([file] * len(table)), pa.array(np.arange(first, first + len(table))), *(pa.array(table[n].astype(kind[n].newbyteorder("="))) for n in kind.names)], names=names)

    if files and not reachable(files[0][0]):

        def whole(batches):
            for b in batches:
                for file, content in zip(b.column("path").to_pylist(), b.column("content")):
                    content = content.as_py()
                    table = np.frombuffer(content, kind, len(content) // kind.itemsize)
                    for a in range(0, len(table), PORTION):
                        yield batch(file, a, table[a : a + PORTION])

        return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(whole, shape)

    step = max(1, RANGE // kind.itemsize)
    shares = [(file, a, min(a + step, size // kind.itemsize)) for file, size in files for a in range(0, size // kind.itemsize, step)]

    def run(batches):
        for b in batches:
            for file, a, z in zip(*(b.column(k).to_pylist() for k in range(3))):
                with opened(file) as f:
                    f.seek(a * kind.itemsize)
                    for first in range(a, z, PORTION):
                        n = min(PORTION, z - first)
                        yield batch(file, first, np.frombuffer(f.read(n * kind.itemsize), kind))

    held = spark.createDataFrame(shares, "file string, first long, end long")
    return held.repartitionByRange(max(1, min(len(shares), 10_000)), "file", "first").mapInArrow(run, shape)
