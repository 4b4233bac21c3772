"""What the corpus operators share: intermediate tables, small joins, spreading of small inputs."""

from __future__ import annotations

import atexit
import os
import re
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []

_letters = re.compile(r"[^\W\d_]+")
_numbers = regex.compile(r"[\p{Nl}\p{No}]+")


def letter_words(text: str | None) -> list[str]:
    """Runs of letters (of any script), in lower case."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():  # Python takes numbers such as superscripts and fractions for word characters
        text = _numbers.sub(" ", text)
    return _letters.findall(text)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only a local session without that setting gets a folder under /tmp/checkpoints.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    place = f"file:///tmp/checkpoints/quillstone-{os.getpid()}"
    spark.conf.set("spark.checkpoint.dir", place)
    return place


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read back: lineage ends here.

    The table stays until release() or the end of the process, as results read it lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstone-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._quillstone_path = path
    return back


def dropped(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing will read again."""
    path = df._quillstone_path
    for k, (spark, p) in enumerate(_written):
        if p == path:
            _delete(spark, p)
            del _written[k]
            return


def release() -> None:
    """Deletes all tables made by written(); results that read them can't be computed after it."""
    while _written:
        spark, path = _written.pop()
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session may have ended: its folder goes with the cluster's own clean-up
            pass


atexit.register(release)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores is dealt out again; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns (doc_id and text if none are named); others, whatever their names, don't matter."""
    return docs.select(*[F.col(f"`{c}`") for c in columns or ("doc_id", "text")])


def unused(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def bounded(sample: DataFrame, most: int) -> DataFrame:
    """A sample that was drawn by a hash of its rows, `most` rows in expectation; equal rows come all or none, so
    if it is counted at over twice that, single rows are drawn of it."""
    n = sample.count()
    return sample if n <= 2 * most else sample.filter(F.rand(7) < most / n)


def portions(batches, rows: int = 1_000):
    """Batches in parts of so many rows, so that few texts are Python strings at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


#: Rows of a side that is broadcast; past them small_join() salts instead.
SMALL_ROWS = 100_000


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", limit: int = SMALL_ROWS, salts: int = 64) -> DataFrame:
    """left join right, which has a row for each key: broadcast if its counted rows are within limit,
    else each of its rows is repeated under every salt, so that a hot key of left spreads over tasks."""
    if right.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(right), on, how)
    salt = "__salt"
    own = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])  # of the row: a task that runs again deals rows alike
    a = left.withColumn(salt, F.pmod(own, F.lit(salts)).cast("int"))
    b = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, salt], how).drop(salt)


class Sieve:
    """A bitmap of bounded size that tells 64-bit hashes that may be in a set from those that aren't."""

    #: Bits, at most: 32 MB.
    MOST = 28
    PARTS = 64

    def __init__(self, parts: dict[int, bytes], order: int):
        self.order = order
        size = (1 << order) // 8 // self.PARTS
        self.bits = np.frombuffer(b"".join(parts.get(k, bytes(size)) for k in range(self.PARTS)), np.uint8)

    @classmethod
    def of(cls, hashes: DataFrame, n: int) -> Sieve:
        """Of a column h of n hashes: bits for each, up to the bound. Tasks make the bitmap's parts."""
        order = min(cls.MOST, max(16, (16 * n).bit_length()))
        part_bits = (1 << order) // cls.PARTS

        def run(table):
            at = table.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - order)
            on = np.zeros(part_bits, bool)
            on[(at % np.uint64(part_bits)).astype(np.int64)] = True
            part = int(at[0]) // part_bits
            return pa.Table.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

        parts = hashes.withColumn("part", F.shiftrightunsigned("h", 64 - cls.PARTS.bit_length() + 1)).groupBy("part").applyInArrow(run, "part int, bits binary")
        return cls({r["part"]: bytes(r["bits"]) for r in parts.collect()}, order)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.order)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
