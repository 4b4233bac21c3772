"""A stored index of models: their point pairs by bin, made once and probed by any number of scenes.

A folder holds the header (a row for each model: its step, extent and counts), the models' points, the bins with many
pairs, and the pairs as a table that is bucketed and sorted by what pairs meet by. A probe for candidates shuffles scene pairs
alone; votes shuffle scene points and the index's pairs, packed where they are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, voting
from ..operators.joins import lookup
from .registration import MEET, Options, answers, model_cells, model_steps, same_bin, scene_cells, step_classes, stored_bins

#: Columns by which the table of pairs is bucketed.
BUCKETED = [*MEET, "piece"]


@dataclass
class ModelIndex:
    header: DataFrame  # model_id, d_dist, diam, points, pairs, bins, buckets
    points: DataFrame  # the models, as clouds
    heavy: DataFrame  # MEET, pieces: bins whose pairs are cut into pieces
    pairs: DataFrame  # model_id, r, i, a, d_dist, k1, BUCKETED

    @property
    def steps(self) -> DataFrame:
        return self.header.select("model_id", "d_dist", "diam")


def build(models: DataFrame, path: str, tau: float | dict = 0.05, buckets: int | None = None, most: int = voting.BIN_ROWS) -> ModelIndex:
    """Writes the index of models (clouds) to a new folder and opens it. Cells of more than `most` pairs are cut into
    pieces, so that no bucket holds one whole. buckets: as many as shuffle partitions unless given."""
    spark = models.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    models.write.parquet(f"{path}/points")
    points = spark.read.parquet(f"{path}/points")
    steps = model_steps(points, tau)
    cells = model_cells(points, steps, step_classes(steps), stored_bins)
    cells.groupBy(*MEET).agg(F.ceil(F.count("*") / most).cast("int").alias("pieces")).filter("pieces > 1").write.parquet(f"{path}/heavy")
    heavy = spark.read.parquet(f"{path}/heavy")
    rows = lookup(cells, heavy, MEET, "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("r", "i"), F.col("pieces")).cast("int"), F.lit(0)))
    rows = rows.select("model_id", "r", "i", "a", "d_dist", "k1", *BUCKETED)
    dealt = rows.repartition(buckets, *BUCKETED)  # a bucket is one file
    dealt.write.bucketBy(buckets, *BUCKETED).sortBy(*BUCKETED).format("parquet").option("path", f"{path}/pairs").saveAsTable(_name(path))
    stepped = lookup(points, steps.filter("d_dist > 0").select(F.col("model_id").alias("cloud_id"), "d_dist"), ["cloud_id"])
    counts = blocks.bin_counts(stepped)  # pairs are made again, as a count of the table's would have to shuffle them
    bins = counts.groupBy(F.col("cloud_id").alias("model_id")).agg(F.sum("cnt").alias("pairs"), F.count("*").alias("bins"))
    sizes = points.groupBy(F.col("cloud_id").alias("model_id")).agg(F.count("*").alias("points"))
    header = lookup(lookup(steps, sizes, ["model_id"], "left"), bins, ["model_id"], "left")
    header.fillna(0, ["pairs", "bins"]).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/header")
    return open_index(spark, path)


def _name(path: str) -> str:
    return "quillstone_" + hashlib.md5(path.encode()).hexdigest()


def open_index(spark: SparkSession, path: str) -> ModelIndex:
    """An index that is there, in this session or another."""
    header = spark.read.parquet(f"{path}/header")
    if not spark.catalog.tableExists(_name(path)):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/pairs").schema)
        by = ", ".join(BUCKETED)
        n = header.agg(F.max("buckets")).first()[0] or 1
        spark.sql(f"CREATE TABLE {_name(path)} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS LOCATION '{path}/pairs'")
    return ModelIndex(header, spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/heavy"), spark.table(_name(path)))


def probe(index: ModelIndex, scenes: DataFrame, ref_factor: int = 1, exact: bool = False) -> DataFrame:
    """Candidates of scenes (clouds) for the models of an index, as voting.candidates() gives them. No pair of a model
    is made; a scene pair in a bin that is cut meets each piece."""
    i = (lambda p: [F.col("i").alias(f"{p}_i")]) if exact else (lambda p: [])
    s = lookup(scene_cells(scenes, step_classes(index.steps), ref_factor, blocks.features_of), index.heavy, MEET, "left")
    s = s.withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
    s = s.select("scene_id", F.col("r").alias("s_r"), F.col("a").alias("s_a"), "f1", *i("s"), *BUCKETED)
    m = index.pairs.select("model_id", F.col("r").alias("m_r"), F.col("a").alias("m_a"), "d_dist", "k1", *i("m"), *BUCKETED)
    return voting.met_candidates(s.join(m, BUCKETED).filter(same_bin()), exact)


def votes(index: ModelIndex, scenes: DataFrame, ref_factor: int = 1, threshold: float = 0.0) -> DataFrame:
    """Votes of scenes (clouds) for the models of an index, as registration.found_votes() gives them: the index's pairs are read and
    meet the scenes' in the tasks that make these, so that neither scene pairs nor candidates are rows."""
    out = blocks.votes_of_pairs(scenes, index.pairs, index.header, ref_factor, threshold)
    return out.withColumn("vote_code", voting.pack_vote(F.col("s_r"), F.col("m_r"), F.col("alpha")))


def register(index: ModelIndex, scenes: DataFrame, options: Options = Options(), weights: DataFrame | None = None) -> DataFrame:
    """registration.register() of scenes with the models of an index (its tau, and models as they were given)."""
    found = votes(index, scenes, options.ref_factor, options.vote_threshold)
    return answers(found, scenes, index.points, index.steps, options, weights)
