"""Work from files to files: normals of meshes, clouds of meshes, voxel grids, evaluation.

    python -m quillstone.plans.files voxel in.ply out.ply
    python -m quillstone.plans.files normals in.ply out.ply 10 20 30
    python -m quillstone.plans.files cloud in.ply out.ply 5 --centered
    python -m quillstone.plans.files evaluate occlusion.txt logs/
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clouds, evaluation, meshes
from ..operators.tables import stored
from ..sources import ply, texts


def mesh_cloud(spark: SparkSession, path: str) -> DataFrame:
    """The vertices of a mesh file as a cloud, with normals made of its faces; vertices of no face have nulls."""
    vertices = ply.read_cloud(spark, path).drop(*clouds.NORMAL)
    normals = meshes.vertex_normals(meshes.fan_triangles(ply.read_faces(spark, path)), vertices)
    return vertices.join(normals, ["cloud_id", "pt_id"], "left")


def _write(rows: DataFrame, path: str) -> None:
    """Normals that there aren't are written as 0."""
    ply.write({"vertex": rows.select("pt_id", *clouds.FIELDS).fillna(0.0, list(clouds.NORMAL))}, path, "ascii", order={"vertex": "pt_id"})


def write_normals(spark: SparkSession, source: str, to: str, shift: tuple[float, float, float]) -> DataFrame:
    """A mesh's vertices, moved by shift, and their normals, in an ascii file; shift goes into a file beside it.
    Returns the rows that were written."""
    rows = mesh_cloud(spark, source).withColumns({a: F.col(a) + F.lit(float(d)) for a, d in zip(clouds.POINT, shift)})
    rows = stored(rows)
    _write(rows, to)
    texts.write_shift(spark.range(1).select(*[F.lit(float(d)).alias(n) for n, d in zip(("tx", "ty", "tz"), shift)]), f"{to}.trans_adj")
    return rows


def write_cloud(spark: SparkSession, source: str, step: int, to: str, centered: bool = False) -> DataFrame:
    """Every step-th vertex of a mesh, from the first, with the normals of the whole mesh, in an ascii file.
    centered: moved so that the whole mesh's centroid is the origin. Returns the rows that were written."""
    rows = mesh_cloud(spark, source)
    if centered:
        rows = clouds.centered(rows)
    rows = stored(clouds.every_nth(rows, step))
    _write(rows, to)
    return rows


def voxel_grid(points: DataFrame, leaf: float = 0.01) -> DataFrame:
    """The mean of every column but file and row over the points of each cell of x, y, z, in the order of cells.
    Integers are rounded down. Points that aren't finite go."""
    fields = [f for f in points.schema if f.name not in ("file", "row")]
    if any(isinstance(f.dataType, T.ArrayType) for f in fields):
        raise ValueError("a voxel grid has no mean of lists")
    names = [f.name for f in fields]
    out = clouds.voxel_downsample(points, leaf, (), clouds.POINT, tuple(names))
    whole = {f.name: F.floor(f.name).cast(f.dataType) if isinstance(f.dataType, T.IntegralType) else F.col(f.name).cast(f.dataType) for f in fields}
    return out.withColumns(whole).select("c0", "c1", "c2", *names)


def thin_file(spark: SparkSession, source: str, to: str, leaf: float = 0.01) -> tuple[int, int]:
    """Writes the voxel grid of a file's points, with all their columns, as an ascii file. Returns the counts
    before and after."""
    points = ply.read(spark, source, ply.VERTEX_NAMES)
    thinned = stored(voxel_grid(points, leaf).withColumn("__at", F.struct("c2", "c1", "c0")).drop("c0", "c1", "c2"))
    ply.write({"vertex": thinned}, to, "ascii", order={"vertex": "__at"})
    return points.count(), thinned.count()


def flagged(spark: SparkSession, occlusion: str, logs: str) -> DataFrame:
    """scene_num, model, occlusion, trans, rot, norm_dist, rot_folded, match: the pairs of an occlusion table that the logs have a
    distance for."""
    rows = evaluation.joined(texts.read_occlusion(spark, occlusion), texts.read_logs(spark, logs)).filter("trans IS NOT NULL AND rot IS NOT NULL")
    return evaluation.flagged(rows, evaluation.diameters(spark))


def evaluated(spark: SparkSession, occlusion: str, logs: str) -> DataFrame:
    """flagged() with rate, the rate of matches up to each pair, by rising occlusion."""
    return evaluation.running_rate(flagged(spark, occlusion, logs), ["occlusion", "scene_num", "model"])


def report(rows: DataFrame) -> DataFrame:
    """One row: n, match_rate, and mean_ and median_ of norm_dist and rot_folded; rows: as flagged() gives them (of the rate, which
    needs a sort of all, nothing is reported)."""
    rows = stored(rows.select("match", "norm_dist", "rot_folded"))  # files are read once, not for each figure
    sums = rows.agg(F.count("*").alias("n"), F.avg(F.col("match").cast("int")).alias("match_rate"))
    return sums.crossJoin(evaluation.error_summary(rows, ["norm_dist", "rot_folded"]))  # one row each


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="prepares clouds and evaluates logs")
    does = p.add_subparsers(dest="what", required=True)
    a = does.add_parser("voxel")
    a.add_argument("source")
    a.add_argument("to")
    a.add_argument("--leaf", type=float, default=0.01)
    a = does.add_parser("normals")
    a.add_argument("source")
    a.add_argument("to")
    a.add_argument("shift", type=float, nargs=3)
    a = does.add_parser("cloud")
    a.add_argument("source")
    a.add_argument("to")
    a.add_argument("step", type=int)
    a.add_argument("--centered", action="store_true")
    a = does.add_parser("evaluate")
    a.add_argument("occlusion")
    a.add_argument("logs")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("files").getOrCreate()
    if a.what == "voxel":
        fields = " ".join(c for c in ply.read(spark, a.source, ply.VERTEX_NAMES).columns if c not in ("file", "row"))
        before, after = thin_file(spark, a.source, a.to, a.leaf)
        for when, n in (("before", before), ("after", after)):
            print(f"points {when} filtering: {n} ({fields})", file=sys.stderr)
    elif a.what == "normals":
        write_normals(spark, a.source, a.to, tuple(a.shift))
    elif a.what == "cloud":
        write_cloud(spark, a.source, a.step, a.to, a.centered)
    else:
        rows = report(flagged(spark, a.occlusion, a.logs))
        print(*rows.columns, sep="\t")
        for r in rows.collect():  # one row
            print(*r, sep="\t")


if __name__ == "__main__":
    main()

