"""Command line: registers model clouds in scene clouds of PLY files.

    python -m quillstone.cli --tau_d 0.05 --scene_files a.ply,b.ply --model_files m.ply
"""

from __future__ import annotations

import argparse
import math
import sys
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.rigid import NAMES
from .functions.text import split_list
from .operators import poses
from .operators.tables import stored
from .plans.registration import Options, model_steps, register
from .sources import ply, sink, texts

# Levels of the log, and Spark's names for them.
LEVELS = {"trace": "TRACE", "debug": "DEBUG", "info": "INFO", "warning": "WARN", "error": "ERROR", "fatal": "FATAL"}


def _flag(x: str) -> bool:
    return x.lower() in ("1", "true", "yes")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="estimates the pose of each model in each scene")
    p.add_argument("--tau_d", type=split_list, required=True, help="for each model, the distance step as a part of its extent")
    p.add_argument("--scene_files", type=split_list, required=True)
    p.add_argument("--model_files", type=split_list, required=True)
    p.add_argument("--validation_files", type=split_list, default=[], help="true poses, scene by scene")
    p.add_argument("--scene_leaf_size", type=float, default=10.0)
    p.add_argument("--ref_point_df", type=int, default=1)
    p.add_argument("--vote_count_threshold", type=float, default=0.4)
    p.add_argument("--cpu_clustering", type=_flag, default=False, help="clusters by falling votes")
    p.add_argument("--use_l1_norm", type=_flag, default=False)
    p.add_argument("--use_averaged_clusters", type=_flag, default=False)
    p.add_argument("--validation_translation_threshold", type=float, default=0.1)
    p.add_argument("--validation_rotation_threshold", type=float, default=12.0)
    p.add_argument("--logfile", help="a file that lines with their time are added to")
    p.add_argument("--loglevel", choices=LEVELS, default="info")
    for name, kind in (("dev", int), ("show_normals", _flag), ("visualize", _flag)):
        p.add_argument(f"--{name}", type=kind, help="accepted without an effect: there is no device and no viewer")
    return p


class _Log:
    """Lines of at least a level, on stderr or in a file; evaluation reads them (sources.texts.parse_log)."""

    def __init__(self, path: str | None, level: str):
        self.path, self.least = path, list(LEVELS).index(level)

    def __call__(self, line: str, level: str = "info") -> None:
        if list(LEVELS).index(level) < self.least:
            return
        line = f"[{datetime.now():%Y-%m-%d %H:%M:%S.%f}]: {line}"
        if self.path:
            with open(self.path, "a") as f:
                f.write(line + "\n")
        else:
            print(line, file=sys.stderr)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    log = _Log(a.logfile, a.loglevel)
    if len(a.tau_d) != len(a.model_files):
        log("each model needs a tau_d of its own", "error")
        raise SystemExit(1)
    if a.validation_files and len(a.validation_files) != len(a.scene_files) * len(a.model_files):
        log("each scene and model needs a validation file", "error")
        raise SystemExit(1)
    log(" ".join(args or sys.argv[1:]))
    spark = SparkSession.builder.appName("registration").getOrCreate()
    spark.sparkContext.setLogLevel("WARN" if LEVELS[a.loglevel] == "INFO" else LEVELS[a.loglevel])
    scenes, models = (_clouds(spark, files) for files in (a.scene_files, a.model_files))
    taus = {_name(f): float(x) for f, x in zip(a.model_files, a.tau_d)}
    options = Options(taus, a.scene_leaf_size, True, a.ref_point_df, a.vote_count_threshold, greedy=a.cpu_clustering, any_distance=a.use_l1_norm, averaged=a.use_averaged_clusters)
    found = register(scenes, models, options)
    if a.validation_files:
        found = stored(found)
    _print(found)
    if a.validation_files:
        pairs = [(s, m) for s in a.scene_files for m in a.model_files]
        truth = _truth(spark, pairs, a.validation_files)
        steps = model_steps(models, taus)
        rows = poses.validated(poses.compared(found, truth), steps, a.validation_translation_threshold, a.validation_rotation_threshold)
        _print(rows)
        _tell(log, pairs, found, rows.join(steps.select("model_id", "diam"), "model_id", "left"), a)


def _tell(log: _Log, pairs: list[tuple[str, str]], found: DataFrame, rows: DataFrame, a: argparse.Namespace) -> None:
    """The log of a validation; as many rows as there are validation files come to the driver."""
    known = {(r["scene_id"], r["model_id"]): r for r in rows.collect()}
    estimates = {(r["scene_id"], r["model_id"]): r for r in found.collect()}
    for s, m in pairs:
        key = _name(s), _name(m)
        log(f"Transformations for {m} in {s}:")
        if key in estimates:
            log("Estimated transformation: " + " ".join(f"{estimates[key][n]:f}" for n in NAMES))
        r = known[key]
        far = [math.nan if r[c] is None else r[c] for c in ("trans_err", "rot_err")]
        log("Distance (trans, rot): {:f}, {:f}".format(*far))
        log(f"Threshold (trans, rot): {a.validation_translation_threshold * (r['diam'] or 0):f}, {math.radians(a.validation_rotation_threshold):f}")
        log(f"Match: {int(r['match'])}")


def _print(rows: DataFrame) -> None:
    """All rows, separated by tabs under their names; a partition at a time comes to the driver."""
    print(*rows.columns, sep="\t")
    for r in rows.toLocalIterator():
        print(*r, sep="\t")


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".ply")


def _clouds(spark: SparkSession, files: list[str]) -> DataFrame:
    return ply.read_cloud(spark, files)


def _truth(spark: SparkSession, pairs: list[tuple[str, str]], files: list[str]) -> DataFrame:
    """scene_id, model_id, t11 ... of the validation files, all read at once; a file may stand for several pairs."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    whole = [fs.makeQualified(where).toString() for fs, where in (sink.hadoop(spark, f) for f in files)]
    names = spark.createDataFrame([(f, _name(s), _name(m)) for f, (s, m) in zip(whole, pairs)], "file string, scene_id string, model_id string")
    rows = texts.read_matrices(spark, sorted(set(files))).withColumn("file", plain("file"))
    return rows.join(names.withColumn("file", plain("file")), "file").drop("file")


if __name__ == "__main__":
    main()
