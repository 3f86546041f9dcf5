"""KITTI-layout drives: binary scans and labels, calibration and pose text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import kitti_class, kitti_moving, row_fixed


def _records(files: DataFrame, kind: str, width: int, names: list[str], schema: str) -> DataFrame:
    def run(batches):
        for b in batches:  # Spark bounds a batch's bytes, so few whole scans stand in one
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = np.frombuffer(content.as_buffer(), kind).reshape(-1, width)
                scan = int(path.rsplit("/", 1)[1].split(".")[0])
                for at in range(0, len(raw), 1 << 17):
                    part = raw[at : at + (1 << 17)]
                    cols = [pa.array(np.full(len(part), scan, np.int32)), pa.array(np.arange(at, at + len(part)))]
                    yield pa.RecordBatch.from_arrays([*cols, *[pa.array(np.ascontiguousarray(part[:, k]).astype(np.int64 if part.dtype.kind == "u" else part.dtype)) for k in range(width)]], ["frame", "pid", *names])

    return files.select("path", "content").mapInArrow(run, schema)


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def read_scans(spark: SparkSession, folder: str) -> DataFrame:
    return _records(_files(spark, folder, "*.bin"), "<f4", 4, ["x", "y", "z", "inten"], "frame int, pid long, x float, y float, z float, inten float")


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    raw = _records(_files(spark, folder, "*.label"), "<u4", 1, ["raw"], "frame int, pid long, raw long")
    return raw.select("frame", "pid", kitti_class(F.col("raw")).alias("label"), kitti_moving(F.col("raw")).alias("moving"))


# The sensor's height and image, and the sequences of each split.
HEIGHT, ROWS, FOV = 1.73, 64, (2.0, -24.9)
SPLITS = {"train": ("00", "01", "02", "03", "04", "05", "06", "07", "09", "10"), "val": ("08",)}


def sequence_dir(root: str, seq: str) -> str:
    return f"{root.rstrip('/')}/dataset/sequences/{seq}"


def scan_path(root: str, seq: str, scan: int, labels: bool = False) -> str:
    return f"{sequence_dir(root, seq)}/{'labels' if labels else 'velodyne'}/{scan:06d}.{'label' if labels else 'bin'}"


def frames(spark: SparkSession, folder: str, remove_close: float = 1.0, scans: DataFrame | None = None) -> DataFrame:
    """Points with labels, in the sensor's frame; -1 and not moving without a label file; intensity clipped to [0, 1]; moving only for vehicles and persons.

    scans(frame) restricts them to some scans."""
    p = read_scans(spark, f"{folder}/velodyne").filter(F.hypot("x", "y") > remove_close)
    if scans is not None:
        p = p.join(scans.select(F.col("frame").cast("int").alias("frame")), "frame", "left_semi")
    j = p.join(read_labels(spark, f"{folder}/labels"), ["frame", "pid"], "left")
    return j.select("frame", "pid", "x", "y", "z", F.least(F.greatest("inten", F.lit(0.0)), F.lit(1.0)).alias("inten"), F.coalesce("label", F.lit(-1)).alias("label"), (F.coalesce("moving", F.lit(False)) & F.col("label").isin(7, 8)).alias("moving"))


def drive_frames(spark: SparkSession, folder: str, stride: int = 1, start: int = 0, lags: tuple[int, ...] = (1, 2), seq: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, frames, selected) of a sequence folder.

    points: the selected scans and the earlier ones that their motion cue needs, in the ego frame
    (the sensor's, lowered to the ground), with the image row of their elevation as ring; frames: each
    scan's ego pose and place; selected: the scans that are frames (the others serve rangeimage.features())."""
    poses = ego_poses(read_poses(spark, f"{folder}/poses.txt"), read_calib(spark, f"{folder}/calib.txt"))
    chosen = poses.select("frame").filter((F.col("frame") >= start) & ((F.col("frame") - start) % stride == 0))
    need = chosen.select(F.explode(F.array(F.col("frame"), *[F.col("frame") - k for k in lags])).alias("frame")).filter("frame >= 0").distinct()
    pts = frames(spark, folder, scans=need)
    elev = F.degrees(F.atan2("z", F.hypot("x", "y")))
    pts = pts.withColumn("ring", row_fixed(elev, *FOV, ROWS).cast("smallint")).withColumn("z", (F.col("z") + HEIGHT).cast("float"))
    info = poses.select("frame", "pose", F.col("pose")[3].alias("ex"), F.col("pose")[7].alias("ey"), F.array(F.lit(0.0), F.lit(0.0), F.lit(HEIGHT)).alias("sensor"))
    if seq is not None:
        pts, info, chosen = (d.withColumn("seq", F.lit(seq)) for d in (pts, info, chosen))
    return pts, info, chosen


def selected_scans(spark: SparkSession, count: int, stride: int, start: int = 0) -> DataFrame:
    return spark.range(start, count, stride).select(F.col("id").cast("int").alias("frame"))


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """One row a line of 12 numbers: row and the 4x4 matrix, row-major.  Pose files are small: a line a scan."""
    lines = spark.read.text(path, wholetext=True)
    rows = lines.select(F.posexplode(F.split(F.trim("value"), "\n")).alias("frame", "line"))
    rows = rows.filter(F.trim("line") != "")  # files end with a line end
    m = F.transform(F.split(F.trim("line"), r"\s+"), lambda v: v.cast("double"))
    return rows.select("frame", F.concat(m, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("pose"))


def read_calib(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).filter(F.col("value").startswith("Tr"))
    m = F.transform(F.slice(F.split(F.trim("value"), r"\s+"), 2, 12), lambda v: v.cast("double"))
    return lines.select(F.concat(m, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("tr"))


def ego_poses(poses: DataFrame, calib: DataFrame, height: float = 1.73) -> DataFrame:
    """Camera poses to ego poses: up @ inv(Tr) @ P @ Tr @ inv(up), up lifting the frame by the sensor's height."""
    tr = np.array(calib.first()["tr"]).reshape(4, 4)
    up = np.eye(4)
    up[2, 3] = height
    left, right = up @ np.linalg.inv(tr), tr @ np.linalg.inv(up)

    def row(i, j):  # element of left @ P @ right, as one expression
        return sum((F.col("pose")[4 * a + b] * float(left[i, a] * right[b, j]) for a in range(4) for b in range(4)), F.lit(0.0))

    return poses.select("frame", F.array(*[row(i, j) for i in range(4) for j in range(4)]).alias("pose"))


def needed_scans(spark: SparkSession, start: int, count: int, stride: int, lags: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Selected scans and the earlier ones that their motion cue needs."""
    s = spark.range(start, count, stride).withColumnRenamed("id", "frame")
    return s.select(F.explode(F.array(F.col("frame"), *[F.col("frame") - k for k in lags])).alias("frame")).filter("frame >= 0").distinct()
