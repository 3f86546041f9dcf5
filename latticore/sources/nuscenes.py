"""nuScenes-layout tables: JSON readers and the joins between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import class_of_name, quaternion, rigid

# The dataset's tables, the attributes of what moves, the small splits, and the label classes in the order of their index.
TABLES = ("scene", "sample", "sample_data", "calibrated_sensor", "sensor", "ego_pose", "category", "attribute", "instance", "sample_annotation", "lidarseg")
MOVING = ("vehicle.moving", "pedestrian.moving", "cycle.with_rider")

SPLITS = {
    "mini_train": ("scene-0061", "scene-0553", "scene-0655", "scene-0757", "scene-0796", "scene-1077", "scene-1094", "scene-1100"),
    "mini_val": ("scene-0103", "scene-0916"),
}
LABELS = (
    "noise", "animal", "human.pedestrian.adult", "human.pedestrian.child", "human.pedestrian.construction_worker",
    "human.pedestrian.personal_mobility", "human.pedestrian.police_officer", "human.pedestrian.stroller", "human.pedestrian.wheelchair",
    "movable_object.barrier", "movable_object.debris", "movable_object.pushable_pullable", "movable_object.trafficcone",
    "static_object.bicycle_rack", "vehicle.bicycle", "vehicle.bus.bendy", "vehicle.bus.rigid", "vehicle.car", "vehicle.construction",
    "vehicle.emergency.ambulance", "vehicle.emergency.police", "vehicle.motorcycle", "vehicle.trailer", "vehicle.truck",
    "flat.driveable_surface", "flat.other", "flat.sidewalk", "flat.terrain", "static.manmade", "static.other", "static.vegetation", "vehicle.ego",
)


def load(spark: SparkSession, root: str, version: str, optional: tuple[str, ...] = ("lidarseg", "category", "attribute")) -> dict[str, DataFrame]:
    out = {}
    for t in TABLES:
        try:
            out[t] = spark.read.option("multiLine", True).json(f"{root}/{version}/{t}.json")
        except Exception as e:
            if t not in optional or "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def lidar_frames(t: dict[str, DataFrame], channel: str = "LIDAR_TOP") -> DataFrame:
    """Sensor records of the channel with ego pose and calibration, as 4x4 arrays."""
    def pose(df: DataFrame, name: str) -> DataFrame:
        q = [F.col("rotation")[k] for k in range(4)]
        r = quaternion(*q)
        m = [x for k in range(3) for x in (*r[3 * k : 3 * k + 3], F.col("translation")[k])]
        return df.withColumn(name, F.array(*m, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))

    cal = pose(t["calibrated_sensor"], "calib").join(t["sensor"].filter(F.col("channel") == channel).select(F.col("token").alias("sensor_token")), "sensor_token")
    ego = pose(t["ego_pose"], "pose").select(F.col("token").alias("ego_pose_token"), "pose")
    sd = t["sample_data"].join(cal.select(F.col("token").alias("calibrated_sensor_token"), "calib"), "calibrated_sensor_token")
    return sd.join(ego, "ego_pose_token")


def keyframe_chain(samples: DataFrame) -> DataFrame:
    """Samples of each scene with their place in it; links follow time, so the place is a row number."""
    w = Window.partitionBy("scene_token").orderBy("timestamp", "token")
    return samples.withColumn("place", F.row_number().over(w) - 1).withColumn("back1", F.lag("token", 1).over(w)).withColumn("back2", F.lag("token", 2).over(w))


def speeds(ann: DataFrame) -> DataFrame:
    """ann(token, prev, next, timestamp in microseconds, translation) with `speed` in the plane, in m/s, from the annotations
    before and after (its own place where one lacks); null where both lack or no time passes."""
    side = lambda p: ann.select(F.col("token").alias(p), F.col("translation").alias(f"_{p}_at"), F.col("timestamp").alias(f"_{p}_ts"))
    a = ann.join(side("prev"), "prev", "left").join(side("next"), "next", "left")
    p0, t0 = F.coalesce("_prev_at", "translation"), F.coalesce("_prev_ts", "timestamp")
    p1, t1 = F.coalesce("_next_at", "translation"), F.coalesce("_next_ts", "timestamp")
    dt, dx, dy = (t1 - t0) / 1e6, p1[0] - p0[0], p1[1] - p0[1]
    return a.select(*ann.columns, F.when(dt > 0, F.sqrt(dx * dx + dy * dy) / F.nullif(dt, F.lit(0.0))).alias("speed"))


def annotations(t: dict[str, DataFrame]) -> DataFrame:
    """Annotations with class, velocity (null where no neighbour or no time passed) and moving flag.

    Without a category or attribute table the class is null and only speed tells what moves."""
    when = t["sample"].select(F.col("token").alias("sample_token"), "timestamp")
    a = speeds(t["sample_annotation"].join(when, "sample_token"))
    if "category" in t:
        cat = t["instance"].join(t["category"].select(F.col("token").alias("category_token"), F.col("name").alias("category")), "category_token").select(F.col("token").alias("instance_token"), "category")
        a = a.join(cat, "instance_token", "left").withColumn("cls", class_of_name(F.col("category")))
    else:
        a = a.withColumn("cls", F.lit(None).cast("int"))
    if "attribute" in t:
        names = t["attribute"].filter(F.col("name").isin(*MOVING)).select(F.col("token").alias("attr"))
        flagged = a.select("token", F.explode("attribute_tokens").alias("attr")).join(names, "attr", "left_semi").select("token").distinct().withColumn("flag", F.lit(True))
        a = a.join(flagged, "token", "left")
    else:
        a = a.withColumn("flag", F.lit(None).cast("boolean"))
    return a.withColumn("moving", F.coalesce("flag", F.col("speed") > 0.5, F.lit(False)))


def points_in_boxes(points: DataFrame, boxes: DataFrame, tolerance: float = 0.1, cell: float = 8.0) -> DataFrame:
    """points(frame, pid, wx, wy, z) inside boxes(frame, box, bx, by, bz, length, width, height, yaw): (frame, pid, box).

    An equi-join on a lattice of `cell` metres that the boxes' bounding circles are dealt over; the
    three exact tests follow, so no point meets a box that is not near."""
    r = F.sqrt(F.col("length") ** 2 + F.col("width") ** 2) / 2 + tolerance
    span = lambda c: F.sequence(F.floor((F.col(c) - r) / cell), F.floor((F.col(c) + r) / cell))
    b = boxes.withColumn("_i", F.explode(span("bx"))).withColumn("_j", F.explode(span("by")))
    p = points.withColumn("_i", F.floor(F.col("wx") / cell)).withColumn("_j", F.floor(F.col("wy") / cell))
    dx, dy = F.col("wx") - F.col("bx"), F.col("wy") - F.col("by")
    u, v = dx * F.cos("yaw") + dy * F.sin("yaw"), dy * F.cos("yaw") - dx * F.sin("yaw")
    hit = (F.abs(u) <= F.col("length") / 2 + tolerance) & (F.abs(v) <= F.col("width") / 2 + tolerance) & (F.abs(F.col("z") - F.col("bz")) <= F.col("height") / 2 + tolerance)
    return p.join(b, ["frame", "_i", "_j"]).filter(hit).select("frame", "pid", "box")


def scene_names(t: dict[str, DataFrame], split: str | None = None, splits: DataFrame | None = None) -> DataFrame:
    """(name) of all scenes, or of a split: one of the small ones, or of the table splits(split, name)."""
    names = t["scene"].select("name")
    if split is None:
        return names
    if splits is not None:
        return names.join(splits.filter(F.col("split") == split), "name", "left_semi")
    if split not in SPLITS:
        raise ValueError(f"split {split} needs a table of splits(split, name)")
    return names.filter(F.col("name").isin(*SPLITS[split]))


def walk(links: DataFrame, first: DataFrame, most: int = 10_000) -> DataFrame:
    """(scene_token, token, place): the linked list links(token, next) from first(scene_token, token), by recursion.

    Exact where links do not follow time; keyframe_chain() needs no recursion where they do.  An empty next ends a list."""
    spark = links.sparkSession
    links.select("token", "next").createOrReplaceTempView("_links")
    first.select("scene_token", "token").createOrReplaceTempView("_first")
    return spark.sql(f"""
        WITH RECURSIVE chain (scene_token, token, place) MAX RECURSION LEVEL {most} AS (
          SELECT scene_token, token, 0 FROM _first
          UNION ALL
          SELECT c.scene_token, l.next, c.place + 1 FROM chain c JOIN _links l ON l.token = c.token WHERE l.next <> '' AND l.next IS NOT NULL)
        SELECT * FROM chain""")


def steps_back(records: DataFrame, steps: tuple[int, ...] = (2, 4)) -> DataFrame:
    """records(token, prev) -> (token, step, back): the record so many links before, where there is one.  One join a link."""
    link = records.select(F.col("token").alias("_t"), F.nullif(F.col("prev"), F.lit("")).alias("_p"))
    now, out = records.select("token", F.nullif(F.col("prev"), F.lit("")).alias("back")), None
    for k in range(1, max(steps) + 1):
        if k > 1:
            now = now.join(link, F.col("back") == F.col("_t")).select("token", F.col("_p").alias("back"))
        now = now.filter("back is not null")
        if k in steps:
            part = now.select("token", F.lit(k).alias("step"), "back")
            out = part if out is None else out.union(part)
    return out


def _records(files: DataFrame, root: str, kind: str, width: int, names: list[str], schema: str) -> DataFrame:
    """files(token, filename) -> (token, pid, names): each record of each file, opened by the task that takes it."""

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for token, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, path = fs.FileSystem.from_uri(f"{root.rstrip('/')}/{name}")
                with system.open_input_file(path) as f:
                    raw = np.frombuffer(f.read(), kind).reshape(-1, width)
                for at in range(0, len(raw), 1 << 17):
                    part = raw[at : at + (1 << 17)]
                    cols = [pa.array(np.ascontiguousarray(part[:, k]).astype(np.int32 if part.dtype.kind == "u" else part.dtype)) for k in range(width)]
                    yield pa.RecordBatch.from_arrays([pa.array([token] * len(part), pa.string()), pa.array(np.arange(at, at + len(part))), *cols], ["token", "pid", *names])

    return files.select("token", "filename").mapInArrow(run, f"token string, pid long, {schema}")


def read_points(files: DataFrame, root: str) -> DataFrame:
    """Sweeps: five floats a point; ring is the laser's id."""
    return _records(files, root, "<f4", 5, ["x", "y", "z", "inten", "laser"], "x float, y float, z float, inten float, laser float").withColumn("laser", F.col("laser").cast("int"))


def read_labels(files: DataFrame, root: str, categories: DataFrame | None = None) -> DataFrame:
    """(token, pid, label) of label files: a byte a point, the category's index; of categories without an index, the fixed order."""
    raw = _records(files, root, "<u1", 1, ["raw"], "raw int")
    if categories is not None and "index" in categories.columns:
        of = categories.select(F.col("index").cast("int").alias("raw"), class_of_name(F.col("name")).alias("label"))
        return raw.join(of, "raw", "left").select("token", "pid", F.coalesce("label", F.lit(-1)).alias("label"))
    names = F.array(*[F.lit(n) for n in LABELS])
    return raw.select("token", "pid", F.coalesce(class_of_name(F.get(names, F.col("raw"))), F.lit(-1)).alias("label"))


def laser_rows(points: DataFrame, rows: int) -> DataFrame:
    """(token, laser, ring): image row of each laser by falling mean elevation in the sensor's frame; lasers without points come last."""
    e = points.groupBy("token", "laser").agg(F.avg(F.degrees(F.atan2("z", F.hypot("x", "y")))).alias("elev"))
    every = points.select("token").distinct().select("token", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("laser")).join(e, ["token", "laser"], "left")
    w = Window.partitionBy("token").orderBy(F.desc(F.coalesce("elev", F.lit(-90.0) + F.col("laser") * 1e-3)), "laser")
    return every.select("token", "laser", (F.row_number().over(w) - 1).alias("ring"))


def ring_count(t: dict[str, DataFrame], root: str, channel: str = "LIDAR_TOP") -> int:
    """Number of lasers, from the first keyframe."""
    first = lidar_frames(t, channel).filter("is_key_frame").orderBy("timestamp", "token").limit(1)
    return int(read_points(first, root).agg(F.max("laser")).first()[0]) + 1


def _times(a: str, b: str):
    """Product of two 4x4 matrices (row-major arrays) in columns a and b."""
    x, y = F.col(a), F.col(b)
    return F.array(*[sum((x[4 * i + k] * y[4 * k + j] for k in range(1, 4)), x[4 * i] * y[j]) for i in range(4) for j in range(4)])


def moving_points(points: DataFrame, annotations_: DataFrame) -> DataFrame:
    """(frame, pid) of points(frame, pid, wx, wy, wz, sample_token) inside the boxes of moving annotations(sample_token, token, translation, size, rotation, moving).

    Boxes stand upright or tilt as their quaternion says; they meet points by lattice cell."""
    r = quaternion(*[F.col("rotation")[k] for k in range(4)])
    at = [F.col("translation")[k] for k in range(3)]
    w, long, h = (F.col("size")[k] for k in range(3))
    b = annotations_.filter("moving").select("sample_token", *[x.alias(f"_r{i}") for i, x in enumerate(r)], *[x.alias(f"_c{k}") for k, x in enumerate(at)], (long / 2 + 0.1).alias("_l"), (w / 2 + 0.1).alias("_w"), (h / 2 + 0.1).alias("_h"))
    reach, cell = F.sqrt(F.col("_l") ** 2 + F.col("_w") ** 2 + F.col("_h") ** 2), 8.0
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / cell), F.floor((F.col(c) + reach) / cell))
    b = b.withColumn("_i", F.explode(span("_c0"))).withColumn("_j", F.explode(span("_c1")))
    p = points.withColumn("_i", F.floor(F.col("wx") / cell)).withColumn("_j", F.floor(F.col("wy") / cell))
    d = [F.col(v) - F.col(f"_c{k}") for k, v in enumerate(("wx", "wy", "wz"))]
    own = [F.col(f"_r{k}") * d[0] + F.col(f"_r{3 + k}") * d[1] + F.col(f"_r{6 + k}") * d[2] for k in range(3)]
    hit = (F.abs(own[0]) <= F.col("_l")) & (F.abs(own[1]) <= F.col("_w")) & (F.abs(own[2]) <= F.col("_h"))
    return p.join(b, ["sample_token", "_i", "_j"]).filter(hit).select("frame", "pid").distinct()


def frames(t: dict[str, DataFrame], root: str, rows: int = 32, steps: tuple[int, ...] = (2, 4), remove_close: float = 1.0, channel: str = "LIDAR_TOP") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, frames, earlier) of all labelled keyframes.

    points(frame, pid, x, y, z, inten, ring, label, moving): in the ego frame, frame being the record's
    token; frames(frame, sample_token, ts, pose, sensor, ex, ey); earlier(frame, step, x, y, z): sweeps
    so many records before, moved to the world.  Close points go, intensities of bytes are scaled by
    frame, lasers become rows by their mean elevation, and what moves is a vehicle or person in a moving box."""
    records = lidar_frames(t, channel)
    key = records.filter("is_key_frame")
    if "lidarseg" in t:
        key = key.join(t["lidarseg"].select(F.col("sample_data_token").alias("token"), F.col("filename").alias("_labels")), "token")
    raw = read_points(key, root).filter(F.hypot("x", "y") > remove_close)
    top = raw.groupBy("token").agg(F.max("inten").alias("_top"))
    info = key.select("token", "calib", "pose", "sample_token", "timestamp")
    p = raw.join(laser_rows(raw, rows), ["token", "laser"]).join(top, "token").join(info, "token")
    x, y, z = rigid(F.col("x"), F.col("y"), F.col("z"), F.col("calib"))
    inten = F.when(F.col("_top") > 1.5, F.col("inten") / 255).otherwise(F.col("inten"))
    p = p.select(F.col("token").alias("frame"), "pid", "sample_token", "pose", x.cast("float").alias("x"), y.cast("float").alias("y"), z.cast("float").alias("z"), inten.cast("float").alias("inten"), F.col("ring").cast("smallint").alias("ring"))
    if "lidarseg" in t:
        label = read_labels(key.select("token", F.col("_labels").alias("filename")), root, t.get("category"))
        p = p.join(label.withColumnRenamed("token", "frame"), ["frame", "pid"], "left").withColumn("label", F.coalesce("label", F.lit(-1)).cast("tinyint"))
    else:
        p = p.withColumn("label", F.lit(-1).cast("tinyint"))
    wx, wy, wz = rigid(F.col("x"), F.col("y"), F.col("z"), F.col("pose"))
    inside = moving_points(p.select("frame", "pid", "sample_token", wx.alias("wx"), wy.alias("wy"), wz.alias("wz")), annotations(t)).withColumn("_in", F.lit(True))
    p = p.join(inside, ["frame", "pid"], "left").withColumn("moving", F.coalesce("_in", F.lit(False)) & F.col("label").isin(7, 8))
    back = steps_back(records, steps).join(key.select("token"), "token", "left_semi")
    of = records.withColumn("_m", _times("pose", "calib")).select(F.col("token").alias("back"), "filename", "_m")
    old = back.join(of, "back")
    files = old.select(F.col("back").alias("token"), "filename").distinct()
    r = read_points(files, root).filter(F.hypot("x", "y") > remove_close).withColumnRenamed("token", "back").join(old.drop("filename"), "back")
    ex, ey, ez = rigid(F.col("x"), F.col("y"), F.col("z"), F.col("_m"))
    earlier = r.select(F.col("token").alias("frame"), F.col("step").cast("int").alias("step"), ex.alias("x"), ey.alias("y"), ez.alias("z"))
    table = key.select(F.col("token").alias("frame"), "sample_token", F.col("timestamp").alias("ts"), "pose", F.array(*[F.col("calib")[4 * k + 3] for k in range(3)]).alias("sensor"), F.col("pose")[3].alias("ex"), F.col("pose")[7].alias("ey"))
    return p.select("frame", "pid", "x", "y", "z", "inten", "ring", "label", "moving"), table, earlier
