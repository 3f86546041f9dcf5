"""Scalar expressions, all JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column


def floor_div(a: C, b) -> C:
    """Floor division: unlike `div`, rounds towards minus infinity."""
    return F.floor(a / b).cast("long")


def f16(v: C) -> C:
    """The nearest half-precision value, ties to even, as a double; null stays null, overflow is infinite."""
    size = F.abs(v)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(-14)) - 10)
    r = F.signum(v) * F.rint(size / step) * step
    return F.when(v == 0, F.lit(0.0)).when(F.abs(r) >= 65520, F.signum(v) * F.lit(float("inf"))).otherwise(r)


def u8(v: C, most: int = 255) -> C:
    """Clip, then truncate."""
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(float(most)))).cast("int")


def argmax(values: C) -> C:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def rigid(x: C, y: C, z: C, pose: C) -> list[C]:
    """pose: row-major 4x4 array."""
    return [pose[4 * k] * x + pose[4 * k + 1] * y + pose[4 * k + 2] * z + pose[4 * k + 3] for k in range(3)]


def rigid_inverse(x: C, y: C, z: C, pose: C) -> list[C]:
    d = [v - pose[4 * k + 3] for k, v in enumerate((x, y, z))]
    return [pose[k] * d[0] + pose[4 + k] * d[1] + pose[8 + k] * d[2] for k in range(3)]


def quaternion(w: C, x: C, y: C, z: C) -> list[C]:
    """Rotation matrix, row-major, of a quaternion that is normalised first."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = w / n, x / n, y / n, z / n
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def yaw(pose: C) -> C:
    return F.atan2(pose[4], pose[0])


def column_of(x: C, y: C, width: int = 1024) -> C:
    """Range-image column of a ray, half-even rounding, wrapping round."""
    return F.pmod(F.rint((180.0 - F.degrees(F.atan2(y, x))) / 360.0 * width).cast("long"), F.lit(width)).cast("int")


def row_fixed(elev: C, up: float = 2.0, down: float = -24.9, rows: int = 64) -> C:
    return F.least(F.greatest(F.floor((up - elev) / (up - down) * rows), F.lit(0)), F.lit(rows - 1)).cast("int")


def band(distance: C, edges=(0, 10, 25, 50, 100)) -> C:
    """Index of the half-open distance band, null beyond the last edge."""
    out = F.when(F.lit(False), 0)
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        out = out.when((distance >= lo) & (distance < hi), k)
    return out


def kitti_class(raw: C) -> C:
    """Class of a raw label's low 16 bits; -1 where it has none."""
    # Raw label ids by class.
    known = {0: (40, 60), 1: (48, 49), 2: (44,), 3: (72,), 4: (70, 71), 5: (50, 51, 52, 99), 6: (80, 81), 7: (10, 11, 13, 15, 16, 18, 20, 252, 256, 257, 258, 259), 8: (30, 31, 32, 253, 254, 255)}
    low = raw.bitwiseAND(0xFFFF)
    out = F.when(F.lit(False), -1)
    for cls, ids in known.items():
        out = out.when(low.isin(*ids), cls)
    return out.otherwise(-1).cast("int")


def kitti_moving(raw: C) -> C:
    return raw.bitwiseAND(0xFFFF).between(252, 259)


def class_of_name(name: C) -> C:
    """Class of a category name: exact names first, then prefixes; -1 for the rest."""
    # Class by category name.
    exact = {
        "noise": -1,
        "vehicle.ego": -1,
        "flat.driveable_surface": 0,
        "flat.sidewalk": 1,
        "flat.other": 1,
        "flat.terrain": 3,
        "static.vegetation": 4,
        "static.manmade": 5,
        "static.other": 5,
        "static_object.bicycle_rack": 5,
        "movable_object.debris": 5,
        "movable_object.pushable_pullable": 5,
        "movable_object.barrier": 6,
        "movable_object.trafficcone": 6,
    }
    out = F.when(F.lit(False), -1)
    for k, cls in exact.items():
        out = out.when(name == k, cls)
    return out.when(name.startswith("vehicle."), 7).when(name.startswith("human."), 8).when(name == "animal", 8).otherwise(-1).cast("int")


def softmax(logits: C, active: C | None = None) -> C:
    """Softmax of an array; inactive entries are set to -1e4 first."""
    x = logits if active is None else F.zip_with(logits, active, lambda v, a: F.when(a, v).otherwise(F.lit(-1e4)))
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, t: s + t))


def sigmoid(x: C) -> C:
    return 1 / (1 + F.exp(-x))
