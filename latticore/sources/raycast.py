"""Simulated sweeps: a beam table and the nearest hit of every beam in a scene of solids.

A scene is a bounded list of solids that move with time.  It stands in the plan as an array literal that
each beam explodes; misses are filtered at once in compiled code, and only the hits of a beam (a few)
are aggregated, first within the task.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The sensor.
BEAMS, COLUMNS = 64, 1024
FOV_UP, FOV_DOWN = 2.0, -24.9
MAX_RANGE = 100.0
POROUS = 0.35  # share of beams that pass a sphere
MOVING_SPEED = 0.3
ROAD = 0
HEIGHT = 1.73
RANGE_NOISE, DROPOUT = 0.02, 0.03
REFLECT = (0.15, 0.30, 0.20, 0.35, 0.45, 0.35, 0.40, 0.55, 0.30)  # by class
MARKING, FALLOFF, INTENSITY_NOISE = 0.85, 0.3, 0.04


@dataclass(frozen=True)
class Solid:
    """kind 0 box (a, b, c) to (d, e, f); 1 upright cylinder at (a, b), radius c, from d up to e; 2 sphere at (a, b, c), radius d."""

    kind: int
    cls: int
    inst: int
    a: float
    b: float
    c: float
    d: float
    e: float = 0.0
    f: float = 0.0
    vx: float = 0.0
    vy: float = 0.0


def beam_table(spark: SparkSession, rows: int = BEAMS, columns: int = COLUMNS, up: float = FOV_UP, down: float = FOV_DOWN) -> DataFrame:
    """(row, col, dx, dy, dz): unit directions, the top row first, columns clockwise from behind."""
    ids = spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("int").alias("row"), (F.col("id") % columns).cast("int").alias("col"))
    elev = F.radians(F.lit(up) + F.col("row") * ((down - up) / (rows - 1)))
    az = F.radians(180.0 - F.col("col") * (360.0 / columns))
    return ids.select("row", "col", (F.cos(elev) * F.cos(az)).alias("dx"), (F.cos(elev) * F.sin(az)).alias("dy"), F.sin(elev).alias("dz"))


def solids(scene: list[Solid]) -> Column:
    """The scene as an array literal of structs, the ground (kind -1) first."""
    row = lambda s: F.struct(*[F.lit(getattr(s, f.name) if f.type == "int" else float(getattr(s, f.name))).alias(f.name) for f in fields(Solid)])
    return F.array(*[row(s) for s in [Solid(-1, ROAD, 0, 0.0, 0.0, 0.0, 0.0), *scene]])


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def _distance(s: Column, origin: tuple, t, seed: str) -> Column:
    """Distance along the beam to a solid, null without a hit; ix, iy, iz are the reciprocals of the direction."""
    ox, oy, oz = map(_col, origin)
    dx, dy, dz = F.col("dx"), F.col("dy"), F.col("dz")
    mx, my = s["vx"] * t - ox, s["vy"] * t - oy
    ends = [((s["a"] + mx) * F.col("ix"), (s["d"] + mx) * F.col("ix")), ((s["b"] + my) * F.col("iy"), (s["e"] + my) * F.col("iy")), ((s["c"] - oz) * F.col("iz"), (s["f"] - oz) * F.col("iz"))]
    near, far = F.greatest(*[F.least(p, q) for p, q in ends]), F.least(*[F.greatest(p, q) for p, q in ends])
    box = F.when((near > 0) & (far >= near), near)

    round_ = s["kind"] == 2
    cx, cy, cz = -s["a"] - mx, -s["b"] - my, F.when(round_, oz - s["c"]).otherwise(0.0)
    flat = F.when(round_, 1.0).otherwise(dx * dx + dy * dy)
    radius = F.when(round_, s["d"]).otherwise(s["c"])
    half = dx * cx + dy * cy + dz * cz
    disc = half * half - flat * (cx * cx + cy * cy + cz * cz - radius * radius)
    at = (-half - F.sqrt(F.greatest(disc, F.lit(0.0)))) / flat
    opaque = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("row").cast("string"), F.col("col").cast("string"), s["inst"].cast("string"))), 1, 8) >= f"{round(POROUS * 2**32):08x}"
    curved = F.when((disc > 0) & (at > 0) & F.when(round_, opaque).otherwise((oz + at * dz).between(s["d"], s["e"])), at)
    return F.when(s["kind"] == -1, F.col("_level")).when(s["kind"] == 0, box).otherwise(curved)


def cast(beams: DataFrame, scene: list[Solid], holes: list[tuple[float, float, float, float]] = (), origin: tuple = (0.0, 0.0, 1.73), t=0.0, seed: str = "porous") -> DataFrame:
    """beams with range, cls, inst and moving of the nearest hit; a beam that meets nothing has nulls.

    The ground is the plane z = 0, sunk by `depth` where the plane is met within a hole (x, y,
    radius, depth).  Of equal distances the least class, then instance, wins.  A sphere lets the same
    share of beams through in every run: a hash of seed, beam and instance decides.  Beams are told
    apart by all their columns; origin and time are numbers, or columns of beams for a moving sensor."""
    ox, oy, oz = map(_col, origin)
    down = F.when(F.col("dz") < -1e-6, F.col("dz"))
    level = -oz / down
    sunk = F.lit(0.0)
    for x, y, r, depth in holes:
        hx, hy = ox + level * F.col("dx") - x, oy + level * F.col("dy") - y
        sunk = F.when(hx * hx + hy * hy < r * r, F.lit(float(depth))).otherwise(sunk)
    inverse = {f"i{c}": F.lit(1.0) / F.when(F.abs(F.col(f"d{c}")) < 1e-9, 1e-9).otherwise(F.col(f"d{c}")) for c in "xyz"}
    pairs = beams.withColumns({**inverse, "_level": (-oz - sunk) / down}).select("*", F.explode(solids(scene)).alias("_s"))
    s = F.col("_s")
    met = pairs.select(*beams.columns, s["kind"].alias("_kind"), _distance(s, origin, t, seed).alias("range"), s["cls"].alias("cls"), s["inst"].alias("inst"), (F.abs(s["vx"]) + F.abs(s["vy"]) > MOVING_SPEED).alias("moving"))
    # misses end here; the ground's row stays, so that every beam does
    met = met.filter("range is not null or _kind = -1")
    best = F.min(F.when(F.col("range").isNotNull(), F.struct("range", "cls", "inst", "moving"))).alias("_hit")
    return met.groupBy(*beams.columns).agg(best).select(*beams.columns, "_hit.range", "_hit.cls", "_hit.inst", "_hit.moving")


def returns(hits: DataFrame, most: float = MAX_RANGE, dropout: float = 0.03, seed: str = "dropout") -> DataFrame:
    """Points (row, col, x, y, z, range, cls, inst, moving) of the beams that come back: within `most`, less a hashed share."""
    back = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("row"), F.col("col"))), 1, 8) >= f"{round(dropout * 2**32):08x}"
    at = [(F.col("range") * F.col(f"d{c}")).alias(c) for c in "xyz"]
    return hits.filter((F.col("range") <= most) & back).select("row", "col", *at, "range", "cls", "inst", "moving")


def without(low: Column, high: Column, centre: Column, half: float = 7.5) -> Column:
    """An interval less another: an array of the 0 to 2 pieces that remain."""
    a, b = centre - half, centre + half
    piece = lambda p, q: F.struct(p.alias("low"), q.alias("high"))
    apart = (high <= a) | (low >= b)
    both = F.array(piece(low, F.when(low < a, a)), piece(F.when(high > b, b), high))
    return F.when(apart, F.array(piece(low, high))).otherwise(F.filter(both, lambda p: p["low"].isNotNull() & p["high"].isNotNull()))


def drive_scene(seed: int = 7, n: int = 40, reach: float = 60.0) -> tuple[list[Solid], list[tuple[float, float, float, float]]]:
    """A seeded street: parked and moving cars, walkers, poles, tree crowns, and holes in the road."""
    import numpy as np

    rng = np.random.default_rng(seed)
    out: list[Solid] = []
    for i in range(n):
        x, side = float(np.round(rng.uniform(-reach, reach), 2)), 1.0 if rng.random() < 0.5 else -1.0
        kind = i % 5
        if kind == 0:
            out.append(Solid(0, 7, i + 1, x, side * 5.0, 0.0, x + 4.2, side * 5.0 + 1.8, 1.5))
        elif kind == 1:
            out.append(Solid(0, 7, i + 1, x, side * 2.0, 0.0, x + 4.2, side * 2.0 + 1.8, 1.5, vx=side * 8.0))
        elif kind == 2:
            out.append(Solid(1, 8, i + 1, x, side * 8.5, 0.3, 0.0, 1.75, vx=1.25))
        elif kind == 3:
            out.append(Solid(1, 6, i + 1, x, side * 9.5, 0.12, 0.0, 6.0))
        else:
            out.append(Solid(2, 4, i + 1, x, side * 12.0, 4.5, 2.0))
    holes = [(float(np.round(rng.uniform(3, 12), 2)), float(np.round(rng.uniform(-3, 3), 2)), 0.5, 0.1) for _ in range(4)]
    return out, holes


@dataclass
class Street:
    """A scene of solids, holes (x, y, radius, depth), lane markings (x0, y0, x1, y1) and the place of a crossing street."""

    solids: list[Solid]
    holes: list[tuple[float, float, float, float]]
    markings: list[tuple[float, float, float, float]]
    cross: float


def street(seed: int, low: float = -100.0, high: float = 160.0, speed: float = 8.0) -> Street:
    """A seeded street along the x axis with sidewalks, verges, houses, poles, trees, a gantry, holes, markings, cars and walkers.

    Everything is laid out by rules of the form (from, step, jitter, chance) over the street's length, on
    both sides, and left out around the crossing street."""
    import numpy as np

    rng = np.random.default_rng(seed)
    r = lambda a, b: float(np.round(rng.uniform(a, b), 3))
    cross = r(30.0, max(high - 60.0, 31.0))
    out: list[Solid] = []

    def put(kind, cls, *args, inst=None, **moving):
        out.append(Solid(kind, cls, inst or len(out) + 1, *map(float, args), **moving))
        return out[-1].inst

    def along(start, step, jitter, chance, free):
        x = low + start
        while x < high:
            if rng.random() < chance and abs(x - cross) > free:
                yield x
            x += step + r(0, jitter) if jitter else step

    def parts(a, b, half):
        return [(p, q) for p, q in ((a, min(b, cross - half)), (max(a, cross + half), b)) if q > p]

    def slab(a, b, y0, y1, top, cls, base=-0.01):
        put(0, cls, a, min(y0, y1), base, b, max(y0, y1), top)

    for side in (-1.0, 1.0):
        for a, b in parts(low, high, 7.5):
            slab(a, b, side * 7.0, side * 10.0, 0.15, 1)
            for x in np.arange(a, b, 25.0):
                lot = rng.random() < 0.3
                slab(float(x), min(float(x) + 25.0, b), side * 10.0, side * 60.0, 0.02 if lot else 0.15 + r(-0.03, 0.06), 2 if lot else 3)
        for x in along(0, 25, 12, 0.9, 20):
            back = r(16, 26)
            slab(x, x + r(10, 20), side * back, side * (back + r(8, 20)), r(5, 18), 5, 0.0)
        for x in along(5, 18, 12, 1.0, 8):
            inst = put(1, 6, x, side * 7.6, 0.1, 0.0, r(5, 7))
            if rng.random() < 0.5:
                put(0, 6, x - 0.3, side * 7.6 - 0.03, 2.2, x + 0.3, side * 7.6 + 0.03, 2.9, inst=inst)
        for x in along(3, 9, 11, 1.0, 9):
            y, crown = side * r(8.8, 11.5), r(1.6, 2.4)
            put(2, 4, x, y, 3.3 + crown, crown, inst=put(1, 4, x, y, 0.18, 0.0, 3.4))
        for x in along(0, 6, 0, 0.35, 9):
            inst = put(0, 7, x - 2.2, side * 6.0 - 0.9, 0.25, x + 2.2, side * 6.0 + 0.9, 1.05)
            put(0, 7, x - 1.2, side * 6.0 - 0.8, 1.05, x + 1.2, side * 6.0 + 0.8, 1.5, inst=inst)
        for x in along(10, 12, 10, 0.6, 0):
            put(1, 8, x, side * r(7.8, 9.6), 0.28, 0.15, r(1.6, 1.9), vx=r(-1.7, 1.7) if rng.random() < 0.6 else 0.0)
    gate = r(15, 45)
    inst = put(0, 6, gate - 0.4, -7.8, 4.9, gate + 0.4, 7.8, 5.6)
    for y in (-7.8, 7.8):
        put(1, 6, gate, y, 0.2, 0.0, 5.6, inst=inst)
    for y, v in ((-2.5, speed + r(-1.5, 3.0)), (2.5, -r(7, 13)), (2.5, -r(7, 13))):
        x = r(20, 60)
        inst = put(0, 7, x - 2.2, y - 0.9, 0.25, x + 2.2, y + 0.9, 1.05, vx=v)
        put(0, 7, x - 1.2, y - 0.8, 1.05, x + 1.2, y + 0.8, 1.5, inst=inst, vx=v)
    put(1, 8, r(25, 70), r(-6, 6), 0.3, 0.0, 1.75, vy=r(1.0, 1.6))
    holes = [(r(0, 60), r(-4.5, 4.5), r(0.25, 0.6), r(0.06, 0.12)) for _ in range(8)]
    dashes = [(x, -0.08, x + 3.0, 0.08) for x in along(0, 6, 0, 1.0, 8)]
    lines = [(a, y - 0.08, b, y + 0.08) for y in (-5.0, 5.0) for a, b in parts(low, high, 8.0)]
    return Street(out, holes, dashes + lines, cross)


def on_markings(x: Column, y: Column, markings: list[tuple[float, float, float, float]]) -> Column:
    """Whether a place lies on a marking: the list stands in the plan as one array literal."""
    if not markings:
        return F.lit(False)
    rows = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(m, "abcd", strict=True)]) for m in markings])
    return F.exists(rows, lambda m: x.between(m["a"], m["c"]) & y.between(m["b"], m["d"]))


def _uniform(seed: int, salt: int) -> Column:
    """A number in (0, 1) of seed, salt, frame and beam: the same in every run."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "frame", "row", "col"), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(seed: int, salt: int) -> Column:
    return F.sqrt(-2 * F.log(_uniform(seed, salt))) * F.cos(2 * F.pi() * _uniform(seed, salt + 1))


def simulate(spark: SparkSession, seed: int, n_frames: int = 60, speed: float = 8.0, dt: float = 0.1, scene: Street | None = None, lane: float = -2.5, rows: int = BEAMS, columns: int = COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(points, frames) of a seeded drive along a street: one sweep each dt seconds, with range noise, dropout and an intensity model.

    points(seq, frame, pid, x, y, z, inten, ring, label, moving) in the ego frame, whose origin is on the ground; frames(seq,
    frame, ts, pose, sensor, hz, ex, ey).  Noise comes from hashes of seed, frame and beam, so frames are independent tasks."""
    scene = scene or street(seed, high=100.0 + speed * dt * n_frames + 60.0, speed=speed)
    f = spark.range(n_frames).select(F.col("id").cast("int").alias("frame"), (F.col("id") * dt).alias("t"), (F.col("id") * (speed * dt)).alias("ex"), F.lit(lane).alias("ey"))
    zero, one = F.lit(0.0), F.lit(1.0)
    pose = F.array(one, zero, zero, "ex", zero, one, zero, "ey", zero, zero, one, zero, zero, zero, zero, one)
    frames = f.select(F.lit(f"sim{seed}").alias("seq"), "frame", F.round(F.col("t") * 1e6).cast("long").alias("ts"), pose.alias("pose"), F.array(zero, zero, F.lit(HEIGHT)).alias("sensor"), F.lit(1.0 / dt).alias("hz"), "ex", "ey")
    beams = f.repartition(n_frames, "frame").crossJoin(F.broadcast(beam_table(spark, rows, columns)))  # a sensor's fixed beams
    hit = cast(beams, scene.solids, scene.holes, (F.col("ex"), F.col("ey"), HEIGHT), F.col("t"), seed=f"porous{seed}").filter("range is not null")
    hit = hit.withColumn("range", F.col("range") + RANGE_NOISE * _normal(seed, 1)).filter((F.col("range") < MAX_RANGE) & (_uniform(seed, 3) > DROPOUT))
    x, y, z = (F.col("range") * F.col(f"d{c}") for c in "xyz")
    hit = hit.withColumns({"x": x, "y": y, "z": z + HEIGHT})
    painted = (F.col("cls") == ROAD) & on_markings(F.col("x") + F.col("ex"), F.col("y") + F.col("ey"), scene.markings)
    base = F.when(painted, MARKING).otherwise(F.get(F.array(*[F.lit(v) for v in REFLECT]), F.col("cls")))
    inten = base * (1 - FALLOFF * F.least(F.col("range") / MAX_RANGE, F.lit(1.0))) + INTENSITY_NOISE * _normal(seed, 4)
    inten = F.least(F.greatest(inten, F.lit(0.0)), F.lit(1.0))
    points = hit.select(
        F.lit(f"sim{seed}").alias("seq"), "frame", (F.col("row") * columns + F.col("col")).cast("long").alias("pid"), *[F.col(c).cast("float").alias(c) for c in "xyz"],
        inten.cast("float").alias("inten"), F.col("row").cast("smallint").alias("ring"), F.col("cls").cast("tinyint").alias("label"), "moving",
    )
    return points, frames


def simulate_many(spark: SparkSession, seeds: list[int], **options) -> tuple[DataFrame, DataFrame]:
    """Drives of several seeds in one table each, told apart by seq."""
    from functools import reduce

    made = [simulate(spark, s, **options) for s in seeds]
    return reduce(DataFrame.unionByName, [p for p, _ in made]), reduce(DataFrame.unionByName, [f for _, f in made])


def save_npz(points: DataFrame, frames: DataFrame, folder: str) -> DataFrame:
    """A compressed file of plain arrays for each drive (coordinates and intensity in half precision): (seq, file)."""
    import pandas as pd

    def run(key, pts: pd.DataFrame, fr: pd.DataFrame) -> pd.DataFrame:
        import io

        import numpy as np
        from pyarrow import fs

        pts, fr, raw = pts.sort_values(["frame", "pid"]), fr.sort_values("frame"), io.BytesIO()
        arrays = {"frame": pts["frame"].to_numpy(np.int32), "pid": pts["pid"].to_numpy(np.int64), "xyz": pts[["x", "y", "z"]].to_numpy(np.float16), "inten": pts["inten"].to_numpy(np.float16)}
        arrays |= {"ring": pts["ring"].to_numpy(np.int16), "label": pts["label"].to_numpy(np.int8), "moving": pts["moving"].to_numpy(bool)}
        np.savez_compressed(raw, **arrays, frames=fr["frame"].to_numpy(np.int32), pose=np.stack(fr["pose"].to_numpy()), ts=fr["ts"].to_numpy(np.int64))
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{key[0]}.npz") as out:
            out.write(raw.getbuffer())
        return pd.DataFrame({"seq": [key[0]], "file": [f"{folder.rstrip('/')}/{key[0]}.npz"]})

    fresh = lambda df: df.toDF(*df.columns)  # noqa: E731  both may stem from one table
    return fresh(points).groupBy("seq").cogroup(fresh(frames).groupBy("seq")).applyInPandas(run, "seq string, file string")


def load_npz(files: DataFrame) -> DataFrame:
    """Points of the files of save_npz(), files(seq, file).  Arrays only: nothing is unpickled."""

    def run(batches):
        import io

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for seq, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, path = fs.FileSystem.from_uri(name)
                with system.open_input_file(path) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as got:
                    xyz = got["xyz"].astype(np.float32)
                    cols = [got["frame"], got["pid"], *xyz.T, got["inten"].astype(np.float32), got["ring"], got["label"], got["moving"]]
                for at in range(0, len(xyz), 1 << 17):
                    part = [pa.array(np.ascontiguousarray(c[at : at + (1 << 17)])) for c in cols]
                    yield pa.RecordBatch.from_arrays([pa.array([seq] * len(part[0]), pa.string()), *part], ["seq", "frame", "pid", "x", "y", "z", "inten", "ring", "label", "moving"])

    return files.select("seq", "file").mapInArrow(run, "seq string, frame int, pid long, x float, y float, z float, inten float, ring smallint, label tinyint, moving boolean")
