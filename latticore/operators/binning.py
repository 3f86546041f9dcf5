"""World-aligned binning of points into the tiers of a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import argmax, floor_div, rigid
from ..schema import CLASSES, GROUND, PERSON, Tier, drive, tiers

N = len(CLASSES)


def tier_array(profile="spec") -> Column:
    """The tiers as one array literal: their number is fixed by the profile, so no join is needed."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in vars(t).items()]) for t in tiers(profile)])


def window_origins(frames: DataFrame, profile="spec") -> DataFrame:
    """frames(frame, ex, ey) -> one row a frame and tier with the window's origin (oi, oj) in its own cells, and the frame's place in its drive."""
    frames = frames.select(*[c for c in frames.columns if c != "pose"], F.row_number().over(Window.partitionBy(*drive(frames)).orderBy("frame")).alias("ord"))
    coarse = tiers(profile)[-1].cell
    f = frames.select("*", F.explode(tier_array(profile)).alias("t")).select(*frames.columns, "t.*")
    at = lambda e: ((F.floor(F.col(e) / F.lit(coarse)) - F.col("half_coarse")) * F.col("per_coarse")).cast("long")
    return f.withColumn("oi", at("ex")).withColumn("oj", at("ey"))


def world(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds wx, wy, wz, the points moved by their frame's pose, and the ego position ex, ey.

    frames(frame, pose) or, for drives that only translate, frames(frame, ex, ey); seq where points have it.
    Spark broadcasts the frames where their size allows."""
    on = [*drive(points), "frame"]
    if "pose" in frames.columns:
        p = points.join(frames.select(*on, "pose"), on)
        w = rigid(F.col("x"), F.col("y"), F.col("z"), F.col("pose"))
        return p.select(*points.columns, *[c.alias(n) for c, n in zip(w, ("wx", "wy", "wz"), strict=True)], F.col("pose")[3].alias("ex"), F.col("pose")[7].alias("ey"))
    p = points.join(frames.select(*on, "ex", "ey"), on)
    return p.select(*points.columns, (F.col("x") + F.col("ex")).alias("wx"), (F.col("y") + F.col("ey")).alias("wy"), F.col("z").cast("double").alias("wz"), "ex", "ey")


def assign(points: DataFrame, profile="spec") -> DataFrame:
    """points(frame, wx, wy, ex, ey, ...) -> one row a point and tier whose window holds it: tier, ci, cj.

    The fine index is taken once in doubles; coarser cells follow by integer floor division, so a
    coarse cell is an exact union of finer ones.  Pure projection: no join, no shuffle."""
    ts = tiers(profile)
    base, coarse = ts[0].cell, ts[-1].cell
    p = points.select("*", F.floor(F.col("wx") / F.lit(base)).alias("_fi"), F.floor(F.col("wy") / F.lit(base)).alias("_fj"), F.floor(F.col("ex") / F.lit(coarse)).alias("_ei"), F.floor(F.col("ey") / F.lit(coarse)).alias("_ej"))

    def one(t: Tier) -> Column:
        ci, cj = floor_div(F.col("_fi"), t.ratio), floor_div(F.col("_fj"), t.ratio)
        i, j = ci - (F.col("_ei") - t.half_coarse) * t.per_coarse, cj - (F.col("_ej") - t.half_coarse) * t.per_coarse
        inside = i.between(0, t.n - 1) & j.between(0, t.n - 1)
        return F.when(inside, F.struct(F.lit(t.tier).alias("tier"), ci.alias("ci"), cj.alias("cj")))

    hit = F.filter(F.array(*[one(t) for t in ts]), lambda s: s.isNotNull())
    return p.withColumn("_t", F.explode(hit)).select(*points.columns, "_t.tier", "_t.ci", "_t.cj")


def bin_points(placed: DataFrame, keys: tuple[str, ...] | None = None, probs: str | None = None) -> DataFrame:
    """Per-cell statistics in one aggregation (partial sums before the shuffle), by drive, frame, tier and cell.

    Heights are wz where points have it, else z.

    Class comes from `cls`, or from the array `probs` (its first maximum).  ps0..: class mass of
    static points; pa0..: of all points."""
    keys = keys or (*drive(placed), "frame", "tier", "ci", "cj")
    p = placed if probs is None else placed.withColumn("cls", argmax(F.col(probs)))
    z = F.col("wz" if "wz" in placed.columns else "z")
    st = ~F.col("moving")
    gr = F.col("cls").isin(*GROUND)
    mass = (lambda c: F.when(F.col("cls") == c, 1.0).otherwise(0.0)) if probs is None else (lambda c: F.col(probs)[c])
    return p.groupBy(*keys).agg(
        F.count("*").alias("n_pts"),
        F.count_if(st).alias("n_static"),
        F.count_if(st & gr).alias("n_ground"),
        F.count_if("moving").alias("n_dyn"),
        F.count_if(F.col("moving") & (F.col("cls") == PERSON)).alias("n_dyn_person"),
        F.min(F.when(st, z)).alias("z_min"),
        F.max(F.when(st, z)).alias("z_max"),
        F.avg(F.when(st & gr, z)).alias("ground"),
        F.when(F.count_if(st & gr) > 1, F.stddev_pop(F.when(st & gr, z))).alias("rough"),
        F.min(F.when(st & ~gr, z)).alias("zmin_ng"),
        *[F.sum(F.when(st, mass(c)).otherwise(0.0)).alias(f"ps{c}") for c in range(N)],
        *[F.sum(mass(c)).alias(f"pa{c}") for c in range(N)],
    )


def dynamic_cells(stats: DataFrame) -> DataFrame:
    """Cells with moving points in this frame: person where they are the majority, else vehicle."""
    return stats.filter("n_dyn > 0").select(*drive(stats), "frame", "tier", "ci", "cj", F.when(F.col("n_dyn_person") * 2 > F.col("n_dyn"), 8).otherwise(7).alias("cls"))


def covered(cells: DataFrame, origins: DataFrame, profile="spec") -> DataFrame:
    """Adds `covered`: whether the next finer tier's window holds the cell's whole area."""
    ts = tiers(profile)
    on = [*drive(cells), "frame", "tier"]
    up = F.when(F.lit(False), F.lit(0))
    size = F.when(F.lit(False), F.lit(0))
    for a, b in zip(ts, ts[1:], strict=False):
        up = up.when(F.col("tier") == b.tier, b.ratio // a.ratio)
        size = size.when(F.col("tier") == b.tier, a.n // (b.ratio // a.ratio))
    finer = origins.select(*on[:-1], (F.col("tier") + 1).alias("tier"), F.col("oi").alias("_oi"), F.col("oj").alias("_oj"))
    c = cells.join(finer, on, "left").withColumn("_up", up).withColumn("_n", size)
    inside = (F.col("ci") - F.floor(F.col("_oi") / F.col("_up"))).between(0, F.col("_n") - 1) & (F.col("cj") - F.floor(F.col("_oj") / F.col("_up"))).between(0, F.col("_n") - 1)
    return c.withColumn("covered", F.coalesce(inside, F.lit(False))).drop("_oi", "_oj", "_up", "_n")


def nesting(stats: DataFrame, origins: DataFrame, profile="spec") -> DataFrame:
    """Per frame and coarser tier: covered cells, and how many differ from the sum of their finer cells."""
    ts, on, out = tiers(profile), [*drive(stats), "frame"], None
    for a, b in zip(ts, ts[1:], strict=False):
        r = b.ratio // a.ratio
        fine = stats.filter(F.col("tier") == a.tier).groupBy(*on, floor_div(F.col("ci"), r).alias("ci"), floor_div(F.col("cj"), r).alias("cj")).agg(F.sum("n_pts").alias("fine"))
        coarse = covered(stats.filter(F.col("tier") == b.tier), origins, profile).filter("covered").select(*on, "tier", "ci", "cj", "n_pts")
        part = coarse.join(fine, [*on, "ci", "cj"], "left").groupBy(*on, "tier").agg(F.count("*").alias("n_cells"), F.count_if(F.coalesce("fine", F.lit(0)) != F.col("n_pts")).alias("n_bad"))
        out = part if out is None else out.union(part)
    return out


def in_window(points: DataFrame, origins: DataFrame) -> DataFrame:
    """Points inside each frame's and tier's window, counted by metres from the window's edges: no cell index is taken.

    For comparison with what was binned; points(frame, wx, wy), origins of window_origins()."""
    on = [*drive(points), "frame"]
    o = origins.select(*on, "tier", "n", "cell", (F.col("oi") * F.col("cell")).alias("x0"), (F.col("oj") * F.col("cell")).alias("y0"))
    inside = lambda w, at: (F.col(w) >= F.col(at)) & (F.col(w) < F.col(at) + F.col("n") * F.col("cell"))
    return points.join(o, on).filter(inside("wx", "x0") & inside("wy", "y0")).groupBy(*on, "tier").agg(F.count("*").alias("n_in"))


def cell_centre(index: Column, cell: Column) -> Column:
    return (index + 0.5) * cell


def memory(profiles=("spec", "graded", "uniform5", "uniform50")) -> list[tuple[str, int, int]]:
    """(profile, cells, bytes at 16 a cell)."""
    return [(p, sum(t.n * t.n for t in tiers(p)), 16 * sum(t.n * t.n for t in tiers(p))) for p in profiles]
