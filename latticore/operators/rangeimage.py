"""Range images: projection, nearest point a pixel, rows, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import column_of, rigid_inverse
from ..schema import drive


def _from(sensor: tuple[float, float, float]) -> list[Column]:
    return [F.col(c) - F.lit(float(o)) for c, o in zip("xyz", sensor, strict=True)]


def elevation(sensor: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> Column:
    """Degrees above the horizon at which the sensor sees a point."""
    x, y, z = _from(sensor)
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def project(points: DataFrame, row: str | Column = "ring", width: int = 1024, rows: int = 64, sensor: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Adds row, col and range as seen from the sensor's place in the ego frame; drops points outside the image or within 0.5 m.

    The three come out of a generator of one row, which the optimizer can't push the filter through: below the projections that
    made the points it would repeat all their expressions many times, in one method too long for the JVM to compile."""
    x, y, z = _from(sensor)
    r = F.col(row) if isinstance(row, str) else row
    own = F.struct(r.cast("int").alias("row"), column_of(x, y, width).alias("col"), F.sqrt(x * x + y * y + z * z).alias("range"))
    p = points.select(*[c for c in points.columns if c not in ("row", "col", "range")], F.inline(F.array(own)))
    return p.filter(F.col("row").between(0, rows - 1) & (F.col("range") > 0.5))


def nearest(projected: DataFrame, carry: tuple[str, ...] = ("x", "y", "z", "inten")) -> DataFrame:
    """One row a pixel: its nearest point, of equals the one with the largest pid."""
    best = F.min(F.struct("range", (-F.col("pid")).alias("_p"), *carry)).alias("b")
    on = [*drive(projected), "frame"]
    return projected.groupBy(*on, "row", "col").agg(best).select(*on, "row", "col", "b.range", (-F.col("b._p")).alias("pid"), *[F.col(f"b.{c}").alias(c) for c in carry])


def row_elevation(points: DataFrame, row: str = "ring", rows: int = 64, sensor: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Mean elevation in degrees of all points of a row; empty rows interpolated between their neighbours, ends held.

    The table has one row an image row of a frame, so its windows are small."""
    on = [*drive(points), "frame"]
    e = points.groupBy(*on, F.col(row).cast("int").alias("row")).agg(F.avg(elevation(sensor)).alias("own"))
    full = points.select(*on).distinct().select(*on, F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row")).join(e, [*on, "row"], "left")
    w = Window.partitionBy(*on).orderBy("row")
    s = F.when(F.col("own").isNotNull(), F.struct("row", "own"))
    f = full.withColumn("a", F.last(s, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first(s, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    t = (F.col("row") - F.col("a.row")) / (F.col("b.row") - F.col("a.row"))
    mid = F.col("a.own") + t * (F.col("b.own") - F.col("a.own"))
    return f.select(*on, "row", F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("a").isNull(), F.col("b.own")).when(F.col("b").isNull(), F.col("a.own")).otherwise(mid).alias("elev"), F.col("own").isNull().alias("filled"))


def earlier(points: DataFrame, frames: DataFrame, lags: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Points of earlier frames seen from later ones: each point once for every lag, with frame the later one and x, y, z in its ego frame.

    points(frame, wx, wy, wz, ...) of binning.world(), frames(frame, pose).  A lag that leads to no frame gives nothing."""
    on = [*drive(points), "frame"]
    p = points.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).withColumn("frame", F.col("frame") + F.col("lag"))
    p = p.join(frames.select(*on, F.col("pose").alias("_to")), on)
    x, y, z = rigid_inverse(F.col("wx"), F.col("wy"), F.col("wz"), F.col("_to"))
    return p.withColumns({"x": x, "y": y, "z": z}).drop("_to")


def row_tables(points: DataFrame, rows: int = 64, sensor: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(frame, table): each frame's row elevations, top first, as one array."""
    on = [*drive(points), "frame"]
    t = row_elevation(points, rows=rows, sensor=sensor).groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("row", "elev"))).alias("t"))
    return t.select(*on, F.transform("t", lambda x: x["elev"]).alias("table"))


def with_row(points: DataFrame, elev: Column, rows: int = 64) -> DataFrame:
    """points(table, ...) with `row`, the row_of() their elevation in their table, in compiled code: how many rows lie above is
    found by halving in the sorted table, a projection a step."""
    p = points.withColumns({"_e": elev, "_at": F.lit(0)})
    step = 1 << (rows.bit_length() - 1)
    while step:
        then = F.col("_at") + step
        p = p.withColumn("_at", F.when(F.get("_falling", then - 1) > F.col("_e"), then).otherwise(F.col("_at")))
        step //= 2
    return p.withColumn("row", _placed(F.col("_e"), F.col("_at"), F.col("table"), rows)).drop("_e", "_at")


def seen_earlier(points: DataFrame, frames: DataFrame, lags: tuple[int, ...] = (1, 2), rows: int = 64, width: int = 1024, sensor: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """earlier() with lag, row, col and range in the later frame's image: the row whose mean elevation there lies nearest.

    The tables (a row a frame) are persisted, so that Spark knows their size and joins them without a shuffle of the points where it is small."""
    tables = row_tables(points, rows, sensor).withColumn("_falling", F.sort_array("table", False)).persist()
    tables.count()
    p = with_row(earlier(points, frames, lags).join(tables, [*drive(points), "frame"]), elevation(sensor), rows)
    return project(p, "row", width, rows, sensor).drop("table", "_falling")


def features(points: DataFrame, frames: DataFrame, lags: tuple[int, ...] = (1, 2), rows: int = 64, width: int = 1024, sensor: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Eight channels of every pixel: range, place, intensity, validity, and residuals to earlier frames.

    Earlier points are moved into the current ego frame and get the row whose mean elevation in the
    current frame lies nearest; then the nearest a pixel.  A residual is 0 where either image is empty.
    points(frame, pid, x, y, z, inten, ring, wx, wy, wz) of binning.world()."""
    on = [*drive(points), "frame"]
    pixels = nearest(project(points, width=width, rows=rows, sensor=sensor))
    before = seen_earlier(points, frames, lags, rows, width, sensor)
    before = before.groupBy(*on, "lag", "row", "col").agg(F.min("range").alias("_was")).groupBy(*on, "row", "col").agg(*[F.min(F.when(F.col("lag") == k, F.col("_was"))).alias(f"_r{i}") for i, k in enumerate(lags)])
    out = pixels.join(before, [*on, "row", "col"], "left")
    res = [F.coalesce(F.least(F.greatest(5 * F.abs(F.col("range") - F.col(f"_r{k}")) / F.greatest(F.col("range"), F.lit(1e-3)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias(f"f{6 + k}") for k in range(len(lags))]
    return out.select(*on, "row", "col", "pid", (F.col("range") / 50).alias("f0"), (F.col("x") / 50).alias("f1"), (F.col("y") / 50).alias("f2"), (F.col("z") / 3).alias("f3"), F.col("inten").alias("f4"), F.lit(1.0).alias("f5"), *res)


def label_image(points: DataFrame, rows: int = 64, width: int = 1024, sensor: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(frame, row, labels, moving): dense image rows of the nearest points' labels (-1 where empty) and moving flags (false there)."""
    on = [*drive(points), "frame"]
    px = nearest(project(points, width=width, rows=rows, sensor=sensor), ("label", "moving"))
    of = px.groupBy(*on, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct("label", "moving")))).alias("_m"))
    every = points.select(*on).distinct().select(*on, F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"))
    at = lambda field, none: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.coalesce(F.try_element_at("_m", c)[field], F.lit(none)))
    return every.join(of, [*on, "row"], "left").select(*on, "row", at("label", -1).alias("labels"), at("moving", False).alias("moving"))


def ring_order(points: DataFrame, ids: int = 64) -> DataFrame:
    """Row of each ring id by descending mean elevation; ids without points come last, larger ids first."""
    e = points.groupBy(F.col("ring").cast("int").alias("ring")).agg(F.avg(F.degrees(F.atan2("z", F.hypot("x", "y")))).alias("elev"))
    every = points.sparkSession.range(ids).select(F.col("id").cast("int").alias("ring")).join(e, "ring", "left")
    e = every.withColumn("elev", F.coalesce("elev", F.lit(-90.0) + F.col("ring") * 1e-3))
    return e.select("ring", "elev", (F.row_number().over(Window.orderBy(F.desc("elev"), "ring")) - 1).alias("row"))


def paint(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """Each point takes its pixel's prediction; points outside the image have none."""
    return points.join(pixels, [*drive(points), "frame", "row", "col"], "left")


def row_of(elev: Column, table: list[float] | Column, rows: int | None = None) -> Column:
    """Image row of an elevation by linear interpolation in a table of row elevations (top first, falling), a list or an array column of `rows` entries.

    Beyond half a row's spacing outside the table it is -1; halves go to the even row.  The elevation
    and its place in the table are bound as lambda variables, so that they are worked out once however
    often the optimizer repeats the expression's parts."""
    rows = rows or len(table)
    tab = table if isinstance(table, Column) else F.array(*[F.lit(float(v)) for v in table])

    def one(e: Column) -> Column:
        return F.get(F.transform(F.array(F.size(F.filter(tab, lambda v: v > e))), lambda at: _placed(e, at, tab, rows)), F.lit(0))

    return F.get(F.transform(F.array(elev), one), F.lit(0))


def _placed(e: Column, at: Column, tab: Column, rows: int) -> Column:
    """row_of() an elevation, if `at` rows of the table lie above it."""
    first, last = F.get(tab, F.lit(0)), F.get(tab, F.lit(rows - 1))
    half = F.abs(first - last) / max(rows - 1, 1) / 2
    hi, lo = F.get(tab, at - 1), F.get(tab, at)
    inner = F.rint(at - 1 + (hi - e) / F.nullif(hi - lo, F.lit(0.0))).cast("int")
    return F.when((e > first + half) | (e < last - half), -1).when(e >= first, 0).when(e <= last, rows - 1).otherwise(inner)


def scale_intensity(points: DataFrame, col: str = "inten", most: float = 1.5) -> DataFrame:
    """Intensities of a frame whose greatest exceeds `most` are bytes: they are divided by 255."""
    on = [*drive(points), "frame"]
    top = points.groupBy(*on).agg(F.max(col).alias("_top"))  # a row a frame
    scaled = F.when(F.col("_top") > most, F.col(col) / 255).otherwise(F.col(col))
    return points.join(top, on).withColumn(col, scaled).select(*points.columns)


def overlay_sample(points: DataFrame, most: int = 12_000, seed: str = "overlay") -> DataFrame:
    """At most `most` points of each frame: those of the least hash, the same in every run."""
    order = Window.partitionBy(*drive(points), "frame").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("pid").cast("string"))), "pid", "x", "y")
    return points.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).drop("_k")
