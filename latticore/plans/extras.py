"""Further queries: simulated sweeps, image rows by elevation, statistics of labels and of object errors.

They register with the catalog; the SQL sides are written apart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import metrics, rangeimage, training
from ..sources import raycast, sweeps
from .catalog import P, _r, _table, query

_SCENE, _HOLES = raycast.drive_scene()
_TIME, _OX, _OY, _OZ = 0.4, 0.0, -2.5, 1.73
_BEAMS = """
WITH b0 AS (SELECT CAST(i // 1024 AS INTEGER) AS row, CAST(i % 1024 AS INTEGER) AS col FROM range(65536) t(i)),
b1 AS (SELECT *, radians(2e0 + row * (-269e-1 / 63)) AS el, radians(18e1 - col * 3515625e-7) AS az FROM b0),
beams AS (SELECT row, col, cos(el) * cos(az) AS dx, cos(el) * sin(az) AS dy, sin(el) AS dz FROM b1)"""


@query(_BEAMS + " SELECT row, col, round(dx, 9) AS dx, round(dy, 9) AS dy, round(dz, 9) AS dz FROM beams")
def beam_table(spark, sf):
    return raycast.beam_table(spark).select("row", "col", *_r(9, "dx", "dy", "dz"))


def _double(v):
    return f"{v!r}::DOUBLE"


_SOLIDS = ", ".join(f"({s.kind}, {s.cls}, {s.inst}, " + ", ".join(_double(getattr(s, n)) for n in ("a", "b", "c", "d", "e", "f", "vx", "vy")) + ")" for s in _SCENE)
_HOLE_ROWS = ", ".join("(" + ", ".join(_double(v) for v in h) + f", {i})" for i, h in enumerate(_HOLES))
_CAST = _BEAMS + f""",
o AS (SELECT *, {_double(_OX)} AS ox, {_double(_OY)} AS oy, {_double(_OZ)} AS oz, CASE WHEN dz < -1e-6 THEN -{_double(_OZ)} / dz END AS tg FROM beams),
holes(hx, hy, r, depth, n) AS (VALUES {_HOLE_ROWS}),
inhole AS (SELECT row, col, arg_max(depth, n) AS depth FROM o JOIN holes ON (ox + tg * dx - hx) ** 2 + (oy + tg * dy - hy) ** 2 < r * r GROUP BY row, col),
solid(kind, cls, inst, a, b, c, d, e, f, vx, vy) AS (VALUES {_SOLIDS}),
moved AS (SELECT *, vx * {_TIME}::DOUBLE AS mx, vy * {_TIME}::DOUBLE AS my FROM solid),
inv AS (SELECT *, 1 / CASE WHEN abs(dx) < 1e-9 THEN 1e-9 ELSE dx END AS ix, 1 / CASE WHEN abs(dy) < 1e-9 THEN 1e-9 ELSE dy END AS iy, 1 / CASE WHEN abs(dz) < 1e-9 THEN 1e-9 ELSE dz END AS iz FROM o),
box AS (
  SELECT row, col, cls, inst, vx, vy, greatest(least((a + mx - ox) * ix, (d + mx - ox) * ix), least((b + my - oy) * iy, (e + my - oy) * iy), least((c - oz) * iz, (f - oz) * iz)) AS t,
    least(greatest((a + mx - ox) * ix, (d + mx - ox) * ix), greatest((b + my - oy) * iy, (e + my - oy) * iy), greatest((c - oz) * iz, (f - oz) * iz)) AS far
  FROM inv, moved WHERE kind = 0),
rnd AS (
  SELECT row, col, cls, inst, vx, vy, kind, a, b, c, d, e, dz, oz, CASE kind WHEN 1 THEN dx * dx + dy * dy ELSE 1 END AS qa,
    dx * (ox - a - mx) + dy * (oy - b - my) + CASE kind WHEN 1 THEN 0 ELSE dz * (oz - c) END AS qb,
    (ox - a - mx) ** 2 + (oy - b - my) ** 2 + CASE kind WHEN 1 THEN -c * c ELSE (oz - c) ** 2 - d * d END AS qc
  FROM o, moved WHERE kind > 0),
root AS (SELECT *, (-qb - sqrt(greatest(qb * qb - qa * qc, 0))) / qa AS t FROM rnd WHERE qb * qb - qa * qc > 0),
hits AS (
  SELECT row, col, (-oz - coalesce(depth, 0)) / dz AS t, 0 AS cls, 0 AS inst, false AS moving FROM o LEFT JOIN inhole USING (row, col) WHERE dz < -1e-6
  UNION ALL SELECT row, col, t, cls, inst, abs(vx) + abs(vy) > 0.3 FROM box WHERE t > 0 AND far >= t
  UNION ALL SELECT row, col, t, cls, inst, abs(vx) + abs(vy) > 0.3 FROM root WHERE t > 0 AND CASE kind WHEN 1 THEN oz + t * dz BETWEEN d AND e ELSE substr(md5('porous:' || row || ':' || col || ':' || inst), 1, 8) >= '5999999a' END),
best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY t, cls, inst) AS rn FROM hits) WHERE rn = 1)"""


def _cast(spark):
    return raycast.cast(raycast.beam_table(spark), _SCENE, _HOLES, (_OX, _OY, _OZ), _TIME)


@query(_CAST + " SELECT row, col, round(t, 6) AS range, cls, inst, moving FROM beams LEFT JOIN best USING (row, col)")
def cast_rays(spark, sf):
    return _cast(spark).select("row", "col", *_r(6, "range"), "cls", "inst", "moving")


@query(_CAST + " SELECT cls, moving, count(*) AS n, round(min(t), 6) AS nearest FROM best WHERE t <= 1e2 AND substr(md5('dropout:' || row || ':' || col), 1, 8) >= '07ae147b' GROUP BY cls, moving")
def simulated_sweep(spark, sf):
    return raycast.returns(_cast(spark)).groupBy("cls", "moving").agg(F.count("*").alias("n"), F.round(F.min("range"), 6).alias("nearest"))


@query("""WITH i AS (SELECT event_id, (event_id % 40) * 1e0 - 20 AS low, (event_id % 40) * 1e0 - 20 + event_id % 23 AS high, (event_id % 7) * 1e0 AS centre FROM events)
SELECT event_id, low, CASE WHEN high <= centre - 75e-1 OR low >= centre + 75e-1 THEN high ELSE centre - 75e-1 END AS high FROM i WHERE high <= centre - 75e-1 OR low >= centre + 75e-1 OR low < centre - 75e-1
UNION ALL SELECT event_id, centre + 75e-1, high FROM i WHERE high > centre + 75e-1 AND low < centre + 75e-1""")
def interval_pieces(spark, sf):
    k = F.col("event_id")
    low = (k % 40).cast("double") - 20
    i = _table(spark, sf, "events").select("event_id", low.alias("low"), (low + k % 23).alias("high"), (k % 7).cast("double").alias("centre"))
    return i.select("event_id", F.explode(raycast.without(F.col("low"), F.col("high"), F.col("centre"))).alias("p")).select("event_id", "p.low", "p.high")


@query(P + """, e AS (SELECT frame, pid, x, y, degrees(atan2(z, sqrt(x * x + y * y))) AS elev FROM pts)
SELECT frame, pid, x, y, CAST(least(greatest(floor((2e0 - elev) / 269e-1 * 64), 0), 63) AS INTEGER) AS row FROM e""")
def rows_fixed(spark, sf):
    elev = F.degrees(F.atan2("z", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))))
    return sweeps.pseudo_points(spark, sf).select("frame", "pid", "x", "y", S.row_fixed(elev).cast("int").alias("row"))


_TABLE = [2.0 - 0.3 * r - 0.002 * r * r for r in range(64)]


@query(P + f""",
tab(row, el) AS (VALUES {', '.join(f'({r}, {_double(v)})' for r, v in enumerate(_TABLE))}),
e AS (SELECT frame, pid, x, y, degrees(atan2(z, sqrt(x * x + y * y))) AS elev FROM pts),
seg AS (SELECT a.row, a.el AS hi, b.el AS lo FROM tab a JOIN tab b ON b.row = a.row + 1),
s AS (SELECT (max(el) - min(el)) / 63 / 2 AS half, max(el) AS up, min(el) AS down FROM tab)
SELECT frame, pid, x, y, CAST(CASE WHEN elev > up + half OR elev < down - half THEN -1 WHEN elev >= up THEN 0 WHEN elev <= down THEN 63 ELSE round_even(row + (hi - elev) / (hi - lo), 0) END AS INTEGER) AS row
FROM s, e LEFT JOIN seg ON elev < hi AND elev >= lo""")
def rows_interpolated(spark, sf):
    elev = F.degrees(F.atan2("z", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))))
    return sweeps.pseudo_points(spark, sf).select("frame", "pid", "x", "y", rangeimage.row_of(elev, _TABLE).alias("row"))


@query(P + " SELECT label, count(*) AS n, count(*) FILTER (gt_moving) AS n_moving, count(*) FILTER (NOT gt_moving) AS n_static FROM pts WHERE label >= 0 GROUP BY label")
def label_statistics(spark, sf):
    return training.label_statistics(sweeps.pseudo_points(spark, sf))


@query("SELECT event_type AS stage, round(avg(value), 7) AS mean, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r > 2 GROUP BY event_type")
def stage_means(spark, sf):
    return metrics.stage_means(_table(spark, sf, "events"), "event_type", ["ts", "event_id"], "value").select("stage", *_r(7, "mean"), "n")


@query(P + """, m AS (SELECT frame, max(inten * 100) AS top FROM pts WHERE frame % 2 = 0 GROUP BY frame)
SELECT p.frame, pid, x, y, round(CASE WHEN frame % 2 = 0 AND top > 1.5 THEN inten * 100 / 255 WHEN frame % 2 = 0 THEN inten * 100 ELSE inten END, 9) AS inten FROM pts p LEFT JOIN m USING (frame)""")
def intensity_scaled(spark, sf):
    raw = F.when(F.col("frame") % 2 == 0, F.col("inten") * 100).otherwise(F.col("inten"))
    return rangeimage.scale_intensity(sweeps.pseudo_points(spark, sf).withColumn("inten", raw)).select("frame", "pid", "x", "y", *_r(9, "inten"))


@query(P + """, k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY md5('overlay:' || pid), pid, x, y) AS r FROM pts)
SELECT frame, pid, x, y FROM k WHERE r <= 12000""")
def overlay_sample(spark, sf):
    return rangeimage.overlay_sample(sweeps.pseudo_points(spark, sf)).select("frame", "pid", "x", "y")
