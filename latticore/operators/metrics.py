"""Scores: confusion, IoU, recall, quantiles, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import band
from ..schema import DRIVABLE, drive


def confusion(points: DataFrame, keys: tuple[str, ...] = ("band",)) -> DataFrame:
    """points(keys, gt, pred) -> counts; rows without a truth are out."""
    return points.filter("gt >= 0").groupBy(*keys, "gt", "pred").agg(F.count("*").alias("n"))


def with_band(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return points.withColumn("band", band(F.hypot(x, y))).filter("band is not null")


def iou(conf: DataFrame) -> DataFrame:
    """conf(gt, pred, n) -> (cls, tp, fp, fn, iou); null where the class occurs nowhere.  One explode, one aggregation."""
    both = conf.select(F.explode(F.array(F.struct(F.col("gt").alias("cls"), F.lit(0).alias("side")), F.struct(F.col("pred").alias("cls"), F.lit(1).alias("side")))).alias("s"), "n", (F.col("gt") == F.col("pred")).alias("hit"))
    g = both.groupBy("s.cls").agg(
        F.sum(F.when(F.col("hit") & (F.col("s.side") == 0), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("hit") & (F.col("s.side") == 1), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~F.col("hit") & (F.col("s.side") == 0), F.col("n")).otherwise(0)).alias("fn"),
    )
    return g.withColumn("iou", F.col("tp") / F.nullif(F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)))


def binary_iou(conf: DataFrame, classes, keys: tuple[str, ...] = ()) -> DataFrame:
    g, p = F.col("gt").isin(*classes), F.col("pred").isin(*classes)
    both, either = F.sum(F.when(g & p, F.col("n")).otherwise(0)), F.sum(F.when(g | p, F.col("n")).otherwise(0))
    return conf.groupBy(*keys).agg((both / F.greatest(either, F.lit(1))).alias("iou"))


def moving_iou(points: DataFrame, keys: tuple[str, ...] = ("band",)) -> DataFrame:
    p, g = F.col("moving"), F.col("gt_moving")
    return points.filter("label >= 0").groupBy(*keys).agg((F.count_if(p & g) / F.nullif(F.count_if(p | g), F.lit(0))).alias("iou"), F.count("*").alias("n"))


def warm(times: DataFrame, order: str = "frame", skip: int = 2) -> DataFrame:
    """times without the first `skip` rows by `order` (which tells rows apart), where there are more than one beyond them.

    Only the first rows are sorted out; the table is not."""
    head = times.select(F.col(order).alias("_o")).orderBy("_o").limit(skip + 2).agg(F.sort_array(F.collect_list("_o")).alias("_h"))
    cut = head.select(F.when(F.size("_h") > skip + 1, F.get("_h", F.lit(skip - 1))).alias("_cut"))  # one row
    return times.crossJoin(F.broadcast(cut)).filter(F.col("_cut").isNull() | (F.col(order) > F.col("_cut"))).drop("_cut")


def latency(times: DataFrame, order: str = "frame", value: str = "ms", accuracy: int | None = None) -> DataFrame:
    """p50, p95, p99 (linear interpolation), mean and fps without the first two frames where there are over three.

    Exact percentiles hold every distinct value; with `accuracy` they err by 1 / accuracy of the rows at most and hold little."""
    q = lambda p: F.percentile(value, F.lit(p)) if accuracy is None else F.percentile_approx(value, p, accuracy)
    return warm(times, order).agg(q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.avg(value).alias("mean"), (1000 / F.nullif(F.avg(value), F.lit(0.0))).alias("fps"))


def stage_means(times: DataFrame, stage: str, order: list[str], value: str, skip: int = 2) -> DataFrame:
    """Mean of each stage without its first `skip` rows: (stage, mean, n)."""
    w = Window.partitionBy(stage).orderBy(*order)
    return times.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") > skip).groupBy(F.col(stage).alias("stage")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


#: Rows whose values are added up by themselves before they join a window's sum.
RUN = 16


def _added(value: Column, by: Window, width: int) -> Column:
    """Sum of the last `width` values of the key up to each row: the rows before the window's first whole run of RUN, its whole runs, the rows after them, added in this order.

    `_i` is the row's place in its key, `_p` the same counted from the begin of the key's first run, `_b` the run; `_run` and `_rest` are the sums of the row's run and of it from the row on."""
    o, cut = F.col("_p") % RUN, F.col("_p") != F.col("_i")  # cut: the key's first run is a part of one
    told = lambda c: F.coalesce(c, F.lit(0.0))
    first = F.first("_run").over(by.rowsBetween(Window.unboundedPreceding, 0))
    inside = (o < width - 1) & (F.pmod(o - (width - 1), F.lit(RUN)) != 0)
    out = told(F.when((F.col("_i") < width - 1) & (F.col("_b") > 0) & cut, first).when((F.col("_i") >= width - 1) & inside, F.lag("_rest", width - 1).over(by)))
    for back in range((width - 1) // RUN, 0, -1):
        here = (o + RUN * back <= width - 1) & (F.col("_b") - back >= F.when(cut, 1).otherwise(0))
        out = out + told(F.when(here, F.lag("_run", RUN * back).over(by)))
    whole = (o == RUN - 1) & F.lit(width >= RUN)
    for back in range(min(RUN, width) - 1, -1, -1):
        out = out + told(F.when(~whole & (o >= back), F.lag(value, back).over(by) if back else value))
    return out + told(F.when(whole, F.col("_run")))


def rolling(times: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str, width: int = 200, skip: int = 0, at: str | None = None) -> DataFrame:
    """times with p50, p95, p99, mean and fps of the last `width` rows of the key up to each, its first `skip` rows left out.

    The mean's sum takes whole runs of RUN rows at once; with `at`, the key's first row stands at that place of its first run (a column, 0 to RUN - 1)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - (skip + 1)
    kept = times.withColumn("_i", place).filter(F.col("_i") >= 0).withColumn("_p", F.col("_i") + (F.col(at) if at else 0)).withColumn("_b", F.floor(F.col("_p") / RUN))
    v, run, by = F.col(value).cast("double"), Window.partitionBy(*keys, "_b").orderBy(*order), Window.partitionBy(*keys).orderBy("_b", *order)
    ahead = Window.unboundedFollowing
    kept = kept.withColumns({"_run": F.sum(v).over(run.rowsBetween(Window.unboundedPreceding, ahead)), "_rest": F.sum(v).over(run.rowsBetween(0, ahead)), "_n": F.count(v).over(by.rowsBetween(Window.unboundedPreceding, 0))})
    w = by.rowsBetween(1 - width, 0)
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.5, 0.95, 0.99)])).over(w)  # one count of a frame's values for all three
    n = F.col("_n") - F.coalesce(F.lag("_n", width).over(by), F.lit(0))
    out = kept.withColumns({"_q": q, "mean": _added(v, by, width) / F.nullif(n, F.lit(0))})
    out = out.withColumns({c: F.get("_q", F.lit(k)) for k, c in enumerate(("p50", "p95", "p99"))} | {"fps": 1000 / F.nullif(F.col("mean"), F.lit(0.0))})
    return out.select(*times.columns, "p50", "p95", "p99", "mean", "fps")


def recent(times: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], n: int = 100) -> DataFrame:
    """The last n rows of each key, for a display's history."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return times.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def top_confusions(conf: DataFrame, k: int = 2) -> DataFrame:
    w = Window.partitionBy("gt").orderBy(F.desc("n"), "pred")
    return conf.filter("gt <> pred and n > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def precision_recall(counts: DataFrame) -> DataFrame:
    """counts(cls, tp, fp, fn) with precision, recall and f1, null where undefined."""
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)))


def voxels(points: DataFrame, size: float = 0.05, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    v = F.struct(*[F.floor(F.col(c) / F.lit(size)) for c in ("wx", "wy", "wz" if "wz" in points.columns else "z")])
    return points.groupBy(*keys).agg(F.countDistinct(v).alias("voxels")).withColumn("bytes", F.col("voxels") * 10)


def diagnostics(false_detections: DataFrame, size: str = "n_cells") -> DataFrame:
    """Per class: false detections, their shares near a true object of the same and of another class, quartiles of their sizes."""
    share = lambda c: F.avg(F.col(c).cast("int")).alias(c if c == "other_class" else "fragments")
    q = [F.percentile(size, F.lit(p)).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return false_detections.groupBy("cls").agg(F.count("*").alias("n"), share("fragment"), share("other_class"), *q)


def evaluation(points: DataFrame) -> DataFrame:
    """points(x, y, gt, pred, moving, gt_moving) with a truth -> one row a band, and one (band null) for all points:
    points, moving ones' tp and union, and confusion counts as an array of structs.  Unlike moving_iou(), the total has no limit of range."""
    own = points.filter("gt >= 0").withColumn("band", band(F.hypot("x", "y")))
    # a point beyond the last band has a null band already: it counts in the total once
    both = own.filter("band is not null").withColumn("_b", F.col("band")).unionByName(own.withColumn("_b", F.lit(None).cast("int")))
    p, g = F.col("moving"), F.col("gt_moving")
    cells = both.groupBy(F.col("_b").alias("band"), "gt", "pred").agg(F.count("*").alias("n"), F.count_if(p & g).alias("tp"), F.count_if(p | g).alias("either"))
    return cells.groupBy("band").agg(F.sum("n").alias("n"), F.sum("tp").alias("moving_tp"), F.sum("either").alias("moving_either"), F.array_sort(F.collect_list(F.struct("gt", "pred", "n"))).alias("confusion"))


def flag_rate(cells: DataFrame, frames: DataFrame, reach: float = 10.0, bit: int = 8) -> DataFrame:
    """cells(tier, ci, cj, eff_cls, age, flags) of derive(): drivable cells of the finest tier within `reach` seen in the last frame, and the share that carries the flag."""
    own = near_ego(cells, frames, reach).filter(F.col("eff_cls").isin(*DRIVABLE) & (F.col("age") == 0))
    hit = F.col("flags").bitwiseAND(bit) > 0
    return own.agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), (F.count_if(hit) / F.nullif(F.count("*"), F.lit(0))).alias("rate"))


def near_ego(cells: DataFrame, frames: DataFrame, reach: float) -> DataFrame:
    """Cells of the finest tier, with their centres cx, cy, nearer than `reach` to the last frame's ego position."""
    on = drive(cells)
    last = frames.groupBy(*on).agg(F.max(F.struct("frame", "ex", "ey")).alias("_e"))
    own = cells.filter("tier = 0").withColumn("cx", (F.col("ci") + 0.5) * 0.05).withColumn("cy", (F.col("cj") + 0.5) * 0.05)
    own = own.join(last, on) if on else own.crossJoin(F.broadcast(last))  # one row
    dx, dy = F.col("cx") - F.col("_e.ex"), F.col("cy") - F.col("_e.ey")
    return own.filter(dx * dx + dy * dy < reach * reach).drop("_e")


def recall(targets: DataFrame, flagged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """targets(by, ci, cj) that lie within two moves along the axes of flagged(ci, cj) cells: n, hits and their share."""
    from .derive import dilate

    on = [*drive(targets), "ci", "cj"]
    near = dilate(flagged.select(*on)).withColumn("_hit", F.lit(True))
    t = targets.join(near, on, "left")
    return t.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("_hit").alias("hits"), (F.count_if("_hit") / F.nullif(F.count("*"), F.lit(0))).alias("recall"))


def in_holes(cells: DataFrame, holes: DataFrame, side: float = 2.0, share: float = 0.7) -> DataFrame:
    """cells(cx, cy, ...) within `share` of the radius of holes(hole, hx, hy, r), once a hole: an equi-join on a lattice of `side` metres, then the distance."""
    span = lambda c: F.sequence(F.floor((F.col(c) - F.col("r")) / side), F.floor((F.col(c) + F.col("r")) / side))
    h = holes.withColumn("_i", F.explode(span("hx"))).withColumn("_j", F.explode(span("hy")))
    c = cells.withColumn("_i", F.floor(F.col("cx") / side)).withColumn("_j", F.floor(F.col("cy") / side))
    dx, dy = F.col("cx") - F.col("hx"), F.col("cy") - F.col("hy")
    return c.join(h, ["_i", "_j"]).filter(dx * dx + dy * dy < (F.col("r") * share) * (F.col("r") * share)).drop("_i", "_j")


def on_curb(cells: DataFrame, at: float = 7.0, cross: float = 0.0, clear: float = 8.0, cell: float = 0.05) -> DataFrame:
    """cells(cx, cy) within a cell of a curb, which runs `at` metres each side of the x axis and is broken around the crossing street."""
    return cells.filter((F.abs(F.abs(F.col("cy")) - at) < cell) & (F.abs(F.col("cx") - cross) > clear))
