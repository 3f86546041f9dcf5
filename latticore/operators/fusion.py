"""Temporal fusion of per-frame cell statistics into the persistent map.

The fold is not linear (class and confidence are quantised at each step), so a cell's observations
are folded in frame order; cells are independent, which is what partitions the work.  A cell's
history has at most one entry a frame.

Scrolling: what was seen before the window last left a cell is forgotten, and cells outside the last
window are dropped.  A window is a product of two intervals, so a cell came into it last when the later
of its row and its column did; those entries are few (as many as coarse rows are driven past), and
observations before them are filtered away before anything is shuffled by cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import argmax, f16, floor_div, u8
from ..schema import CLASSES, GROUND, UNKNOWN, drive, tiers

N = len(CLASSES)
STATE = "struct<cls:int,conf:int,gcls:int,ground:double,rough:double,z_min:double,z_max:double,count:int,clear:int,seen:int>"
START = '{"cls":255,"conf":0,"gcls":15,"count":0,"clear":255,"seen":0}'
LAYERS = ("cls", "conf", "gcls", "ground", "rough", "z_min", "z_max", "count", "clear")
OBSERVED = ("frame", "p", "g", "ground", "rough", "z_min", "z_max", "zmin_ng", "count")


def observations(stats: DataFrame) -> DataFrame:
    """Cells with static points, normalised to what the fold needs."""
    total = F.greatest(sum((F.col(f"ps{k}") for k in range(1, N)), F.col("ps0")), F.lit(1e-9))
    p = F.array(*[F.col(f"ps{c}") / total for c in range(N)])
    pg = F.array(*[F.col(f"ps{c}") if c in GROUND else F.lit(0.0) for c in range(N)])
    share = sum((F.col(f"ps{k}") for k in GROUND[1:]), F.col("ps0")) / total
    return stats.filter("n_static > 0").select(
        *drive(stats), "frame", "tier", "ci", "cj", p.alias("p"), F.when(share > 0.05, argmax(pg)).otherwise(15).alias("g"), "ground", "rough", "z_min", "z_max", "zmin_ng", F.least("n_static", F.lit(65535)).cast("int").alias("count")
    )


def step(s, o, a):
    """State after one observation; s and o are structs, a the weight of the new."""
    q = F.transform(o["p"], lambda p, c: p * a + F.when(s["cls"] == c, (1 - a) * (s["conf"] / 255.0)).otherwise(0.0))
    total = F.aggregate(q, F.lit(0.0), lambda x, y: x + y)
    blend = lambda new, old: F.when(new.isNotNull() & old.isNotNull(), (1 - a) * old + a * new).otherwise(F.coalesce(new, old))
    g = blend(o["ground"], s["ground"])
    clear = F.when(o["zmin_ng"].isNotNull() & g.isNotNull(), u8((o["zmin_ng"] - g) / 0.02, 254)).otherwise(UNKNOWN)
    return F.struct(
        argmax(q).alias("cls"),
        u8(F.array_max(q) / F.greatest(total, F.lit(1e-9)) * 255).alias("conf"),
        F.when(o["g"] == 15, s["gcls"]).otherwise(o["g"]).cast("int").alias("gcls"),
        f16(g).alias("ground"),
        f16(blend(o["rough"], s["rough"])).alias("rough"),
        f16(o["z_min"]).alias("z_min"),
        f16(o["z_max"]).alias("z_max"),
        o["count"].cast("int").alias("count"),
        clear.cast("int").alias("clear"),
        o["frame"].cast("int").alias("seen"),
    ).cast(STATE)


def _start():
    return F.from_json(F.lit(START), STATE[7:-1].replace(":", " ")).cast(STATE)


def _alpha(profile):
    out = F.when(F.lit(False), 0.0)
    for t in tiers(profile):
        out = out.when(F.col("tier") == t.tier, t.alpha)
    return out


def entries(origins: DataFrame, origin: str) -> DataFrame:
    """(seq, tier, at, entered): frames, ascending, in which a coarse row (origin 'oi') or column ('oj') came into the window after the drive's first frame."""
    key = [*drive(origins), "tier"]
    w = Window.partitionBy(*key).orderBy("frame")
    low, n = floor_div(F.col(origin), F.col("per_coarse")), 2 * F.col("half_coarse")
    o = origins.select(*key, "frame", low.alias("low"), (low + n - 1).alias("high")).withColumn("was", F.lag("low").over(w)).withColumn("wash", F.lag("high").over(w))
    new = F.when(F.col("low") > F.col("was"), F.sequence(F.greatest(F.col("wash") + 1, F.col("low")), F.col("high"))).when(F.col("low") < F.col("was"), F.sequence(F.col("low"), F.least(F.col("was") - 1, F.col("high"))))
    return o.withColumn("at", F.explode(new)).groupBy(*key, "at").agg(F.array_sort(F.collect_list("frame")).alias("entered"))


def _placed(cells: DataFrame, origins: DataFrame, profile) -> DataFrame:
    """cells with `ri` and `rj`, the frames in which their row and their column came into the window (null: with the first)."""
    key = [*drive(cells), "tier"]
    per = F.when(F.lit(False), 1)
    for t in tiers(profile):
        per = per.when(F.col("tier") == t.tier, t.per_coarse)
    c = cells.withColumn("_gi", floor_div(F.col("ci"), per)).withColumn("_gj", floor_div(F.col("cj"), per))
    for index, origin in (("i", "oi"), ("j", "oj")):
        c = c.join(entries(origins, origin).withColumnRenamed("at", f"_g{index}").withColumnRenamed("entered", f"r{index}"), [*key, f"_g{index}"], "left")
    return c.drop("_gi", "_gj")


def fuse(stats: DataFrame, origins: DataFrame, profile="spec", last: int | None = None) -> DataFrame:
    """The map after frame `last` (default: each drive's last): one row a known cell.

    Ages count frames of `origins`, so sweeps without points age the map too."""
    key = [*drive(stats), "tier"]
    o = origins if last is None else origins.filter(F.col("frame") <= last)
    end = o.groupBy(*key).agg(F.max(F.struct("frame", "oi", "oj", "n", "ord")).alias("end"))
    obs = observations(stats)
    obs = _placed(obs if last is None else obs.filter(F.col("frame") <= last), o, profile).join(end, key)
    inside = (F.col("ci") - F.col("end.oi")).between(0, F.col("end.n") - 1) & (F.col("cj") - F.col("end.oj")).between(0, F.col("end.n") - 1)
    since = lambda r: F.coalesce(F.element_at(r, -1), F.lit(-(1 << 30)))
    obs = obs.filter(inside & (F.col("frame") >= since("ri")) & (F.col("frame") >= since("rj")))
    cells = obs.groupBy(*key, "ci", "cj").agg(F.array_sort(F.collect_list(F.struct(*OBSERVED))).alias("obs"), F.max("end.ord").alias("end"))
    got = cells.withColumn("s", F.aggregate("obs", _start(), lambda s, x: step(s, x, _alpha(profile))))
    place = o.select(*key, F.col("frame").alias("_seen"), "ord")
    got = got.withColumn("_seen", F.col("s.seen")).join(place, [*key, "_seen"])
    return got.select(*key, "ci", "cj", *[f"s.{c}" for c in LAYERS], F.least(F.col("end") - F.col("ord"), F.lit(UNKNOWN)).cast("int").alias("age"))


def history(stats: DataFrame, origins: DataFrame, profile="spec") -> DataFrame:
    """Every state of every cell: (seq, tier, ci, cj, frame, until, layers), valid from its frame up to, not with, `until`.

    `until` is the next observation, or the frame after which the window has left the cell and come
    back, or null.  A cell that the window has left stands on to its next entry: at_frame() tests the window."""
    key = [*drive(stats), "tier"]
    obs = _placed(observations(stats), origins, profile)
    came = lambda r: F.coalesce(F.array_max(F.filter(r, lambda f: f <= F.col("frame"))), F.lit(-(1 << 30)))
    nxt = lambda r: F.array_min(F.filter(r, lambda f: f > F.col("frame")))
    obs = obs.withColumn("epoch", F.greatest(came("ri"), came("rj"))).withColumn("gone", F.least(nxt("ri"), nxt("rj")))
    cells = obs.groupBy(*key, "ci", "cj", "epoch").agg(F.array_sort(F.collect_list(F.struct(*OBSERVED))).alias("obs"), F.min("gone").alias("gone"))
    none = F.array().cast(f"array<{STATE}>")
    states = F.aggregate("obs", none, lambda done, x: F.concat(done, F.array(step(F.coalesce(F.try_element_at(done, F.lit(-1)), _start()), x, _alpha(profile)))))
    rows = cells.select(*key, "ci", "cj", "gone", states.alias("s")).select(*key, "ci", "cj", "gone", "s", F.posexplode("s").alias("k", "now"))
    until = F.coalesce(F.get("s", F.col("k") + 1)["seen"], F.col("gone"))
    return rows.select(*key, "ci", "cj", F.col("now.seen").alias("frame"), until.alias("until"), *[f"now.{c}" for c in LAYERS])


def at_frame(states: DataFrame, origins: DataFrame, frame: int) -> DataFrame:
    """The map of one frame from history(): the same as fuse(last=frame)."""
    key = [*drive(states), "tier"]
    o = origins.filter(F.col("frame") <= frame)
    end = o.groupBy(*key).agg(F.max(F.struct("frame", "oi", "oj", "n", "ord")).alias("end"))
    now = states.filter((F.col("frame") <= frame) & (F.col("until").isNull() | (F.col("until") > frame))).join(end, key)
    inside = (F.col("ci") - F.col("end.oi")).between(0, F.col("end.n") - 1) & (F.col("cj") - F.col("end.oj")).between(0, F.col("end.n") - 1)
    got = now.filter(inside).join(o.select(*key, "frame", "ord"), [*key, "frame"])
    return got.select(*key, "ci", "cj", *LAYERS, F.least(F.col("end.ord") - F.col("ord"), F.lit(UNKNOWN)).cast("int").alias("age"))


def advance(old: DataFrame | None, stats: DataFrame, window: DataFrame, profile="spec") -> DataFrame:
    """The map after one more sweep: old(tier, ci, cj, layers, age) merged with the sweep's statistics in its window(tier, oi, oj, n).

    One full join by cell: cells outside the window go, observed ones take a step and are of age 0, others
    age by one; a sweep without points ages all.  The same as fuse() frame by frame; for live views."""
    key = [*drive(stats), "tier", "ci", "cj"]
    obs = observations(stats).select(*key, F.struct(*OBSERVED).alias("o"))
    if old is None:
        both = obs.withColumn("s", _start()).withColumn("_old", F.lit(None).cast("int"))
    else:
        state = F.struct(*[F.col(c) for c in LAYERS], F.lit(0).alias("seen")).cast(STATE)
        both = old.select(*key, state.alias("_s"), F.col("age").alias("_old")).join(obs, key, "full").withColumn("s", F.coalesce("_s", _start())).drop("_s")
    inside = (F.col("ci") - F.col("oi")).between(0, F.col("n") - 1) & (F.col("cj") - F.col("oj")).between(0, F.col("n") - 1)
    both = both.join(window.select(*key[:-2], "oi", "oj", "n"), key[:-2]).filter(inside)
    now = both.withColumn("s", F.when(F.col("o").isNotNull(), step(F.col("s"), F.col("o"), _alpha(profile))).otherwise(F.col("s")))
    age = F.when(F.col("o").isNotNull(), 0).otherwise(F.least(F.col("_old") + 1, F.lit(UNKNOWN)))
    return now.select(*key, *[f"s.{c}" for c in LAYERS], age.cast("int").alias("age"))


def epochs(stats: DataFrame, origins: DataFrame, profile="spec") -> DataFrame:
    """observations() with `epoch`, the frame in which the cell last came into the window: a state of another epoch is forgotten."""
    obs = _placed(observations(stats), origins, profile)
    came = lambda r: F.coalesce(F.array_max(F.filter(r, lambda f: f <= F.col("frame"))), F.lit(-1))
    return obs.withColumn("epoch", F.greatest(came("ri"), came("rj"))).drop("ri", "rj")
