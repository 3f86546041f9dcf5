"""Streaming counterparts: a live view by micro-batches, keyed cell state, frame pacing, windowed rates."""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning, derive, fusion, objects
from ..schema import CLASSES, POINTS, tiers


def sensor(spark: SparkSession, folder: str, schema: str = POINTS, files: int = 1) -> DataFrame:
    """A stream of sweeps: so many new files of the folder a micro-batch (a file a frame)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def paced_late_frames(steps: list[float], period: float) -> tuple[list[int], int]:
    """Replay of the pacing rule: a frame later than one period is skipped, not queued.

    steps: processing time of each frame -> (frames processed, frames skipped)."""
    pace, done, now = Pace(period), [], 0.0
    for i, took in enumerate(steps):
        now = max(now, pace.due)
        if pace.take(now):
            now += took
            done.append(i)
    return done, pace.late


class Pace:
    """When the next frame is due, and how many were too late."""

    def __init__(self, period: float, start: float = 0.0):
        self.period, self.due, self.late = period, start, 0

    def take(self, now: float) -> bool:
        """Whether the next frame is to be processed at this time; if not, it is skipped."""
        skip = now - self.due > self.period
        self.late += skip
        self.due += self.period
        return not skip


def rates(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and sums per event-time window; state is dropped behind the watermark.  Batch or stream."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    return src.groupBy(F.window("ts", window).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


class LiveMap:
    """The fused map, derived layers and objects of the newest sweep, kept by foreachBatch.

    Each micro-batch may hold several sweeps; they are taken in order.  The map of the last is a table in
    the folder (which executors share), written anew each time, so that readers see whole maps only and
    a lost executor costs nothing; the two sweeps before are kept for the motion cue; times of the last
    `width` sweeps, the first two left out, give rolling percentiles.  A new seq starts with an empty map.
    With `pace` a sweep that comes too late is skipped and counted."""

    def __init__(self, spark: SparkSession, frames: DataFrame, folder: str, profile="spec", width: int = 200, shown: int = 100, pace: Pace | None = None, clock=time.perf_counter):
        self.spark, self.frames, self.folder, self.profile = spark, frames, folder.rstrip("/"), profile
        self.totals, self.history = deque(maxlen=width), deque(maxlen=shown)
        self.pace, self.clock, self.done = pace, clock, 0
        self.reset()

    def reset(self) -> None:
        self.seq, self.map, self.dynamic, self.before, self.seen = None, None, None, deque(maxlen=2), 0

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:10]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def batch(self, points: DataFrame, batch_id: int = 0) -> None:
        """The handler of foreachBatch."""
        points = points.persist()
        for seq, frame in sorted((r.seq, r.frame) for r in points.select("seq", "frame").distinct().collect()):
            self.sweep(points.filter((F.col("seq") == seq) & (F.col("frame") == frame)), seq, frame)
        points.unpersist()

    def sweep(self, points: DataFrame, seq: str, frame: int) -> None:
        """One sweep, which may hold no points: the map ages all the same."""
        began = self.clock()
        if self.pace is not None and not self.pace.take(began):
            return
        if seq != self.seq:
            self.reset()
            self.seq = seq
        own = self.frames.filter((F.col("seq") == seq) & (F.col("frame") == frame))
        window = binning.window_origins(own, self.profile)
        stats = binning.bin_points(binning.assign(binning.world(points, own), self.profile))
        stats = self._write(stats, "stats")
        self.map = self._write(fusion.advance(self.map, stats, window, self.profile), "map")
        self.dynamic = binning.dynamic_cells(stats)
        self.window = window
        self.before.appendleft((frame, points.select(points.columns)))
        took = (self.clock() - began) * 1000
        self.seen, self.done = self.seen + 1, self.done + 1
        if self.seen > 2:
            self.totals.append(took)
        self.history.append({"seq": seq, "frame": frame, "ms": took})

    def cue(self) -> list[int]:
        """Frames whose sweeps the next one's motion cue has, the newest first."""
        return [f for f, _ in self.before]

    def state(self) -> dict:
        """What a display asks for: the newest frame, rolling latency, counts."""
        t = np.array(self.totals)
        rolling = {f"p{q}": float(np.percentile(t, q)) for q in (50, 95, 99)} | {"mean": float(t.mean()), "fps": float(1000 / t.mean())} if len(t) else {}
        return {"seq": self.seq, "frame": self.history[-1]["frame"] if self.history else None, "processed": self.done, "late": self.pace.late if self.pace else 0, "latency_ms": rolling, "history": list(self.history), "tiers": [t.n for t in tiers(self.profile)]}

    def layers(self) -> DataFrame:
        return derive.derive(self.map)

    def objects(self) -> DataFrame:
        """Reported objects of the newest map."""
        origin = self.window
        on = ["seq", "frame", "tier"]
        place = self.window.select(*on)
        cells = binning.covered(self.layers().join(place, ["seq", "tier"]), origin, self.profile)
        dyn = binning.covered(self.dynamic, origin, self.profile)
        return objects.reported(objects.extract(cells, dyn, self.profile, keys=("seq", "frame")))


def start(live: LiveMap, stream: DataFrame, checkpoint: str, hz: float | None = None):
    """Run the live view over a stream: at the sensor's rate, or (without hz) over all that is there."""
    w = stream.writeStream.foreachBatch(live.batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{1000 / hz:.0f} milliseconds") if hz else w.trigger(availableNow=True)).start()


def step(state: dict | None, o, alpha: float) -> dict:
    """fusion.step() on one observation in plain NumPy, for keyed state."""
    half = lambda v: None if v is None else float(np.float16(v))
    none = lambda v: None if v is None or v != v else float(v)
    s = state or {"cls": 255, "conf": 0, "gcls": 15, "ground": None, "rough": None}
    q = alpha * np.asarray(o.p, float)
    if s["cls"] < len(CLASSES):
        q[s["cls"]] += (1 - alpha) * (s["conf"] / 255.0)
    mix = lambda new, old: (1 - alpha) * old + alpha * new if new is not None and old is not None else old if new is None else new
    g, lowest = mix(none(o.ground), s["ground"]), none(o.zmin_ng)
    clear = 255 if g is None or lowest is None else int(min(max((lowest - g) / 0.02, 0), 254))
    return {
        "cls": int(q.argmax()), "conf": int(min(max(q.max() / max(q.sum(), 1e-9) * 255, 0), 255)), "gcls": int(s["gcls"] if o.g == 15 else o.g), "ground": half(g),
        "rough": half(mix(none(o.rough), s["rough"])), "z_min": half(none(o.z_min)), "z_max": half(none(o.z_max)), "count": int(o.count), "clear": clear, "seen": int(o.frame),
    }


def cell_state(observed: DataFrame, profile="spec", idle_ms: int | None = None) -> DataFrame:
    """A stream of fusion.epochs() folded into keyed state, a row each time a cell is seen: seq, tier, ci, cj and the layers.

    State of an earlier epoch (the window has left the cell since) is forgotten; with `idle_ms`, state that
    nothing has touched for so long in processing time is removed too (such a query goes on without new
    data, so it is not for a trigger that ends).  Observations at or before the last frame seen are dropped."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    alphas = [t.alpha for t in tiers(profile)]
    names = ("cls", "conf", "gcls", "ground", "rough", "z_min", "z_max", "count", "clear", "seen")
    whole = {"cls", "conf", "gcls", "count", "clear", "seen"}
    kinds = ", ".join(f"{n} {'int' if n in whole else 'double'}" for n in names)

    def fold(key, batches: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        epoch, now = (state.get[0], dict(zip(names, state.get[1:], strict=True))) if state.exists else (None, None)
        for o in pd.concat(list(batches)).sort_values("frame").rename(columns={"count": "n"}).itertuples():
            if now is not None and o.frame <= now["seen"]:
                continue
            if epoch != o.epoch:
                epoch, now = int(o.epoch), None
            now = step(now, _Seen(o), alphas[int(key[1])])
        state.update((epoch, *[now[n] for n in names]))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([[*key, *[now[n] for n in names]]], columns=["seq", "tier", "ci", "cj", *names])

    return observed.groupBy("seq", "tier", "ci", "cj").applyInPandasWithState(fold, f"seq string, tier int, ci long, cj long, {kinds}", f"epoch int, {kinds}", "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


class _Seen:
    """An observation's fields under the names of the fold (a tuple has its own `count`)."""

    def __init__(self, o):
        self.p, self.g, self.ground, self.rough, self.z_min, self.z_max, self.zmin_ng, self.count, self.frame = o.p, o.g, o.ground, o.rough, o.z_min, o.z_max, o.zmin_ng, o.n, o.frame
