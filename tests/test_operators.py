import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from latticore.functions import scalar as S
from latticore.operators import binning, derive, fusion, metrics, objects
from latticore.schema import tiers
from latticore.sources import kitti, raycast, sweeps
from latticore.streaming import live


def test_half_precision(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=2000) * 10.0 ** rng.integers(-7, 5, 2000), [0.0, 65504.0, 1e-8, -6e-8]])
    v = v[np.abs(v) < 65519]
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = [r.h for r in df.select(S.f16(F.col("v")).alias("h")).collect()]
    assert np.array_equal(np.array(got), v.astype(np.float16).astype(np.float64))


def test_profiles():
    assert [t.n for t in tiers("spec")] == [400, 400] and [t.ratio for t in tiers("graded")] == [1, 2, 10]
    for bad in (((0.05, 10.0), (0.12, 100.0)), ((0.05, 10.0), (0.5, 5.0)), ((0.05, 10.2), (0.5, 100.0))):
        with pytest.raises(ValueError):
            tiers(bad)


def test_conservation_and_nesting_on_boundaries(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(-99.9, 99.9, (3000, 2)) + [3.2, -1.7]
    xy[:200, 0], xy[200:400, 1], xy[400:900] = 10.0, -11.7, np.round(xy[400:900] / 0.05) * 0.05 * 0.1
    df = spark.createDataFrame([(1, i, float(a), float(b), 0.1, False, int(i % 9), 3.2, -1.7) for i, (a, b) in enumerate(xy)], "frame int, pid long, wx double, wy double, z double, moving boolean, cls int, ex double, ey double")
    origins = binning.window_origins(df.select("frame", "ex", "ey").distinct())
    stats = binning.bin_points(binning.assign(df)).cache()
    f = np.floor(xy / 0.05).astype(np.int64) // 10 - (np.floor(np.array([3.2, -1.7]) / 0.5).astype(np.int64) - 200)
    assert stats.filter("tier = 1").agg(F.sum("n_pts")).first()[0] == ((f >= 0) & (f < 400)).all(1).sum()
    assert binning.nesting(stats, origins).first()["n_bad"] == 0


def test_fusion_by_replay(spark):
    """One cell over several frames, against a plain sequential replay; an empty frame ages the map."""
    obs = [(1, [(0, 0.10), (0, 0.14), (5, 0.9)]), (2, [(1, 0.2)]), (4, [(0, 0.05), (0, 0.05)])]
    rows = [(fr, 0.02, 0.02, z, c, False, 0.0, 0.0) for fr, pts in obs for c, z in pts]
    df = spark.createDataFrame(rows, "frame int, wx double, wy double, z double, cls int, moving boolean, ex double, ey double")
    frames = spark.createDataFrame([(i, 0.0, 0.0) for i in range(1, 6)], "frame int, ex double, ey double")
    got = fusion.fuse(binning.bin_points(binning.assign(df)), binning.window_origins(frames)).filter("tier = 0").first()
    cls, conf, g = None, 0, None
    for _, pts in obs:
        p = np.bincount([c for c, _ in pts], minlength=9) / len(pts)
        q = 0.3 * p
        if cls is not None:
            q[cls] += 0.7 * conf / 255
        ground = [z for c, z in pts if c < 4]
        new = np.mean(ground)
        g = float(np.float16(new if g is None else 0.7 * g + 0.3 * new))
        cls, conf = int(q.argmax()), int(q.max() / q.sum() * 255)
    assert (got.cls, got.conf, got.ground, got.age, got["count"]) == (cls, conf, g, 1, 2)


def test_painted_objects(spark):
    """A truck, a far pole that is too old, a coarse copy that the fine window covers, and a walker that moves."""
    u, v = np.cos(-0.3), np.sin(-0.3)
    at = lambda k: (k + 0.5) * 0.05
    inside = lambda x, y: abs((x + 5.2) * u + (y - 3.1) * v) <= 3.25 and abs((y - 3.1) * u - (x + 5.2) * v) <= 1.15
    cells = [(1, 0, i, j, 7, 0, 2.4, False) for i in range(-200, 200) for j in range(-200, 200) if inside(at(i), at(j))]
    cells += [(1, 1, -10, 6, 7, 0, 2.4, True), (1, 1, 90, -70, 6, 3, 1.0, False), (1, 1, 91, -70, 6, 3, 1.0, False)]
    df = spark.createDataFrame(cells, "frame int, tier int, ci long, cj long, eff_cls int, age int, z_max double, covered boolean")
    dyn = spark.createDataFrame([(1, 0, 60, -33, 8, False), (1, 0, 60, -32, 8, False)], "frame int, tier int, ci long, cj long, cls int, covered boolean")
    got = {r.cls: r for r in objects.extract(df, dyn).collect()}
    truck = got[7]
    assert (truck.x, truck.y, truck.length, truck.width, truck.yaw) == pytest.approx((-5.2, 3.1, 6.5, 2.3, -0.3), abs=0.12) and not truck.moving
    assert got[8].moving and got[8].z_top is None and 6 not in got
    assert (got[8].x, got[8].y) == pytest.approx((3.025, -1.6)) and {r.cls for r in objects.reported(objects.extract(df, dyn)).collect()} == {7}
    assert objects.pack(objects.extract(df, dyn)).filter("cls = 7").first().length == pytest.approx(6.5, abs=0.12)


def test_matching(spark):
    p = spark.createDataFrame([(1, 7, 0.0, 0.0, 1), (1, 7, 1.0, 0.0, 2), (1, 8, 5.0, 5.0, 3)], "frame int, cls int, x double, y double, pid int")
    g = spark.createDataFrame([(1, 7, 0.9, 0.0, 1), (1, 7, 1.6, 0.0, 2), (1, 8, 6.0, 5.0, 3)], "frame int, cls int, x double, y double, gid int")
    assert sorted((r.pid, r.gid) for r in objects.match(p, g).collect()) == [(2, 1)]


def test_latency_and_late_frames(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([900, 900, 10, 20, 30, 40])], "frame int, ms double")
    r = metrics.latency(df).first()
    assert (r.p50, r["mean"], r.fps) == (25.0, 25.0, 40.0)
    done, skipped = live.paced_late_frames([0.05] * 3 + [0.45] + [0.05] * 6, 0.1)
    assert skipped == 3 and len(done) == 7


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.write.parquet(f"{tmp_path}/in")
    stream = live.rates(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.start, r.event_type, r.n, round(r.total, 4)) for r in df.collect())
    assert key(spark.table("rates")) == key(live.rates(ev))


def test_dilation_and_entry(spark):
    assert derive.dilate(spark.createDataFrame([(0, 0)], "ci long, cj long")).count() == 13
    assert __spark_entry__.entry(spark).count() > 0


def test_rays_of_plain_scenes(spark):
    beams = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0), (1, 0, 0.0, 0.0, -1.0), (2, 0, -1.0, 0.0, 0.0), (3, 0, 0.6, 0.0, -0.8)], "row int, col int, dx double, dy double, dz double")
    empty = {r.row: r.range for r in raycast.cast(beams, [], [(0.0, 0.0, 0.5, 0.1)], (0.0, 0.0, 2.0)).collect()}
    assert empty == {0: None, 1: pytest.approx(2.1), 2: None, 3: pytest.approx(2.5)}
    scene = [raycast.Solid(0, 7, 1, 10.0, -1.0, 0.0, 12.0, 1.0, 3.0, vx=2.0), raycast.Solid(1, 8, 2, -5.0, 0.0, 1.0, 0.0, 3.0), raycast.Solid(2, 4, 3, 30.0, 0.0, 2.0, 4.0)]
    got = {r.row: (r.range, r.cls, r.inst, r.moving) for r in raycast.cast(beams, scene, (), (0.0, 0.0, 2.0), t=0.5).collect()}
    assert got[0] == (pytest.approx(11.0), 7, 1, True) and got[2] == (pytest.approx(4.0), 8, 2, False) and got[1] == (pytest.approx(2.0), 0, 0, False)
    assert raycast.beam_table(spark).count() == raycast.BEAMS * raycast.COLUMNS
