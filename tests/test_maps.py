"""Maps of drives: two drives, scrolling there and back, every frame's map in four ways, planes and holes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticore.operators import binning, derive, fusion, metrics, objects, rangeimage
from latticore.schema import tiers
from latticore.streaming import live

SMALL = ((0.5, 2.0), (1.0, 4.0))
LAYERS = [*fusion.LAYERS, "age"]


def drive(seq, seed, path, n=60):
    """Points about an ego that moves along `path`; frame 4 has none."""
    rng = np.random.default_rng(seed)
    rows, frames = [], []
    for f, (x, y) in enumerate(path, 1):
        frames.append((seq, f, float(x), float(y)))
        for k in range(n if f != 4 else 0):
            px, py = rng.uniform(-5, 5, 2)
            rows.append((seq, f, k, float(px), float(py), float(rng.normal(0, 0.3)), int(rng.integers(9)), bool(rng.random() < 0.1)))
    return rows, frames


@pytest.fixture(scope="module")
def drives(spark):
    out, back = [(k * 1.1, k * 0.4) for k in range(6)], [(5.5 - k * 1.3, 2.0 - k * 0.5) for k in range(6)]
    a, fa = drive("a", 1, out + back)
    b, fb = drive("b", 2, [(0.0, 0.0)] * 5)
    points = spark.createDataFrame(a + b, "seq string, frame int, pid long, x double, y double, z double, cls int, moving boolean")
    frames = spark.createDataFrame(fa + fb, "seq string, frame int, ex double, ey double")
    return points.cache(), frames.cache()


def key(df, drop=()):
    cols = [c for c in ["seq", "tier", "ci", "cj", *LAYERS] if c in df.columns and c not in drop]
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=str)


def stats_of(points, frames):
    return binning.bin_points(binning.assign(binning.world(points, frames), SMALL))


def test_drives_stay_apart(drives):
    points, frames = drives
    both = key(fusion.fuse(stats_of(points, frames), binning.window_origins(frames, SMALL), SMALL))
    one = []
    for s in "ab":
        p, f = points.filter(F.col("seq") == s), frames.filter(F.col("seq") == s)
        alone = fusion.fuse(stats_of(p.drop("seq"), f.drop("seq")), binning.window_origins(f.drop("seq"), SMALL), SMALL)
        one += key(alone.withColumn("seq", F.lit(s)))
    assert both == sorted(one, key=str) and len({r[0] for r in both}) == 2
    steps = derive.steps(fusion.fuse(stats_of(points, frames), binning.window_origins(frames, SMALL), SMALL))
    assert steps.count() == len(both)


def test_every_frame_in_four_ways(spark, drives, tmp_path):
    """fuse(last), history, advance sweep by sweep and a plain replay agree, where the window leaves cells and comes back."""
    points, frames = (d.filter("seq = 'a'") for d in drives)
    stats = stats_of(points, frames).cache()
    origins = binning.window_origins(frames, SMALL).cache()
    states = fusion.history(stats, origins, SMALL).cache()
    alphas = [t.alpha for t in tiers(SMALL)]
    size = [t.n for t in tiers(SMALL)]
    obs = fusion.observations(stats).collect()
    place = {(r.frame, r.tier): (r.oi, r.oj) for r in origins.collect()}
    plain, now, forgot = {}, None, 0
    for f in range(1, 13):
        for cell in list(plain):
            oi, oj = place[f, cell[0]]
            if not (0 <= cell[1] - oi < size[cell[0]] and 0 <= cell[2] - oj < size[cell[0]]):
                del plain[cell]
                forgot += 1
        for r in obs:
            if r.frame == f:
                plain[r.tier, r.ci, r.cj] = live.step(plain.get((r.tier, r.ci, r.cj)), live._Seen(type("O", (), {**r.asDict(), "n": r["count"]})), alphas[r.tier])
        want = sorted((("a", *c, *[round(s[k], 9) if isinstance(s[k], float) else s[k] for k in fusion.LAYERS], f - s["seen"]) for c, s in plain.items()), key=str)
        fusion.advance(now, stats.filter(F.col("frame") == f), origins.filter(F.col("frame") == f), SMALL).coalesce(1).write.parquet(f"{tmp_path}/{f}")
        now = spark.read.parquet(f"{tmp_path}/{f}")
        assert key(now) == want, f
        if f in (4, 12):
            assert key(fusion.fuse(stats, origins, SMALL, last=f)) == want, f
            assert key(fusion.at_frame(states, origins, f)) == want, f
    assert forgot > 20


def test_keyed_state_in_a_stream(spark, drives, tmp_path):
    points, frames = drives
    origins = binning.window_origins(frames, SMALL)
    stats = stats_of(points, frames)
    seen = fusion.epochs(stats, origins, SMALL).select("seq", "tier", "ci", "cj", "frame", "epoch", "p", "g", "ground", "rough", "z_min", "z_max", "zmin_ng", "count").cache()
    for low, high in ((1, 5), (6, 8), (9, 12)):
        seen.filter(F.col("frame").between(low, high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    import glob, os

    for k, name in enumerate(sorted(glob.glob(f"{tmp_path}/in/*.parquet"), key=os.path.getmtime)):
        os.utime(name, (k + 1, k + 1))
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.cell_state(stream, SMALL).writeStream.format("memory").queryName("cells").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("cells")
    last = got.groupBy("seq", "tier", "ci", "cj").agg(F.max_by(F.struct(*got.columns), "seen").alias("s")).select("s.*")
    want = fusion.fuse(stats, origins, SMALL)
    here = want.select("seq", "tier", "ci", "cj")
    assert key(last.join(here, ["seq", "tier", "ci", "cj"]), ("age",)) == key(want, ("age",))


def test_live_view_of_a_file_stream(spark, drives, tmp_path):
    points, frames = drives
    a = points.filter("seq = 'a'")
    for f in (1, 2, 3, 5):
        a.filter(F.col("frame") == f).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    import glob, os

    for k, name in enumerate(sorted(glob.glob(f"{tmp_path}/in/*.parquet"), key=os.path.getmtime)):
        os.utime(name, (k + 1, k + 1))
    view = live.LiveMap(spark, frames, f"{tmp_path}/work", SMALL)
    live.start(view, live.sensor(spark, f"{tmp_path}/in", a.schema.simpleString()[7:-1].replace(":", " ")), f"{tmp_path}/ck").awaitTermination()
    some = frames.filter("seq = 'a' and frame in (1, 2, 3, 5)")
    want = fusion.fuse(stats_of(a.filter("frame in (1, 2, 3, 5)"), some), binning.window_origins(some, SMALL), SMALL)
    assert key(view.map) == key(want)
    got = view.state()
    assert (got["seq"], got["frame"], got["processed"], got["late"]) == ("a", 5, 4, 0) and set(got["latency_ms"]) == {"p50", "p95", "p99", "mean", "fps"} and len(view.totals) == 2
    assert view.cue() == [5, 3] and view.layers().count() == want.count() and view.objects().count() >= 0
    view.sweep(a.limit(0), "a", 6)  # an empty sweep ages the map
    assert view.map.agg(F.min("age")).first()[0] == 1
    view.batch(points.filter("seq = 'b' and frame = 1"))  # another drive starts anew
    assert view.state()["seq"] == "b" and {r.seq for r in view.map.select("seq").distinct().collect()} == {"b"}


def test_pacing_skips_late_sweeps(spark, drives):
    points, frames = drives
    times = iter([0.0, 0.0, 0.0, 0.0, 0.35, 0.36, 0.36, 0.45, 0.45, 0.5, 0.6])
    pace = live.Pace(0.1)
    assert [pace.take(t) for t in (0.0, 0.1, 0.55, 0.56, 0.57, 0.58, 0.6)] == [True, True, False, False, False, True, True] and pace.late == 3
    assert next(times) == 0.0


def plain_planes(cells, block=5, half=10):
    """Reference and scatter of each cell by a least-squares fit over all cells of its window of blocks."""
    at = {}
    for i, j, z in cells:
        at.setdefault((i // block, j // block), []).append(z)
    out = {}
    for bi, bj in at:
        rows = [(a - bi, b - bj, z) for (a, b), zs in at.items() if abs(a - bi) <= half and abs(b - bj) <= half for z in zs]
        if len(rows) <= 0.05 * ((2 * half + 1) * block) ** 2:
            continue
        x = np.array([(1, u, v) for u, v, _ in rows], float)
        z = np.array([r[2] for r in rows])
        w = np.linalg.lstsq(x, z, rcond=None)[0]
        out[bi, bj] = w, np.sqrt(np.mean((z - x @ w) ** 2))
    return {(i, j): (w @ [1, (i % block - 2) / block, (j % block - 2) / block], s) for i, j, _ in cells if (i // block, j // block) in out for w, s in [out[i // block, j // block]]}


def road(shift=0):
    rng = np.random.default_rng(4)
    cells = []
    for i in range(-70, 70):
        for j in range(-60, 60):
            if rng.random() < 0.6:
                hole = (i - 20) ** 2 + (j + 10) ** 2 <= 49
                cells.append((i + shift, j, 0.002 * i - 0.001 * j + rng.normal(0, 0.004) - (0.12 if hole else 0.0), hole))
    return cells


def test_ground_plane_by_least_squares(spark):
    cells = road()
    want = plain_planes([c[:3] for c in cells])
    df = spark.createDataFrame([("a", c[0], c[1], float(c[2])) for c in cells] + [("b", c[0], c[1], 5.0) for c in cells[:3000]], "seq string, ci long, cj long, ground double")
    got = {(r.seq, r.ci, r.cj): (r.ref, r.sigma) for r in derive.ground_plane(df).collect()}
    for i, j, *_ in cells[::37]:
        assert got["a", i, j] == pytest.approx(want[i, j], abs=1e-7)
    assert all(abs(v[0] - 5) < 1e-9 for k, v in got.items() if k[0] == "b" and v[0] is not None)


def test_holes_are_found_and_slopes_are_not(spark):
    cells = road()
    df = spark.createDataFrame([(c[0], c[1], float(c[2])) for c in cells], "ci long, cj long, ground double")
    low = {(r.ci, r.cj) for r in derive.depressions(derive.ground_plane(df)).filter("depression").collect()}
    holes = {(c[0], c[1]) for c in cells if c[3]}
    assert len(low & holes) >= 0.4 * len(holes) and not low - holes


def test_holes_cost(spark):
    rows = [(0, c[0], c[1], 0, 255, 0, float(c[2]), 0.0, 0.0, 0.0, 1, 255, 0) for c in road()]
    cells = spark.createDataFrame(rows, "tier int, ci long, cj long, cls int, conf int, gcls int, ground double, rough double, z_min double, z_max double, count int, clear int, age int")
    got = derive.derive(cells)
    low = got.filter("depression")
    assert low.count() > 20 and low.filter("cost < 170 or flags & 8 = 0").count() == 0
    ego = spark.createDataFrame([(1, 1.0, -0.5)], "frame int, ex double, ey double")
    rate = metrics.flag_rate(got, ego, 3.0).first()
    assert 0 < rate.hits < rate.n and rate.rate == rate.hits / rate.n
    holes = spark.createDataFrame([(1, 1.0, -0.5, 0.35)], "hole int, hx double, hy double, r double")
    seen = metrics.recall(metrics.in_holes(metrics.near_ego(got, ego, 10.0), holes), low, ("hole",)).first()
    assert seen.n > 20 and seen.recall > 0.9


def test_still_points_leave_no_residual(spark):
    """Points that stand still in the world: seen from a later pose, with rotation, they lie where they did."""
    rng = np.random.default_rng(3)
    rows, poses = [], []
    world = rng.uniform(-20, 20, (3000, 3)) * [1, 1, 0.15]
    for f in range(1, 4):
        c, s = np.cos(0.2 * f), np.sin(0.2 * f)
        m = np.array([[c, -s, 0, 2.0 * f], [s, c, 0, -f], [0, 0, 1, 0.1 * f], [0, 0, 0, 1]])
        poses.append((f, m.ravel().tolist()))
        own = (np.linalg.inv(m) @ np.c_[world, np.ones(len(world))].T).T[:, :3]
        elev = np.degrees(np.arctan2(own[:, 2], np.hypot(own[:, 0], own[:, 1])))
        ring = np.clip(np.floor((30 - elev) / 60 * 64), 0, 63).astype(int)
        rows += [(f, k, *map(float, own[k]), 0.5, int(ring[k])) for k in range(len(own))]
    points = spark.createDataFrame(rows, "frame int, pid long, x double, y double, z double, inten double, ring int")
    frames = spark.createDataFrame(poses, "frame int, pose array<double>")
    w = binning.world(points, frames)
    first = w.filter("pid = 7").select("wx", "wy", "wz").collect()
    assert all(tuple(r) == pytest.approx(tuple(world[7])) for r in first)
    f = rangeimage.features(w, frames).filter("frame = 3").toPandas()
    assert len(f) > 2000 and (f["f6"] < 0.05).mean() > 0.85 and f["f6"].between(0, 1).all()
    raw = rangeimage.features(w.withColumns({"wx": F.col("x"), "wy": F.col("y"), "wz": F.col("z")}), frames.withColumn("pose", F.lit(None).cast("array<double>")))
    assert raw.filter("f6 > 0 or f7 > 0").count() == 0  # without a pose nothing is compared


def test_images_about_the_sensor(spark):
    df = spark.createDataFrame([(1, 1, 3.0, 0.0, 1.73, 0.5, 0, 7, True), (1, 2, 0.1, 0.0, 1.73, 0.5, 0, 7, True), (1, 3, 5.0, 0.0, 1.73, 0.5, 0, 3, False)], "frame int, pid long, x double, y double, z double, inten double, ring int, label int, moving boolean")
    px = rangeimage.nearest(rangeimage.project(df, sensor=(0.0, 0.0, 1.73))).collect()
    assert [(r.row, r.col, r.pid, r.range) for r in px] == [(0, 512, 1, 3.0)]
    img = {r.row: r for r in rangeimage.label_image(df, rows=2, sensor=(0.0, 0.0, 1.73)).collect()}
    assert len(img) == 2 and img[0].labels[512] == 7 and img[0].moving[512] and sum(v != -1 for v in img[0].labels + img[1].labels) == 1


def test_scores_of_matched_objects(spark):
    cols = "frame int, cls int, x double, y double, moving boolean, n_cells long, area double"
    pred = spark.createDataFrame([(1, 7, 0.0, 0.0, True, 9, 2.0, 1), (1, 7, 4.0, 0.0, False, 5, 0.3, 2), (1, 6, 10.0, 0.0, False, 3, 0.02, 3), (1, 8, 40.0, 0.0, True, 3, 0.1, 4)], cols + ", pid long")
    truth = spark.createDataFrame([(1, 7, 0.4, 0.0, True, 8, 2.0, 1), (1, 8, 0.0, 9.0, False, 4, 0.1, 2)], cols + ", gid long")
    ego = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "frame int, ex double, ey double")
    p, g = objects.in_range(pred, ego), objects.in_range(truth, ego)
    found = objects.match(p, g)
    assert {r.cls: (r.tp, r.fp, r.fn) for r in objects.object_counts(p, g, found).collect()} == {6: (0, 1, 0), 7: (1, 1, 0), 8: (0, 0, 1)}
    assert tuple(objects.moving_agreement(p, g, found).first()) == (1, 1.0)
    sweep = {(r.cls, r.min_area): (r.tp, r.fp, r.fn) for r in objects.area_sweep(p, g).collect()}
    assert sweep[7, 0.2] == (1, 1, 0) and sweep[7, 0.5] == (1, 0, 0) and sweep[7, 3.0] == (0, 0, 1) and (6, 0.3) not in sweep
    near = {r.pid: (r.fragment, r.other_class) for r in objects.near_truth(p, truth).collect()}
    assert near == {1: (True, False), 2: (False, False), 3: (False, False)}
    assert {r.frame: r.n for r in objects.per_frame(p, ego).collect()} == {1: 3, 2: 0}
    assert {(r.cls, r.kind): r.median_cells for r in objects.median_sizes(p, g, found).collect()} == {(7, "tp"): 9, (7, "fp"): 5, (6, "fp"): 3, (8, "fn"): 4}


def test_evaluation_bundle(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0, 0, False, False), (30.0, 0.0, 7, 8, True, True), (200.0, 0.0, 7, 7, True, False), (2.0, 0.0, -1, 7, True, True)], "x double, y double, gt int, pred int, moving boolean, gt_moving boolean")
    got = {r.band: r for r in metrics.evaluation(df).collect()}
    assert {b: (r.n, r.moving_tp, r.moving_either) for b, r in got.items()} == {0: (1, 0, 0), 2: (1, 1, 1), None: (3, 1, 2)}
    assert [tuple(c) for c in got[None].confusion] == [(0, 0, 1), (7, 7, 1), (7, 8, 1)]


def test_augmentation_and_masks(spark):
    from latticore.functions import scalar as S
    from latticore.operators import training

    pts = spark.createDataFrame([(f, 1.0, 2.0, 3.0, 0.5) for f in range(40)], "frame int, x double, y double, z double, inten double")
    got = training.augment(pts, 3).collect()
    assert all(0.95 <= r.x <= 1.05 and r.y == pytest.approx(2 * r.x) and 0.4 <= r.inten <= 0.6 for r in got) and len({r.x for r in got}) > 30
    row = spark.createDataFrame([([1.0, 5.0, 2.0], [True, False, True], 0.0)], "x array<double>, on array<boolean>, z double")
    r = row.select(S.softmax(F.col("x"), F.col("on")).alias("p"), S.sigmoid(F.col("z")).alias("s")).first()
    assert r.p[1] == 0 and sum(r.p) == pytest.approx(1) and r.p[2] > r.p[0] and r.s == 0.5
    pixels = spark.createDataFrame([(1, 2, 3, 7)], "frame int, row int, col int, cls int")
    dots = spark.createDataFrame([(1, 2, 3, 5), (1, -1, 3, 6)], "frame int, row int, col int, pid int")
    assert {r.pid: r.cls for r in rangeimage.paint(dots, pixels).collect()} == {5: 7, 6: None}
