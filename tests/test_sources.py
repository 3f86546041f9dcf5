"""Loaders on files written for the test, the simulator, archives behind HTTP, published files, the network."""

import base64
import functools
import http.server
import json
import struct
import threading
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticore.models import unet
from latticore.operators import binning, derive, fusion, publish, rangeimage
from latticore.sources import kitti, nuscenes, raycast, remote, sweeps


def matrix(yaw, x, y, z):
    m = np.eye(4)
    m[:2, :2] = [[np.cos(yaw), -np.sin(yaw)], [np.sin(yaw), np.cos(yaw)]]
    m[:3, 3] = x, y, z
    return m


def test_kitti_scans_and_labels(spark, tmp_path):
    rng = np.random.default_rng(4)
    for d in ("velodyne", "labels"):
        (tmp_path / d).mkdir()
    pts = rng.normal(size=(500, 4)).astype("<f4") * 5
    raw = rng.choice([40, 10, 252, 99, 7], 500).astype("<u4") | (7 << 16)
    pts.tofile(tmp_path / "velodyne/000003.bin")
    raw.tofile(tmp_path / "labels/000003.label")
    got = {r.pid: r for r in kitti.frames(spark, str(tmp_path)).collect()}
    keep = np.hypot(pts[:, 0], pts[:, 1]) > 1.0
    assert set(got) == set(np.nonzero(keep)[0])
    want = {40: (0, False), 10: (7, False), 252: (7, True), 99: (5, False), 7: (-1, False)}
    assert all((got[k].label, got[k].moving) == want[int(raw[k] & 0xFFFF)] for k in got)


def test_kitti_drive(spark, tmp_path):
    """Calibration and poses are undone: the same still points stand at the same places of the world in every scan."""
    for d in ("velodyne", "labels"):
        (tmp_path / d).mkdir()
    rng = np.random.default_rng(5)
    tr = matrix(0.4, 0.3, -0.1, 0.2)
    world = np.c_[rng.uniform(-15, 15, (200, 2)), rng.uniform(0, 2, 200), np.ones(200)]  # in the first scan's ego frame
    up = np.eye(4)
    up[2, 3] = kitti.HEIGHT
    poses, ego = [], []
    for f in range(5):
        e = matrix(0.05 * f, 1.5 * f, 0.2 * f, 0)
        ego.append(e)
        poses.append(tr @ np.linalg.inv(up) @ e @ up @ np.linalg.inv(tr))  # camera pose whose ego pose is e
        own = (np.linalg.inv(e @ up) @ world.T).T
        np.c_[own[:, :3], np.full(200, 0.5)].astype("<f4").tofile(tmp_path / f"velodyne/{f:06d}.bin")
        np.full(200, 40, "<u4").tofile(tmp_path / f"labels/{f:06d}.label")
    line = lambda m: " ".join(f"{v:.12f}" for v in m[:3].ravel())
    (tmp_path / "poses.txt").write_text("\n".join(map(line, poses)) + "\n")
    (tmp_path / "calib.txt").write_text(f"P0: {line(np.eye(4))}\nTr: {line(tr)}\n")
    assert kitti.read_poses(spark, f"{tmp_path}/poses.txt").count() == 5
    assert np.allclose(kitti.read_calib(spark, f"{tmp_path}/calib.txt").first().tr, tr.ravel())
    pts, frames, chosen = kitti.drive_frames(spark, str(tmp_path), stride=3, seq="08")
    got = {r.frame: np.array(r.pose).reshape(4, 4) for r in frames.collect()}
    assert all(np.allclose(got[f], ego[f], atol=1e-9) for f in range(5))
    assert sorted(r.frame for r in chosen.collect()) == [0, 3] and sorted(r.frame for r in pts.select("frame").distinct().collect()) == [0, 1, 2, 3]
    w = binning.world(pts, frames).filter("frame = 3").collect()
    assert len(w) > 150 and all(np.allclose((r.wx, r.wy, r.wz), world[r.pid, :3], atol=1e-4) for r in w)
    assert all(0 <= r.ring < 64 and r.label == 0 for r in w)
    f = rangeimage.features(binning.world(pts, frames), frames.join(chosen, ["seq", "frame"], "left_semi"), sensor=(0.0, 0.0, kitti.HEIGHT)).filter("frame = 3")
    assert f.count() > 100 and f.filter("f6 > 0.2").count() < 0.1 * f.count()
    assert kitti.scan_path("/r", "08", 7) == "/r/dataset/sequences/08/velodyne/000007.bin" and kitti.scan_path("/r", "08", 7, True).endswith("labels/000007.label")
    assert sorted(r.frame for r in kitti.selected_scans(spark, 10, 4).collect()) == [0, 4, 8]


@pytest.fixture(scope="module")
def nusc(spark, tmp_path_factory):
    """Two keyframes with sweeps between, a turned world, a sensor turned by 90 degrees, laser ids out of order, a car that moves."""
    root = tmp_path_factory.mktemp("nusc")
    rng = np.random.default_rng(6)
    (root / "v").mkdir()
    (root / "sweeps").mkdir()
    quat = lambda yaw: [float(np.cos(yaw / 2)), 0.0, 0.0, float(np.sin(yaw / 2))]
    calib = matrix(-np.pi / 2, 0.9, 0.0, 1.8)
    t = {"scene": [{"token": "s1", "name": "scene-0103", "first_sample_token": "k0", "last_sample_token": "k1", "nbr_samples": 2}, {"token": "s2", "name": "scene-0061", "first_sample_token": "", "last_sample_token": "", "nbr_samples": 0}]}
    t["sample"] = [{"token": f"k{i}", "timestamp": 500_000 * i, "scene_token": "s1", "prev": f"k{i - 1}" if i else "", "next": f"k{i + 1}" if i < 1 else ""} for i in range(2)]
    t["sensor"] = [{"token": "lid", "channel": "LIDAR_TOP", "modality": "lidar"}, {"token": "cam", "channel": "CAM", "modality": "camera"}]
    t["calibrated_sensor"] = [{"token": "c1", "sensor_token": "lid", "translation": [0.9, 0.0, 1.8], "rotation": quat(-np.pi / 2)}, {"token": "c2", "sensor_token": "cam", "translation": [0.0, 0.0, 0.0], "rotation": quat(0)}]
    t["category"] = [{"token": f"cat{i}", "name": n, "index": i} for i, n in enumerate(nuscenes.LABELS)]
    t["attribute"] = [{"token": "a1", "name": "vehicle.moving"}, {"token": "a2", "name": "vehicle.parked"}]
    t["ego_pose"], t["sample_data"], t["lidarseg"] = [], [], []
    lasers, elev = rng.permutation(8), np.linspace(-20, 5, 8)
    places = {}
    for k in range(6):  # records at 10 Hz; 0 and 5 are keyframes
        pose = matrix(0.6 + 0.02 * k, 400 + k, 1200 + 0.3 * k, 0)
        t["ego_pose"].append({"token": f"e{k}", "timestamp": 100_000 * k, "translation": pose[:3, 3].tolist(), "rotation": quat(0.6 + 0.02 * k)})
        az, who = rng.uniform(-np.pi, np.pi, 300), rng.integers(0, 8, 300)
        d = rng.uniform(4, 30, 300)
        e = np.radians(elev[who])
        own = np.c_[d * np.cos(e) * np.cos(az), d * np.cos(e) * np.sin(az), d * np.sin(e)]
        own[0] = [0.1, 0.1, 0.0]  # too close
        np.c_[own, np.full(300, 200.0 if k == 0 else 1.0), lasers[who]].astype("<f4").tofile(root / f"sweeps/{k}.bin")
        places[k] = own, who, pose
        key = k in (0, 5)
        t["sample_data"].append({"token": f"d{k}", "sample_token": "k0" if k < 5 else "k1", "ego_pose_token": f"e{k}", "calibrated_sensor_token": "c1", "timestamp": 100_000 * k, "is_key_frame": key, "filename": f"sweeps/{k}.bin", "prev": f"d{k - 1}" if k else "", "next": f"d{k + 1}" if k < 5 else ""})
        if key:
            np.full(300, 17, np.uint8).tofile(root / f"sweeps/{k}_lidarseg.bin")
            t["lidarseg"].append({"token": f"l{k}", "sample_data_token": f"d{k}", "filename": f"sweeps/{k}_lidarseg.bin"})
    box = (places[5][2] @ calib @ [*places[5][0][9], 1])[:3]  # around point 9 of the last keyframe
    t["instance"] = [{"token": "i1", "category_token": "cat17"}, {"token": "i2", "category_token": "cat17"}]
    t["sample_annotation"] = [
        {"token": "n0", "sample_token": "k0", "instance_token": "i1", "attribute_tokens": [], "translation": (box - [2, 0, 0]).tolist(), "size": [2.0, 4.0, 2.0], "rotation": quat(0.3), "prev": "", "next": "n1"},
        {"token": "n1", "sample_token": "k1", "instance_token": "i1", "attribute_tokens": [], "translation": box.tolist(), "size": [2.0, 4.0, 2.0], "rotation": quat(0.3), "prev": "n0", "next": ""},
        {"token": "n2", "sample_token": "k1", "instance_token": "i2", "attribute_tokens": ["a2"], "translation": (box + [9, 9, 0]).tolist(), "size": [2.0, 4.0, 2.0], "rotation": quat(0), "prev": "", "next": ""},
        {"token": "n3", "sample_token": "k1", "instance_token": "i2", "attribute_tokens": ["a1"], "translation": (box + [90, 0, 0]).tolist(), "size": [2.0, 4.0, 2.0], "rotation": quat(0), "prev": "", "next": ""},
    ]
    for name, rows in t.items():
        (root / "v" / f"{name}.json").write_text(json.dumps(rows))
    return str(root), places, calib, elev, lasers


def test_nuscenes_tables(spark, nusc):
    t = nuscenes.load(spark, nusc[0], "v")
    assert set(t) == set(nuscenes.TABLES)
    assert [r.name for r in nuscenes.scene_names(t, "mini_val").collect()] == ["scene-0103"] and nuscenes.scene_names(t).count() == 2
    own = spark.createDataFrame([("x", "scene-0061")], "split string, name string")
    assert [r.name for r in nuscenes.scene_names(t, "x", own).collect()] == ["scene-0061"]
    with pytest.raises(ValueError):
        nuscenes.scene_names(t, "train")
    chain = nuscenes.walk(t["sample"], t["scene"].filter("first_sample_token <> ''").select(F.col("token").alias("scene_token"), F.col("first_sample_token").alias("token")))
    assert [(r.token, r.place) for r in chain.orderBy("place").collect()] == [("k0", 0), ("k1", 1)]
    assert sorted(tuple(r) for r in nuscenes.steps_back(t["sample_data"]).filter("token in ('d5', 'd3', 'd0')").collect()) == [("d3", 2, "d1"), ("d5", 2, "d3"), ("d5", 4, "d1")]
    ann = {r.token: r for r in nuscenes.annotations(t).collect()}
    assert ann["n1"].speed == pytest.approx(4.0) and ann["n1"].moving and ann["n0"].speed == pytest.approx(4.0)
    assert ann["n2"].speed is None and not ann["n2"].moving and ann["n3"].moving and {a.cls for a in ann.values()} == {7}
    assert nuscenes.ring_count(t, nusc[0]) == 8


def test_nuscenes_frames(spark, nusc):
    root, places, calib, elev, lasers = nusc
    t = nuscenes.load(spark, root, "v")
    points, frames, earlier = nuscenes.frames(t, root, rows=8)
    got = {(r.frame, r.pid): r for r in points.collect()}
    assert len(got) == 598 and {f for f, _ in got} == {"d0", "d5"}
    for k in (0, 5):
        own, who, _ = places[k]
        for p in range(1, 300, 17):
            r = got[f"d{k}", p]
            assert (r.x, r.y, r.z) == pytest.approx(tuple((calib @ [*own[p], 1])[:3]), abs=1e-4)
            assert r.ring == 7 - who[p] and r.label == 7 and r.inten == pytest.approx(200 / 255 if k == 0 else 1.0)
    assert got["d5", 9].moving and sum(r.moving for r in got.values()) < 20
    pose = {r.frame: r for r in frames.collect()}
    assert np.allclose(pose["d5"].pose, places[5][2].ravel(), atol=1e-9) and pose["d5"].sensor == pytest.approx([0.9, 0, 1.8])
    back = earlier.groupBy("frame", "step").count().collect()
    assert sorted(tuple(r) for r in back) == [("d5", 2, 299), ("d5", 4, 299)]
    w = earlier.filter("step = 2").collect()
    want = (places[3][2] @ calib @ np.c_[places[3][0], np.ones(300)].T).T[1:, :3]
    assert np.allclose(sorted(r.x for r in w), sorted(want[:, 0]), atol=1e-3)


def test_labels_by_the_fixed_order(spark, nusc):
    files = spark.createDataFrame([("d0", "sweeps/0_lidarseg.bin")], "token string, filename string")
    assert {r.label for r in nuscenes.read_labels(files, nusc[0]).collect()} == {7}


def test_cache_is_resumable_and_described(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("b", 1, 5), ("b", 1, 4)], "seq string, frame int, pid long")
    count = lambda d: {r.seq: r.n for r in d.collect()}
    assert count(sweeps.append_missing(df.filter("seq = 'a'"), f"{tmp_path}/c")) == {"a": 1}
    assert count(sweeps.append_missing(df, f"{tmp_path}/c")) == {"b": 3} and count(sweeps.append_missing(df, f"{tmp_path}/c")) == {}
    assert spark.read.parquet(f"{tmp_path}/c").count() == 4
    assert [(k, [r.pid for r in rows]) for k, rows in sweeps.iterate(f"{tmp_path}/c", spark)] == [(("a", 1), [1]), (("b", 1), [4, 5]), (("b", 2), [1])]
    assert count(sweeps.count_frames(spark, f"{tmp_path}/c")) == {"a": 1, "b": 2}
    sweeps.write_index(spark, f"{tmp_path}/c", "nuscenes")
    info = sweeps.read_index(spark, f"{tmp_path}/c").first()
    assert (info.name, info.n_rows, info.n_cols, info.hz, info.active[2], info.sequences[1].n) == ("nuscenes", 32, 1024, 2.0, False, 2)
    assert sorted((r.seq, r.frame) for r in sweeps.first_frames(df, 1).collect()) == [("a", 1), ("b", 1), ("b", 1)]


def test_simulated_drives(spark, tmp_path):
    points, frames = raycast.simulate_many(spark, [3, 4], n_frames=2, rows=16, columns=128)
    points = points.cache()
    assert frames.count() == 4 and {r.seq for r in points.select("seq").distinct().collect()} == {"sim3", "sim4"}
    one = points.filter("seq = 'sim3'").toPandas()
    assert one["inten"].between(0, 1).all() and one["label"].between(0, 8).all() and (np.sqrt((one[["x", "y"]] ** 2).sum(axis=1)) < 100).all()
    ground = one[(one["label"] == 0)]
    assert len(ground) > 300 and abs(ground["z"].median()) < 0.05
    again, _ = raycast.simulate(spark, 3, n_frames=2, rows=16, columns=128)
    assert again.select(F.sum("inten"), F.count("*")).first() == points.filter("seq = 'sim3'").select(F.sum("inten"), F.count("*")).first()
    files = raycast.save_npz(points, frames, f"file://{tmp_path}/npz")
    back = raycast.load_npz(spark.createDataFrame(files.collect(), files.schema))
    assert back.count() == points.count()
    both = back.alias("a").join(points.alias("b"), ["seq", "frame", "pid"])
    assert both.filter("abs(a.x - b.x) > 0.05 or a.label <> b.label or a.moving <> b.moving or a.ring <> b.ring").count() == 0


def test_markings_are_bright(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0), (4.5, 0.05)], "x double, y double")
    m = [(0.0, -0.1, 3.0, 0.1), (4.0, -0.1, 6.0, 0.1)]
    assert [r.on for r in df.select(raycast.on_markings(F.col("x"), F.col("y"), m).alias("on")).collect()] == [True, False, True]
    s = raycast.street(5)
    assert {x.cls for x in s.solids} == set(range(1, 9)) and len(s.holes) == 8 and s.markings
    assert all(not (a < s.cross < b) for a, _, b, _ in s.markings)


class Handler(http.server.SimpleHTTPRequestHandler):
    fails, seen = 0, []

    def log_message(self, *args):
        pass

    def do_GET(self):
        kind = self.headers.get("Range")
        Handler.seen.append(kind)
        if Handler.fails:
            Handler.fails -= 1
            return self.send_error(503)
        if not kind:
            return super().do_GET()
        a, b = map(int, kind.removeprefix("bytes=").split("-"))
        data = open(self.translate_path(self.path), "rb").read()[a : b + 1]
        self.send_response(206)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    at = tmp_path_factory.mktemp("www")
    rng = np.random.default_rng(1)
    files = {"x/a.bin": rng.bytes(5000), "x/b.bin": rng.bytes(3000), "c.txt": b"text"}
    with zipfile.ZipFile(at / "z.zip", "w") as z:
        for n, d in files.items():
            z.writestr(n, d)
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Handler, directory=str(at)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/z.zip", files
    server.shutdown()


def test_members_by_range(archive):
    url, files = archive
    assert dict(remote.members(url)) == {n: len(d) for n, d in files.items()}
    Handler.fails = 2
    with remote.open_zip(url, pause=0.01, ahead=512) as z:
        assert z.read("x/b.bin") == files["x/b.bin"]
    Handler.fails = 9
    with pytest.raises((OSError, zipfile.BadZipFile)):
        remote.open_zip(url, pause=0.001, tries=2)
    Handler.fails = 0
    with pytest.raises(OSError):
        remote.open_zip(url.replace("z.zip", "none.zip"), pause=0.01)
    with pytest.raises(ValueError):
        remote.RangeFile("file:///etc/passwd")


def test_members_in_parallel(spark, archive, tmp_path):
    url, files = archive
    wanted = spark.createDataFrame(remote.members(url), "name string, size long")
    folder = f"file://{tmp_path}/out"
    with pytest.raises(OSError):
        remote.fetch(wanted, url, folder, room=100)
    assert remote.fetch(wanted.filter("name like 'x/%'"), url, folder, tasks=2, room=10_000).count() == 2
    assert [r.name for r in remote.missing(wanted, folder).collect()] == ["c.txt"]
    assert remote.fetch(wanted, url, folder, tasks=2).count() == 1
    assert all((tmp_path / "out" / n).read_bytes() == d for n, d in files.items())
    with pytest.raises(Exception, match="leaves the folder"):
        remote.fetch(spark.createDataFrame([("../e", 1)], "name string, size long"), url, folder, pause=0.01).count()


def test_published_files(spark, tmp_path):
    small = ((0.5, 2.0), (1.0, 4.0))
    frames = spark.createDataFrame([(1, 0.0, 0.0)], "frame int, ex double, ey double")
    pts = spark.createDataFrame([(1, k, x, y, 0.2, c, m) for k, (x, y, c, m) in enumerate([(0.1, 0.1, 0, False), (1.9, -1.9, 5, False), (-3.5, 3.5, 7, True)])], "frame int, pid long, x double, y double, z double, cls int, moving boolean")
    origins = binning.window_origins(frames, small)
    stats = binning.bin_points(binning.assign(binning.world(pts, frames), small))
    bits = derive.tile_bits(derive.derive(fusion.fuse(stats, origins, small)), binning.dynamic_cells(stats))
    imgs = {r.tier: r for r in publish.tiles(bits, origins, small).collect()}
    assert [(t, r.n, len(r.rgb)) for t, r in sorted(imgs.items())] == [(0, 8, 192), (1, 8, 192)]
    at = lambda t, i, j: tuple(imgs[t].rgb[3 * (8 * (7 - i) + 7 - j) :][:3])  # noqa: E731  both axes run backwards
    assert at(0, 4, 4)[0] & 15 == 1 and at(0, 7, 0)[0] & 15 == 6 and at(1, 0, 7)[0] & 31 == 8 | 16 and at(0, 0, 0) == (0, 0, 0)
    truth = publish.truth_bits(stats).filter("frame = 1").drop("frame")
    assert {r.r for r in truth.filter("tier = 1").collect()} == {1, 6, 8 | 16}
    named = publish.tiles(bits, origins, small).select(F.concat(F.lit("t"), F.col("tier").cast("string")).alias("name"), "n", "rgb")
    out = publish.write_png(named, f"file://{tmp_path}/png")
    raw = (tmp_path / "png/t0.png").read_bytes()
    assert out.count() == 2 and raw[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", raw[16:24]) == (8, 8)
    n = struct.unpack(">I", raw[33:37])[0]
    lines = zlib.decompress(raw[41 : 41 + n])
    assert b"".join(lines[25 * k + 1 : 25 * (k + 1)] for k in range(8)) == imgs[0].rgb
    assert publish.write_png(named, "x", "none") is None and publish.write_png(named, f"file://{tmp_path}/b", "async").count() == 2
    with pytest.raises(ValueError):
        publish.write_png(named, "x", "later")
    o = publish.overlay(pts, most=2).first()
    data = base64.b64decode(o.blob)
    assert (o.start, o.n, len(data)) == (0, 2, 10)
    kept = sorted(rangeimage.overlay_sample(pts, 2).collect(), key=lambda r: r.pid)
    assert np.frombuffer(data[:4], "<i2").tolist() == [round(r.x * 100) for r in kept] and data[8:] == bytes(r.cls + 16 * r.moving for r in kept)
    summary = spark.createDataFrame([(1, 2.5)], "frames int, fps double").withColumn("bad", publish.finite(F.lit(float("nan")))).withColumn("x", publish.finite(F.lit(0.12345)))
    publish.write_metrics(f"{tmp_path}/metrics", summary, spark.createDataFrame([(2, 5), (1, 4)], "frame int, points int"))
    got = spark.read.json(f"{tmp_path}/metrics").first()
    assert got.summary.fps == 2.5 and got.summary.x == 0.1234 and "bad" not in got.summary.asDict() and [f.frame for f in got.frames] == [1, 2]


def test_training_rows_and_network(spark, tmp_path):
    points, frames = raycast.simulate(spark, 2, n_frames=2, rows=8, columns=32)
    w = binning.world(points, frames).cache()
    rows = publish.training_rows(w, frames, 8, 32, (0.0, 0.0, raycast.HEIGHT)).cache()
    assert rows.count() == 16
    r = rows.filter("frame = 1 and row = 6").first()
    assert len(r.x) == 8 and {len(c) for c in r.x} == {32} and len(r.y) == len(r.m) == len(r.r) == 32
    assert all((v == 1) == (y >= 0) == (g > 0) for v, y, g in zip(r.x[5], r.y, r.r))
    assert unet.parameters() == 327_434 and unet.widths_for(2.0) == (32, 64, 128, 192)
    weights = unet.random_weights(1, (4, 6, 8, 10))
    path = f"file://{tmp_path}/w.npz"
    unet.save(weights, path)
    assert all((unet.load(path)[k] == v).all() for k, v in weights.items())
    active = [c != 2 for c in range(9)]
    got = unet.infer(rows, path, active).cache()
    assert got.count() == 2 * 8 * 32 and got.filter("abs(aggregate(probs, 0D, (a, b) -> a + b) - 1) > 1e-5 or probs[2] > 0 or p_move not between 0 and 1").count() == 0
    painted = rangeimage.paint(rangeimage.project(w, rows=8, width=32, sensor=(0.0, 0.0, raycast.HEIGHT)), got)
    assert painted.filter("probs is null").count() == 0
    bad = dict(weights)
    bad["e2.kernel"] = bad["e2.kernel"][:, :1]
    unet.save(bad, f"file://{tmp_path}/bad.npz")
    with pytest.raises(ValueError):
        unet.load(f"file://{tmp_path}/bad.npz")


def test_convolution_by_hand():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 5, 6)).astype(np.float32)
    w = {"k.kernel": rng.normal(size=(2, 3, 3, 3)).astype(np.float32), "k.scale": np.array([1.5, 0.5]), "k.shift": np.array([0.1, -0.2]), "k.mean": np.array([0.3, 0.1]), "k.variance": np.array([2.0, 0.5])}
    got = unet._block(x, w, "k")
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    for o in range(2):
        for i in range(5):
            for j in range(6):
                v = (p[:, i : i + 3, j : j + 3] * w["k.kernel"][o]).sum()
                want = max((v - w["k.mean"][o]) / np.sqrt(w["k.variance"][o] + 1e-5) * w["k.scale"][o] + w["k.shift"][o], 0)
                assert got[o, i, j] == pytest.approx(want, abs=1e-4)
    assert unet._grow(unet._pool(x, 2), x).shape == (3, 5, 6)
