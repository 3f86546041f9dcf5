"""What a viewer or a trainer reads: tile images, point overlays, metric records, dense training arrays."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import drive, tiers
from . import rangeimage


def tiles(bits: DataFrame, origins: DataFrame, profile="spec", last: int | None = None) -> DataFrame:
    """bits(tier, ci, cj, r, g, b) of derive.tile_bits() -> (seq, tier, n, rgb): each tier's window as bytes, row by row.

    Both axes run against the lattice: the first row and column are the farthest cells.  Cells without a value are black.
    One group is one tier of one drive, which its window bounds (n x n x 3 bytes)."""
    on = [*drive(bits), "tier"]
    o = origins if last is None else origins.filter(F.col("frame") <= last)
    end = o.groupBy(*on).agg(F.max(F.struct("frame", "oi", "oj", "n")).alias("_e")).select(*on, "_e.oi", "_e.oj", "_e.n")
    own = bits.join(end, on).select(*on, "n", (F.col("ci") - F.col("oi")).cast("int").alias("i"), (F.col("cj") - F.col("oj")).cast("int").alias("j"), "r", "g", "b").filter("i between 0 and n - 1 and j between 0 and n - 1")

    def paint(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        img = np.zeros((n, n, 3), np.uint8)
        img[n - 1 - pdf["i"].to_numpy(), n - 1 - pdf["j"].to_numpy()] = pdf[["r", "g", "b"]].fillna(0).to_numpy(np.uint8)
        return pdf[on].iloc[:1].assign(n=n, rgb=[img.tobytes()])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields if f.name in on)
    return own.groupBy(*on).applyInPandas(paint, f"{kinds}, n int, rgb binary")


def truth_bits(stats: DataFrame) -> DataFrame:
    """Tile values of a truth grid's statistics: the class of most points, and 16 for cells with moving ones; no heights or cost."""
    from ..functions.scalar import argmax

    top = argmax(F.array(*[F.col(f"pa{c}") for c in range(9)]))
    on = [*drive(stats), "frame", "tier", "ci", "cj"]
    return stats.select(*on, (top + 1 + F.when(F.col("n_dyn") > 0, 16).otherwise(0)).cast("int").alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))


def png(rgb: bytes, n: int) -> bytes:
    """A PNG of n x n pixels of three bytes."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + rgb[3 * n * k : 3 * n * (k + 1)] for k in range(n))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", n, n, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def write_png(images: DataFrame, folder: str, mode: str = "after") -> DataFrame | None:
    """images(name, n, rgb) -> files <name>.png in a shared folder, written by the tasks: (name, bytes).

    mode `after` writes now, `async` returns the plan for the caller to run beside other work, `none` writes nothing."""
    if mode not in ("after", "async", "none"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "none":
        return None

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for b in batches:
            names, sizes = b.column(0).to_pylist(), []
            for name, n, rgb in zip(names, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = png(rgb, n)
                with system.open_output_stream(f"{root}/{name}.png") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "bytes"])

    plan = images.select("name", F.col("n").cast("int").alias("n"), "rgb").mapInArrow(run, "name string, bytes long")
    return plan if mode == "async" else plan.sparkSession.createDataFrame(plan.collect(), "name string, bytes long")  # a row a file


def overlay(points: DataFrame, most: int = 12_000) -> DataFrame:
    """(frame, start, n, blob): each frame's sample of points in base64, and where its bytes begin in all frames' bytes.

    Bytes of a frame: x of every point in cm (two bytes, little endian, within 320 m), then y, then a
    byte a point with the class and 16 if it moves.  start counts bytes before base64, frames in order."""
    on = [*drive(points), "frame"]
    cm = lambda c: F.least(F.greatest(F.rint(F.col(c) * 100), F.lit(-32000.0)), F.lit(32000.0)).cast("int")
    two = lambda v: F.concat(F.lpad(F.hex(v.bitwiseAND(255)), 2, "0"), F.lpad(F.hex(F.shiftright(v, 8).bitwiseAND(255)), 2, "0"))
    p = rangeimage.overlay_sample(points, most).select(*on, "pid", two(cm("x")).alias("a"), two(cm("y")).alias("b"), F.lpad(F.hex(F.col("cls") + F.when(F.col("moving"), 16).otherwise(0)), 2, "0").alias("c"))
    rows = p.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("pid", "a", "b", "c"))).alias("p"), F.count("*").alias("n"))
    joined = F.concat(*[F.array_join(F.col(f"p.{k}"), "") for k in "abc"])
    out = rows.select(*on, "n", F.base64(F.unhex(joined)).alias("blob"))
    before = Window.partitionBy(*drive(points)).orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)  # a row a frame
    return out.select(*on, F.coalesce(F.sum(F.col("n") * 5).over(before), F.lit(0)).alias("start"), "n", "blob")


def write_metrics(path: str, summary: DataFrame, frames: DataFrame) -> None:
    """One JSON record: the one row of summary, and all frames' rows in order (bounded by a drive's frames)."""
    on = "frame"
    rows = frames.agg(F.array_sort(F.collect_list(F.struct(on, *[c for c in frames.columns if c != on]))).alias("frames"))
    one = summary.select(F.struct(*summary.columns).alias("summary")).crossJoin(F.broadcast(rows))
    one.coalesce(1).write.mode("overwrite").json(path)


def finite(c, places: int = 4):
    """A number rounded half to even, null where it is none."""
    v = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), F.bround(v, places))


def training_rows(points: DataFrame, frames: DataFrame, rows: int = 64, width: int = 1024, sensor: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(frame, row, x, y, m, r): dense arrays of one image row, ready for Parquet.

    x: eight channels of `width` values each; y: labels (-1 where empty); m: moving flags; r: ranges."""
    on = [*drive(points), "frame"]
    f = rangeimage.features(points, frames, rows=rows, width=width, sensor=sensor)
    channels = F.array(*[F.col(f"f{k}").cast("float") for k in range(8)])
    of = f.groupBy(*on, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", channels.alias("v")))).alias("_m"))
    every = rangeimage.label_image(points, rows, width, sensor)
    at = lambda k: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.coalesce(F.try_element_at("_m", c)[k], F.lit(0.0)).cast("float"))
    j = every.join(of, [*on, "row"], "left").select(*on, "row", F.array(*[at(k) for k in range(8)]).alias("x"), F.col("labels").alias("y"), F.col("moving").alias("m"))
    return j.withColumn("r", F.transform(F.col("x")[0], lambda v: (v * 50).cast("float")))


def profile_frames(profile="spec") -> list[dict]:
    """A profile's tiers as records for a summary."""
    return [{"cell": t.cell, "half": t.half, "n": t.n} for t in tiers(profile)]
