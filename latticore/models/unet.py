"""Inference of a small U-Net over range images, in NumPy: class probabilities and a moving probability a pixel.

Four levels halve the image (the first time only its width), three take it back; the two residual
channels enter once more before the last.  Two heads of one pixel each give nine classes and motion.
Weights are plain arrays in an npz file, under the names of shapes(); the widths are read from them.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CHANNELS, CLASSES = 8, 9
WIDTHS = (16, 32, 64, 96)  # fixed value: channels a level of the standard network


def widths_for(width: float = 1.0) -> tuple[int, ...]:
    return tuple(round(c * width) for c in WIDTHS)


def shapes(widths: tuple[int, ...] = WIDTHS) -> dict[str, tuple[int, ...]]:
    """Every array of the network: 3 x 3 kernels with scale, shift, mean and variance of their normalisation, and the heads."""
    a, b, c, d = widths
    convs = {"e1": (CHANNELS, a), "e2": (a, b), "e3a": (b, c), "e3b": (c, c), "e4a": (c, d), "e4b": (d, d), "d3": (d + c, c), "d2": (c + b, b), "d1": (b + a + 2, a)}
    out: dict[str, tuple[int, ...]] = {}
    for name, (i, o) in convs.items():
        out[f"{name}.kernel"] = (o, i, 3, 3)
        out |= {f"{name}.{k}": (o,) for k in ("scale", "shift", "mean", "variance")}
    return out | {"classes.kernel": (CLASSES, a), "classes.bias": (CLASSES,), "moving.kernel": (1, a), "moving.bias": (1,)}


def parameters(widths: tuple[int, ...] = WIDTHS) -> int:
    """Learned numbers (running means and variances are not)."""
    return sum(int(np.prod(s)) for n, s in shapes(widths).items() if not n.endswith((".mean", ".variance")))


def random_weights(seed: int, widths: tuple[int, ...] = WIDTHS) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    fill = {"scale": 1.0, "variance": 1.0, "shift": 0.0, "mean": 0.0, "bias": 0.0}
    return {n: np.full(s, fill[n.split(".")[1]], np.float32) if n.split(".")[1] in fill else (rng.normal(size=s) * np.sqrt(2 / np.prod(s[1:]))).astype(np.float32) for n, s in shapes(widths).items()}


def save(weights: dict[str, np.ndarray], path: str) -> None:
    from pyarrow import fs

    raw = io.BytesIO()
    np.savez(raw, **weights)
    system, at = fs.FileSystem.from_uri(path)
    with system.open_output_stream(at) as out:
        out.write(raw.getbuffer())


def load(path: str) -> dict[str, np.ndarray]:
    """Arrays only: nothing is unpickled.  Raises where a shape is not the network's."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as got:
        weights = {k: got[k] for k in got.files}
    widths = tuple(weights[f"{k}.kernel"].shape[0] for k in ("e1", "e2", "e3a", "e4a"))
    want = shapes(widths)
    if {k: v.shape for k, v in weights.items()} != want:
        raise ValueError("the arrays are not this network's")
    return weights


def _block(x: np.ndarray, w: dict[str, np.ndarray], name: str) -> np.ndarray:
    """3 x 3 convolution, normalisation and rectification of x (channels, rows, columns)."""
    c, h, wd = x.shape
    padded = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    views = np.stack([padded[:, i : i + h, j : j + wd] for i in range(3) for j in range(3)], axis=1).reshape(9 * c, h * wd)
    gain = w[f"{name}.scale"] / np.sqrt(w[f"{name}.variance"] + 1e-5)
    y = w[f"{name}.kernel"].reshape(-1, 9 * c) @ views
    y = (y - w[f"{name}.mean"][:, None]) * gain[:, None] + w[f"{name}.shift"][:, None]
    return np.maximum(y, 0).reshape(-1, h, wd)


def _pool(x: np.ndarray, rows: int) -> np.ndarray:
    c, h, w = x.shape
    return x[:, : h // rows * rows, : w // 2 * 2].reshape(c, h // rows, rows, w // 2, 2).max(axis=(2, 4))


def _grow(x: np.ndarray, like: np.ndarray) -> np.ndarray:
    h, w = like.shape[1:]
    return x[:, np.arange(h) * x.shape[1] // h][:, :, np.arange(w) * x.shape[2] // w]


def predict(w: dict[str, np.ndarray], x: np.ndarray, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities (rows, columns, 9), moving probability (rows, columns)) of features (8, rows, columns); inactive classes are never predicted."""
    e1 = _block(x.astype(np.float32), w, "e1")
    e2 = _block(_pool(e1, 1), w, "e2")
    e3 = _block(_block(_pool(e2, 2), w, "e3a"), w, "e3b")
    e4 = _block(_block(_pool(e3, 2), w, "e4a"), w, "e4b")
    d3 = _block(np.concatenate([_grow(e4, e3), e3]), w, "d3")
    d2 = _block(np.concatenate([_grow(d3, e2), e2]), w, "d2")
    d1 = _block(np.concatenate([_grow(d2, e1), e1, x[6:8].astype(np.float32)]), w, "d1")
    logits = np.einsum("oc,chw->ohw", w["classes.kernel"], d1) + w["classes.bias"][:, None, None]
    if active is not None:
        logits[~np.asarray(active, bool)] = -1e4
    e = np.exp(logits - logits.max(axis=0))
    moving = np.einsum("oc,chw->ohw", w["moving.kernel"], d1)[0] + w["moving.bias"][0]
    return (e / e.sum(axis=0)).transpose(1, 2, 0), 1 / (1 + np.exp(-moving))


def infer(rows: DataFrame, path: str, active: list[bool] | None = None) -> DataFrame:
    """publish.training_rows() -> (seq?, frame, row, col, probs, p_move): a group is one image; each worker loads the weights once a call."""
    from ..schema import drive

    on = [*drive(rows), "frame"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in on)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        x = np.stack([np.stack([np.asarray(c, np.float32) for c in r]) for r in pdf["x"]], axis=1)
        probs, moving = predict(load(path), x, active)
        h, w = moving.shape
        out = pd.DataFrame({"row": np.repeat(pdf["row"].to_numpy(), w).astype(np.int32), "col": np.tile(np.arange(w, dtype=np.int32), h), "probs": list(probs.reshape(-1, CLASSES).astype(float)), "p_move": moving.ravel().astype(float)})
        for k, c in enumerate(on):
            out.insert(k, c, pdf[c].iloc[0])
        return out

    return rows.select(*on, "row", "x").groupBy(*on).applyInPandas(run, f"{kinds}, row int, col int, probs array<double>, p_move double")
