"""Attributes of seismic cubes: surfaces, coherence, complex traces. All of a cube's attributes share one tiling."""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithocube.functions.curvature import attributes, with_shared
from lithocube.sources.io import write_features
from lithocube.operators.stencil import _inner, _views, cube_shape, half, on_tiles, points


def surface_parameters(traces: DataFrame) -> DataFrame:
    """x, y, z and a, b, c, d, e of the local quadratic surface, from central differences along x and y (one-sided at
    the cube's border). A cube needs two traces along each axis."""
    nx, ny, nz = cube_shape(traces)
    if nx < 2 or ny < 2:
        raise ValueError("differences need at least two traces along each axis")

    # Second differences reach two traces. At the border the differences are one-sided, which a linear continuation
    # of the cube by one trace gives in turn for each derivative; tiles carry indices to know where the border is.
    def diff(v: np.ndarray, axis: int, at: np.ndarray, n: int) -> np.ndarray:
        up, down = np.roll(v, -1, axis), np.roll(v, 1, axis)
        shape = [1, 1, 1]
        shape[axis] = -1
        first, last = (at == 0).reshape(shape), (at == n - 1).reshape(shape)
        return np.where(first, up - v, np.where(last, v - down, (up - down) / 2))

    def kernel(block: np.ndarray) -> dict[str, np.ndarray]:
        gx, gy = block[..., 0][:, 0, 0].astype(int), block[..., 1][0, :, 0].astype(int)
        z = block[..., 2]
        zx, zy = diff(z, 0, gx, nx), diff(z, 1, gy, ny)
        zxx, zxy, zyy = diff(zx, 0, gx, nx), diff(zx, 1, gy, ny), diff(zy, 1, gy, ny)
        cut = np.s_[2:-2, 2:-2]
        return {k: v[cut] for k, v in zip("abcde", (zxx / 2, zyy / 2, zxy, zx, zy))}

    return points(_on_indexed_tiles(traces, (nx, ny, nz), kernel), *"abcde")


def _on_indexed_tiles(traces: DataFrame, shape: tuple[int, int, int], kernel) -> DataFrame:
    """Tiles with a halo of two, whose samples come with their trace's indices (border: repeated)."""
    from lithocube.operators.stencil import TILE

    nx, ny, nz = shape
    h = 2
    tx, ty = F.floor(F.col("x") / TILE), F.floor(F.col("y") / TILE)
    shifts = F.array(*[F.struct((tx + i).alias("tx"), (ty + j).alias("ty")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = traces.select("x", "y", "amp", F.explode(shifts).alias("t")).select("x", "y", "amp", "t.tx", "t.ty")
    x0, y0 = F.col("tx") * TILE, F.col("ty") * TILE
    reach = F.col("x").between(x0 - h, x0 + TILE + h - 1) & F.col("y").between(y0 - h, y0 + TILE + h - 1)
    spread = spread.where(reach & (F.col("tx") >= 0) & (F.col("ty") >= 0) & (x0 < nx) & (y0 < ny))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ax, ay = int(key[0]) * TILE, int(key[1]) * TILE
        bx, by = min(ax + TILE, nx), min(ay + TILE, ny)
        block = np.full((bx - ax + 2 * h, by - ay + 2 * h, nz, 3), np.nan)
        block[..., 0] = np.arange(ax - h, bx + h)[:, None, None]
        block[..., 1] = np.arange(ay - h, by + h)[None, :, None]
        own = []
        for x, y, amp in zip(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["amp"]):
            a = np.asarray(amp, float)
            block[x - ax + h, y - ay + h, : len(a), 2] = a
            if ax <= x < bx and ay <= y < by:
                own.append((int(x), int(y)))
        out = kernel(block)
        return pd.DataFrame({"x": [x for x, _ in own], "y": [y for _, y in own]} | {n: [v[x - ax, y - ay].tolist() for x, y in own] for n, v in out.items()})

    kind = lambda c: traces.schema[c].dataType.simpleString()
    return spread.groupBy("tx", "ty").applyInPandas(work, f"x {kind('x')}, y {kind('y')}, " + ", ".join(f"{n} array<double>" for n in "abcde"))


def surface_attributes(traces: DataFrame, *names: str) -> DataFrame:
    """x, y, z and the named attributes (see functions.curvature); all if none is named."""
    every = attributes()
    return with_shared(surface_parameters(traces)).select("x", "y", "z", *[every[n].alias(n) for n in (names or every)])


def semblance_kernel(window: tuple[int, int, int]):
    """Energy of the window's mean trace as a share of the traces' mean energy; NaN where there is none."""

    def f(padded: np.ndarray) -> np.ndarray:
        v = _views(padded, window)
        stack = v.sum(axis=(3, 4))
        energy = (v * v).sum(axis=(3, 4, 5))
        with np.errstate(invalid="ignore", divide="ignore"):
            return (stack * stack).sum(axis=-1) / energy / (window[0] * window[1])

    return f


def eigen_kernel(window: tuple[int, int, int]):
    """Largest eigenvalue of the traces' covariance as a share of their sum."""

    def f(padded: np.ndarray) -> np.ndarray:
        n = _inner(padded, window)
        out = np.empty(n)
        for i in range(n[0]):
            v = _views(padded[i : i + window[0]], window)[0].reshape(n[1], n[2], -1, window[2])
            vals = np.linalg.eigvalsh(v @ v.transpose(0, 1, 3, 2))
            with np.errstate(invalid="ignore", divide="ignore"):
                out[i] = vals[..., -1] / vals.sum(axis=-1)
        return out

    return f


def _gauss_derivative(v: np.ndarray, axis: int, sigma: float) -> np.ndarray:
    """First derivative of a Gaussian along an axis, border samples repeated beyond the array."""
    r = int(4 * sigma + 0.5)
    at = np.arange(-r, r + 1)
    g = np.exp(-0.5 * (at / sigma) ** 2)
    k = -at / sigma**2 * g / g.sum()
    pad = [(0, 0)] * v.ndim
    pad[axis] = (r, r)
    wide = np.pad(v, pad, mode="symmetric")
    views = np.lib.stride_tricks.sliding_window_view(wide, 2 * r + 1, axis=axis)
    return views @ k[::-1]


def structure_tensor_coherence(traces: DataFrame, window: tuple[int, int, int], sigma: float = 1.0) -> DataFrame:
    """x, y and array `gst`: (l0 - l1) / (l0 + l1) of the two largest eigenvalues of the windows' gradient tensor.

    Gradients are Gaussian derivatives; windows are mirrored at the cube's border without repeating it.
    """
    shape = cube_shape(traces)
    r = int(4 * sigma + 0.5)
    h = half(window)
    reach = (h[0] + r, h[1] + r, 0)

    def kernel(padded: np.ndarray) -> np.ndarray:
        inner = np.s_[r : padded.shape[0] - r, r : padded.shape[1] - r]
        grads = np.stack([_gauss_derivative(padded, a, sigma)[inner] for a in range(3)], axis=-1)
        grads = np.pad(grads, [(0, 0), (0, 0), (h[2], h[2]), (0, 0)], mode="reflect")
        prod = grads[..., :, None] * grads[..., None, :]
        v = np.lib.stride_tricks.sliding_window_view(prod, window, axis=(0, 1, 2))
        n = [grads.shape[i] - 2 * h[i] for i in range(3)]
        vals = np.linalg.eigvalsh(v[: n[0], : n[1], : n[2]].sum(axis=(-3, -2, -1)))
        with np.errstate(invalid="ignore", divide="ignore"):
            return (vals[..., 2] - vals[..., 1]) / (vals[..., 2] + vals[..., 1])

    return on_tiles(traces, shape, reach, {"gst": kernel})


def sobel_coherence(traces: DataFrame, window: tuple[int, int, int]) -> DataFrame:
    """x, y and array `sobel`: length of the Sobel gradient of the eigenvalue coherence, in one tiling with a wider halo."""
    h = half(window)
    smooth, slope = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])

    def along(v: np.ndarray, axis: int, k: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(v, 3, axis=axis) @ k

    def kernel(padded: np.ndarray) -> np.ndarray:
        core = eigen_kernel(window)(padded)
        wide = np.pad(core, [(0, 0), (0, 0), (1, 1)], mode="symmetric")
        total = 0.0
        for axis in range(3):
            g = wide
            for a in range(3):
                g = along(g, a, slope if a == axis else smooth)
            total = total + g * g
        return np.sqrt(total)

    # One trace more on each side for the gradient; beyond the border coherence mirrors as its cube does.
    return on_tiles(traces, cube_shape(traces), (h[0] + 1, h[1] + 1, h[2]), {"sobel": kernel})


def _analytic(a: np.ndarray) -> np.ndarray:
    """Analytic signal of traces of one length: negative frequencies out, positive ones doubled."""
    n = a.shape[-1]
    f = np.fft.fft(a, axis=-1)
    w = np.zeros(n)
    w[0] = 1
    w[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        w[n // 2] = 1
    return np.fft.ifft(f * w, axis=-1)


def complex_trace(traces: DataFrame) -> DataFrame:
    """x, y, envelope, phase and frequency of every trace, each trace on its own: no shuffle.

    Phase is unwrapped; frequency is its difference times samples over 2 pi, the last one repeated. Traces of fewer
    than two samples have frequency null; null traces give nulls.
    """

    def run(batches):
        for pdf in batches:
            out: dict[str, list] = {"envelope": [None] * len(pdf), "phase": [None] * len(pdf), "frequency": [None] * len(pdf)}
            lengths = np.array([-1 if a is None else len(a) for a in pdf["amp"]])
            for n in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == n)
                signal = _analytic(np.stack([np.asarray(pdf["amp"].iat[i], float) for i in rows]))
                phase = np.unwrap(np.angle(signal), axis=-1)
                for k, i in enumerate(rows):
                    out["envelope"][i], out["phase"][i] = np.abs(signal[k]).tolist(), phase[k].tolist()
                    if n > 1:
                        d = np.diff(phase[k]) / (2 * np.pi) * n
                        out["frequency"][i] = [*d.tolist(), float(d[-1])]
            yield pd.DataFrame({"x": pdf["x"], "y": pdf["y"]} | out)

    kind = lambda c: traces.schema[c].dataType.simpleString()
    return traces.select("x", "y", "amp").mapInPandas(run, f"x {kind('x')}, y {kind('y')}, envelope array<double>, phase array<double>, frequency array<double>")


def apply_and_save(traces: DataFrame, functions: dict[str, Callable[[DataFrame], DataFrame]], path: str) -> DataFrame:
    """Each of `functions` on `traces`, written as a feature of its name; one that fails is skipped.

    Result: feature, error (null where it was written), one row per function, in order.
    """
    done: list[tuple[str, str | None]] = []
    for name, f in functions.items():
        try:
            write_features(f(traces).select("x", "y", "amp").withColumn("feature", F.lit(name)), path)
            done.append((name, None))
        except Exception as e:  # the user's function may fail in any way; the others go on
            logging.getLogger(__name__).warning("%s is skipped: %s", name, e)
            done.append((name, str(e).splitlines()[0] if str(e) else type(e).__name__))
    return traces.sparkSession.createDataFrame(done, "feature string, error string")
