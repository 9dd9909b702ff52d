"""Neighbourhood operators on cubes: tiles of traces with a halo, numpy on each tile, one shuffle for any number of
attributes.

Traces are rows (x, y, amp array). A tile is 32 by 32 traces and the traces around it that its windows reach; a tile's
size does not depend on the cube's, so memory of a task is bounded whatever the volume.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 32

#: A kernel gets the tile with its halo (already mirrored at the cube's border) and gives one value per inner sample.
Kernel = Callable[[np.ndarray], np.ndarray]


def cube_shape(traces: DataFrame) -> tuple[int, int, int]:
    """nx, ny, nz from one aggregation over the indices."""
    r = traces.agg(F.max("x"), F.max("y"), F.max(F.size("amp"))).first()
    return (r[0] or 0) + 1, (r[1] or 0) + 1, r[2] or 0


def on_tiles(traces: DataFrame, shape: tuple[int, int, int], halo: tuple[int, int, int], kernels: dict[str, Kernel], mode: str = "symmetric", tile: int = TILE) -> DataFrame:
    """x, y and an array column per kernel.

    Every trace goes to its own tile and to the neighbours whose halo it lies in. At the cube's border the halo is
    mirrored: 'symmetric' repeats the border sample, 'reflect' does not, 'edge' repeats only it. Missing traces and
    samples are NaN. The tile must be at least as wide as the halo.
    """
    nx, ny, nz = shape
    hx, hy, hz = halo
    near = max(hx, hy)
    if near > tile:
        raise ValueError("halo wider than a tile")
    tx, ty = F.floor(F.col("x") / tile), F.floor(F.col("y") / tile)
    shifts = F.array(*[F.struct((tx + i).alias("tx"), (ty + j).alias("ty")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = traces.select("x", "y", "amp", F.explode(shifts).alias("t")).select("x", "y", "amp", "t.tx", "t.ty")
    x0, y0 = F.col("tx") * tile, F.col("ty") * tile
    reach = (F.col("x") >= x0 - hx) & (F.col("x") < x0 + tile + hx) & (F.col("y") >= y0 - hy) & (F.col("y") < y0 + tile + hy)
    spread = spread.where(reach & (F.col("tx") >= 0) & (F.col("ty") >= 0) & (x0 < nx) & (y0 < ny))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ax, ay = int(key[0]) * tile, int(key[1]) * tile
        bx, by = min(ax + tile, nx), min(ay + tile, ny)
        lx, ux, ly, uy = max(ax - hx, 0), min(bx + hx, nx), max(ay - hy, 0), min(by + hy, ny)
        block = np.full((ux - lx, uy - ly, nz), np.nan)
        own = []
        for x, y, amp in zip(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["amp"]):
            a = np.asarray(amp, float)
            block[x - lx, y - ly, : len(a)] = a
            if ax <= x < bx and ay <= y < by:
                own.append((int(x), int(y)))
        pads = [(hx - (ax - lx), hx - (ux - bx)), (hy - (ay - ly), hy - (uy - by)), (hz, hz)]
        padded = np.pad(block, pads, mode=mode)
        out = {name: f(padded) for name, f in kernels.items()}
        rows = {"x": [x for x, _ in own], "y": [y for _, y in own]}
        return pd.DataFrame(rows | {n: [v[x - ax, y - ay].tolist() for x, y in own] for n, v in out.items()})

    kinds = f"x {traces.schema['x'].dataType.simpleString()}, y {traces.schema['y'].dataType.simpleString()}, " + ", ".join(f"{n} array<double>" for n in kernels)
    return spread.groupBy("tx", "ty").applyInPandas(work, kinds)


def points(arrays: DataFrame, *names: str) -> DataFrame:
    """One row per sample: x, y, z and the named arrays' values."""
    zipped = F.arrays_zip(*[F.col(n) for n in names])
    p = arrays.select("x", "y", F.posexplode(zipped).alias("z", "v"))
    return p.select("x", "y", F.col("z").cast("long").alias("z"), *[F.col(f"v.{n}").alias(n) for n in names])


def half(window: tuple[int, int, int]) -> tuple[int, int, int]:
    return tuple(w // 2 for w in window)  # type: ignore[return-value]


def _views(padded: np.ndarray, window: tuple[int, int, int]) -> np.ndarray:
    v = np.lib.stride_tricks.sliding_window_view(padded, window)
    # An even window is centred one to the left; its last position has no centre in the tile.
    n = [padded.shape[i] - 2 * (window[i] // 2) for i in range(3)]
    return v[: n[0], : n[1], : n[2]]


def moving(window: tuple[int, int, int], how: Callable[..., np.ndarray]) -> Kernel:
    """Kernel that applies a numpy reduction (np.mean, np.median, any function with `axis`) to every window."""
    return lambda padded: _by_layers(padded, window, how)


def reduction(window: tuple[int, int, int], how: str) -> Kernel:
    """Kernel of a named reduction; mean, sum, least and greatest go axis by axis."""
    if how == "mean":
        return lambda padded: _along(padded, window, np.sum) / float(np.prod(window))
    if how in SEPARABLE:
        return lambda padded: _along(padded, window, SEPARABLE[how])
    return moving(window, REDUCTIONS[how])


def _inner(padded: np.ndarray, window: tuple[int, int, int]) -> tuple[int, int, int]:
    return tuple(padded.shape[i] - 2 * (window[i] // 2) for i in range(3))  # type: ignore[return-value]


def _along(padded: np.ndarray, window: tuple[int, int, int], f: Callable[..., np.ndarray]) -> np.ndarray:
    """A reduction that can be done axis by axis: the window is never laid out, a tile costs its own size a few times over."""
    out = padded
    for axis in range(3):
        n = padded.shape[axis] - 2 * (window[axis] // 2)
        parts = np.lib.stride_tricks.sliding_window_view(out, window[axis], axis=axis)
        out = f(parts[tuple(slice(0, n) if i == axis else slice(None) for i in range(3))], axis=-1)
    return out


def _by_layers(padded: np.ndarray, window: tuple[int, int, int], f: Callable[..., np.ndarray]) -> np.ndarray:
    """A reduction of whole windows, so many layers of samples at a time that their copies stay below COPY numbers."""
    v = _views(padded, window)
    step = max(1, COPY // max(1, v.shape[0] * v.shape[1] * int(np.prod(window))))
    parts = [f(v[:, :, z : z + step].reshape(v.shape[0], v.shape[1], -1, int(np.prod(window))), axis=-1) for z in range(0, v.shape[2], step)]
    return np.concatenate(parts, axis=2)


#: Numbers that a task lays out at once when a reduction needs whole windows (32 MB).
COPY = 4_000_000
#: Reductions that are made axis by axis.
SEPARABLE = {"sum": np.sum, "min": np.min, "max": np.max}
REDUCTIONS = {"mean": np.mean, "sum": np.sum, "min": np.min, "max": np.max, "median": np.median}


def moving_window(traces: DataFrame, window: tuple[int, int, int], how: str | Callable[..., np.ndarray], name: str = "value") -> DataFrame:
    """x, y and an array `name`: a reduction over the window around every sample, mirrored at the border."""
    kernel = reduction(window, how) if isinstance(how, str) else moving(window, how)
    return on_tiles(traces, cube_shape(traces), half(window), {name: kernel})


def rms_kernel(depth: int) -> Kernel:
    """Root of the sine-weighted mean square over `depth` samples of the trace."""
    w = np.sin(np.pi * np.arange(1, depth + 1) / depth)

    def f(padded: np.ndarray) -> np.ndarray:
        v = np.lib.stride_tricks.sliding_window_view(padded, depth, axis=2)[:, :, : padded.shape[2] - 2 * (depth // 2)]
        return np.sqrt(np.maximum((v * v) @ w, 0) / depth)

    return f


def param_moving_window(traces: DataFrame, window: tuple[int, int, int], f: Callable[..., np.ndarray], name: str = "value", **params) -> DataFrame:
    """As moving_window, with parameters handed to the user's function."""
    return moving_window(traces, window, lambda v, axis: f(v, axis=axis, **params), name)
