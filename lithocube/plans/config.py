"""Settings of a run: defaults, merging, casting and checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from enum import Enum
from pathlib import Path
from typing import Any

from lithocube.functions.scalars import yes_or_no
from lithocube.operators.gbdt import Params


class Selection(Enum):
    FORWARD = "FORWARD"
    NONE = "NONE"


class Save(Enum):
    """When models are saved."""

    LAST = "last"
    ALL = "all"
    EVERY_N = "every_n"
    LIST = "list"


@dataclass
class Sampling:
    layers: int = -1
    max_points: int = -1
    seed: int = 42
    alpha: float = 1.0
    beta: float = 1.0


@dataclass
class Config:
    """wells: (well_id, x, y), ids by place; test and validation wells by id. Coordinates are those of the volume
    itself: halos are made by clamping, never stored, so no setting shifts them."""

    wells: list[tuple[int, int, int]] = field(default_factory=list)
    test_only_wells: list[int] = field(default_factory=list)
    validation_only_wells: list[int] = field(default_factory=list)
    window: int = 3
    num_its: int = 10
    it: int = 1
    max_num_features: int = 1
    layers_to_predict: int = 1
    feature_selection: Selection = Selection.FORWARD
    save_models_on: Save = Save.LAST
    save_every: int | None = None
    save_list: list[int] = field(default_factory=list)
    max_exec_time: float = -1.0
    generate_porosity_cube: bool = True
    metrics_by_it: bool = True
    n_training_chunks: int = 1
    max_points_per_chunk: int = -1
    save_cube_every: int = -1
    first_features: int | None = None
    first_candidates: int | None = None
    only_z: bool = False
    features_folder: str = ""
    cube_path: str = ""
    output_path: str = ""
    sampling: Sampling = field(default_factory=Sampling)
    params: Params = field(default_factory=Params)

    @property
    def train_wells(self) -> list[tuple[int, int, int]]:
        aside = {*self.test_only_wells, *self.validation_only_wells}
        return [w for w in self.wells if w[0] not in aside]

    @property
    def test_wells(self) -> list[tuple[int, int, int]]:
        return [w for w in self.wells if w[0] in self.test_only_wells]

    def coords(self, well_id: int) -> tuple[int, int]:
        return next((x, y) for w, x, y in self.wells if w == well_id)

    def well_at(self, x: int, y: int) -> int:
        found = [w for w, wx, wy in self.wells if (wx, wy) == (x, y)]
        if not found:
            raise KeyError(f"no well at {(x, y)}")
        return found[0]


#: Settings of a file by section and name, the field each goes to, and how its value is read.
_FIELDS: dict[tuple[str, ...], tuple[str, Any]] = {
    ("wells", "window"): ("window", int),
    ("features_folder",): ("features_folder", str),
    ("starting_porosity_cube_path",): ("cube_path", str),
    ("porosity_cube_output_path",): ("output_path", str),
    ("alg", "num_its"): ("num_its", int),
    ("alg", "it"): ("it", int),
    ("alg", "starting_it"): ("it", int),
    ("alg", "save_cube_every_n_its"): ("save_cube_every", int),
    ("alg", "parallel", "max_points_per_chunk"): ("max_points_per_chunk", int),
    ("alg", "window"): ("window", int),
    ("alg", "max_num_features"): ("max_num_features", int),
    ("alg", "layers_to_predict"): ("layers_to_predict", int),
    ("alg", "max_exec_time"): ("max_exec_time", float),
    ("alg", "generate_porosity_cube"): ("generate_porosity_cube", yes_or_no),
    ("alg", "metrics_by_it"): ("metrics_by_it", yes_or_no),
    ("alg", "parallel", "n_training_chunks"): ("n_training_chunks", int),
    ("alg", "sampling", "layers_window_size"): ("sampling.layers", int),
    ("alg", "sampling", "max_points"): ("sampling.max_points", int),
    ("alg", "sampling", "seed"): ("sampling.seed", int),
    ("alg", "sampling", "beta_dist", "alpha"): ("sampling.alpha", float),
    ("alg", "sampling", "beta_dist", "beta"): ("sampling.beta", float),
}


#: Settings that load() reads by itself.
_OTHERS = {("wells", "coords"), ("alg", "test_only_wells"), ("alg", "validation_only_wells"), ("alg", "feature_selection_type"), ("alg", "save_models_on")}


def unknown(raw: Mapping, at: tuple[str, ...] = ()) -> list[str]:
    """Names of settings that mean nothing, dotted."""
    out = []
    for k, v in raw.items():
        here = (*at, str(k))
        if here in _FIELDS or here in _OTHERS:
            continue
        if isinstance(v, Mapping) and any(f[: len(here)] == here for f in (*_FIELDS, *_OTHERS)):
            out += unknown(v, here)
        elif v is not None or not any(f[: len(here)] == here for f in (*_FIELDS, *_OTHERS)):
            out.append(".".join(here))
    return out


def merged(base: Mapping, over: Mapping) -> dict:
    """`base` with the values of `over`, section by section."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def _wells(coords: Any) -> list[tuple[int, int, int]]:
    pairs: Sequence = list(coords.values()) if isinstance(coords, Mapping) else list(coords)
    try:
        return [(i, int(p["x"]), int(p["y"])) if isinstance(p, Mapping) else (i, int(p[0]), int(p[1])) for i, p in enumerate(pairs)]
    except (KeyError, IndexError, TypeError, ValueError) as e:
        raise TypeError(f"wells.coords: {coords!r} is not valid") from e


def load(source: str | Path | Mapping | None = None, *overrides: Mapping, check: bool = True) -> Config:
    """Settings from a YAML file, YAML text or a mapping, with later mappings over earlier ones."""
    import yaml

    raw: dict = {}
    if isinstance(source, Mapping):
        raw = dict(source)
    elif source is not None:
        text = Path(source).read_text() if isinstance(source, Path) or "\n" not in str(source) and Path(str(source)).exists() else str(source)
        raw = yaml.safe_load(text) or {}
        if not isinstance(raw, Mapping):
            raise TypeError("settings must be a mapping")
    for o in overrides:
        raw = merged(raw, o)
    if check and (odd := unknown(raw)):
        raise ValueError(f"settings that do not exist: {', '.join(odd)}")
    c = Config()
    for keys, (name, cast) in _FIELDS.items():
        v: Any = raw
        for k in keys:
            v = v.get(k) if isinstance(v, Mapping) else None
        if v is not None:
            target, _, leaf = name.rpartition(".")
            try:
                setattr(getattr(c, target) if target else c, leaf, cast(v))
            except (TypeError, ValueError) as e:
                raise TypeError(f"{'.'.join(keys)}: {v!r} is not valid") from e
    wells, alg = raw.get("wells") or {}, raw.get("alg") or {}
    if "coords" in wells:
        c.wells = _wells(wells["coords"])
    for name in ("test_only_wells", "validation_only_wells"):
        setattr(c, name, [int(i) for i in alg.get(name) or []])
    if "feature_selection_type" in alg:
        c.feature_selection = Selection(str(alg["feature_selection_type"]).upper())
    save = alg.get("save_models_on", "last")
    if isinstance(save, list):
        c.save_models_on, c.save_list = Save.LIST, [int(i) for i in save]
    elif str(save).startswith("every_"):
        c.save_models_on, c.save_every = Save.EVERY_N, int(str(save)[6:])
    else:
        c.save_models_on = Save(str(save).lower())
    if check:
        validate(c)
    return c


def validate(c: Config) -> None:
    """Errors for settings out of range, well ids that do not exist, and wells at one place."""
    least = {"window": 0, "num_its": 1, "it": 0, "max_num_features": 1, "layers_to_predict": 1, "n_training_chunks": 1}
    for name, low in least.items():
        if getattr(c, name) < low:
            raise ValueError(f"{name} must be at least {low}")
    ids = {w for w, _, _ in c.wells}
    for name in ("test_only_wells", "validation_only_wells"):
        if not {*getattr(c, name)} <= ids:
            raise ValueError(f"{name} names wells that do not exist")
    if len({(x, y) for _, x, y in c.wells}) < len(c.wells):
        raise ValueError("two wells lie at one place")
    if any(x < 0 or y < 0 for _, x, y in c.wells):
        raise ValueError("well coordinates must not be negative")
    if c.max_points_per_chunk == 0:
        raise ValueError("max_points_per_chunk must not be 0")
    if c.sampling.seed < 0:
        raise ValueError("seed must be 0 or more")
    if c.sampling.alpha <= 0 or c.sampling.beta <= 0:
        raise ValueError("alpha and beta must be above 0")
