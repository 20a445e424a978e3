"""Configurations: YAML without repeated keys, merging, and validated parameters."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from pathlib import Path

import yaml


class _Strict(yaml.SafeLoader):
    """Refuses a mapping with a key twice."""


def _mapping(loader: _Strict, node: yaml.MappingNode) -> dict:
    keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
    if repeated := {str(k) for k in keys if keys.count(k) > 1}:
        raise ValueError(f"repeated keys {sorted(repeated)}")
    return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value)}


_Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)


def load_yaml(path: str | Path) -> dict:
    """The mapping that a YAML file holds; an empty file gives none, anything else is refused."""
    with open(path, encoding="utf-8") as f:
        out = yaml.load(f, Loader=_Strict)
    if out is None:
        return {}
    if not isinstance(out, dict):
        raise ValueError(f"{path} holds no mapping")
    return out


def merged(base: Mapping, changes: Mapping) -> dict:
    """``base`` with ``changes`` laid over it, mapping by mapping; a change to None is passed over."""
    out = dict(base)
    for k, v in changes.items():
        if isinstance(v, Mapping) and isinstance(out.get(k), Mapping):
            out[k] = merged(out[k], v)
        elif v is not None:
            out[k] = v
    return out


def _whole(name: str, v: object, least: int) -> None:
    if isinstance(v, bool) or not isinstance(v, int) or v < least:
        raise ValueError(f"{name} must be a whole number of at least {least}")


def _number(name: str, v: object, low: float, high: float, *, closed: bool) -> None:
    if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or not (low <= v <= high if closed else low < v < high):
        raise ValueError(f"{name} must lie {'from' if closed else 'between'} {low} {'to' if closed else 'and'} {high}")


@dataclass(frozen=True)
class ScoringParams:
    """Parameters of scoring, calibration, evaluation and mask fusion, with their usual values."""

    quantile: float = 0.995
    max_fpr: float = 0.3
    overlap_thresholds: int = 256
    f1_thresholds: int = 512
    min_area: int = 8
    max_regions: int = 8
    min_iou: float = 0.25
    max_expansion: float = 2.0
    bootstrap_samples: int = 2000
    confidence: float = 0.95
    seed: int = 4880
    coreset_ratio: float = 0.01
    projection_dim: int = 64
    crop_overlap: float = 0.25
    fusion: str = "max"
    folds: int = 5
    val_ratio: float = 0.2
    crop_sizes: Sequence[int] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        for n in ("overlap_thresholds", "f1_thresholds", "min_area", "max_regions", "bootstrap_samples", "projection_dim"):
            _whole(n, getattr(self, n), 1)
        _whole("folds", self.folds, 2)
        _whole("seed", self.seed, 0)
        for n in ("quantile", "confidence"):
            _number(n, getattr(self, n), 0, 1, closed=False)
        for n in ("max_fpr", "coreset_ratio"):
            _number(n, getattr(self, n), 0, 1, closed=True)
            if not getattr(self, n):
                raise ValueError(f"{n} must be above 0")
        for n in ("min_iou", "crop_overlap", "val_ratio"):
            _number(n, getattr(self, n), 0, 1, closed=True)
        if self.crop_overlap == 1:
            raise ValueError("crop_overlap must be below 1")
        _number("max_expansion", self.max_expansion, 0, 1e9, closed=True)
        if self.fusion not in ("max", "mean"):
            raise ValueError("fusion must be max or mean")
        for c in self.crop_sizes:
            _whole("crop_sizes", c, 1)

    @classmethod
    def of(cls, values: Mapping[str, object]) -> ScoringParams:
        """From a mapping; unknown names are refused."""
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(values) - known):
            raise ValueError(f"unknown parameters {unknown}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


@dataclass(frozen=True)
class MatrixConfig:
    """Methods, categories, shots and seeds of a matrix of runs; each list has at least one entry and none twice."""

    methods: Sequence[str]
    categories: Sequence[str]
    shots: Sequence[int]
    seeds: Sequence[int]
    fold_id: int = 0

    def __post_init__(self) -> None:
        for n in ("methods", "categories"):
            v = getattr(self, n)
            if not v or len(set(v)) != len(v) or not all(isinstance(x, str) and re.fullmatch(r"[a-z0-9_]+", x) and "__" not in x for x in v):
                raise ValueError(f"{n} must be different names of lower-case letters, digits and single _")
        for n, least in (("shots", 1), ("seeds", 0)):
            v = getattr(self, n)
            if not v or len(set(v)) != len(v):
                raise ValueError(f"{n} must be different numbers")
            for x in v:
                _whole(n, x, least)
        _whole("fold_id", self.fold_id, 0)
