"""Run settings from the environment or a ``.env`` file: required keys raise, optional ones have defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from .grid import Grid


def read_env(path: str | Path, required: bool = True) -> dict[str, str]:
    """``KEY=value`` lines of a file; a missing file raises if it is required."""
    p = Path(path)
    if not p.exists():
        if required:
            raise ValueError(f"{p} is missing")
        return {}
    pairs = (line.split("=", 1) for line in p.read_text().splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("'\"") for k, v in pairs}


def need(env: Mapping[str, str], key: str) -> str:
    if not env.get(key):
        raise ValueError(f"{key} isn't set")
    return env[key]


def truth(text: str) -> bool:
    return text.strip().lower() in ("true", "1", "yes")


@dataclass(frozen=True)
class MaskConfig:
    layer_path: str
    mask_path: str
    grid: Grid
    normalise: bool = True

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> MaskConfig:
        env = os.environ if env is None else env
        bounds = [float(env.get(k, d)) for k, d in (("MASK_MIN_LON", "-0.25"), ("MASK_MIN_LAT", "-89.75"), ("MASK_MAX_LON", "359.75"), ("MASK_MAX_LAT", "90.25"))]
        return cls(need(env, "MASK_SHAPE_FILE_PATH"), need(env, "MASK_FILE_PATH"), Grid(*bounds, float(need(env, "MASK_RESOLUTION"))), truth(env.get("NORMALIZE_MASK", "true")))
