"""Settings: defaults, environment overrides and a file of user preferences.

A configuration is a frozen value that is passed to operators on the driver; executors never read it from
their environment.
"""

from __future__ import annotations

import json
import math
import os
import tempfile
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace


def env_int(environ: Mapping[str, str], name: str, default: int) -> int:
    """The whole number in an environment variable; the default where it is unset or not a number."""
    try:
        return int(environ.get(name, "").strip() or default)
    except ValueError:
        return default


def env_float(environ: Mapping[str, str], name: str, default: float) -> float:
    """The finite number in an environment variable, else the default."""
    try:
        value = float(environ.get(name, "").strip() or default)
    except ValueError:
        return default
    return value if math.isfinite(value) else default


def env_str(environ: Mapping[str, str], name: str, default: str) -> str:
    """The trimmed text of an environment variable; the default where it is blank."""
    return environ.get(name, "").strip() or default


# Thresholds that decide results.
@dataclass(frozen=True)
class EngineConfig:
    face_min_score: float = 0.50
    cluster_eps: float = 0.35
    cluster_min_samples: int = 3
    face_match_threshold: float = 0.55
    face_quality_store_min: float = 0.35
    face_quality_learn_min: float = 0.55
    person_max_representatives: int = 12
    representative_diversity_sim: float = 0.92
    adaptive_threshold_min: float = 0.45
    adaptive_threshold_max: float = 0.62
    adaptive_threshold_min_reps: int = 3
    adaptive_strict_min_reps: int = 6
    merge_suggest_threshold: float = 0.50
    merge_auto_threshold: float = 0.70
    suggestion_margin: float = 0.07
    context_boost: float = 0.06
    context_reach: float = 0.10
    search_favorite_boost: float = 0.15
    search_recency_boost: float = 0.05
    search_ocr_boost: float = 0.35
    phash_max_distance: int = 5
    scan_batch_size: int = 200
    clip_batch_size: int = 64
    clip_version: int = 1
    clip_model: str = "m1"
    image_suffixes: tuple[str, ...] = (
        ".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tif", ".tiff", ".webp", ".heic", ".heif",
    )

    @classmethod
    def from_env(cls, environ: Mapping[str, str] | None = None, prefix: str = "MEDIASPARK_") -> EngineConfig:
        """Defaults with each number or text that an environment variable PREFIX + NAME replaces."""
        environ = os.environ if environ is None else environ
        changes = {}
        for f in fields(cls):
            name, default = prefix + f.name.upper(), f.default
            if isinstance(default, float):
                changes[f.name] = env_float(environ, name, default)
            elif isinstance(default, int):
                changes[f.name] = env_int(environ, name, default)
            elif isinstance(default, str):
                changes[f.name] = env_str(environ, name, default)
        return replace(cls(), **changes)


class Preferences:
    """User preferences in a JSON file: known keys only, each value checked by its default's kind and range.

    A file that can't be read, an unknown key or a bad value leaves the default in place; saving
    replaces the file in one step.  effective() gives the configuration with precedence preference, then
    environment, then default.
    """

    RANGES = {
        f.name: (0, 1) if isinstance(f.default, float) else (0, 100_000)
        for f in fields(EngineConfig)
        if isinstance(f.default, (int, float))
    }

    def __init__(self, path: str):
        self.path = path
        self.values: dict[str, float | int | str] = {}
        self._listeners: list[Callable[[str, object], None]] = []
        self.load()

    def _checked(self, key: str, value):
        default = getattr(EngineConfig(), key, None)
        if default is None or isinstance(default, tuple):
            raise KeyError(key)
        if isinstance(default, str):
            if not isinstance(value, str) or not value.strip():
                raise ValueError(f"{key} must be a text")
            return value.strip()
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
            raise ValueError(f"{key} must be a number")
        if isinstance(default, int) and value != int(value):
            raise ValueError(f"{key} must be a whole number")
        low, high = self.RANGES[key]
        if not low <= value <= high:
            raise ValueError(f"{key} must lie between {low} and {high}")
        return int(value) if isinstance(default, int) else float(value)

    def load(self) -> None:
        try:
            with open(self.path, encoding="utf-8") as f:
                data = json.load(f)
        except (OSError, ValueError):
            data = {}
        self.values = {}
        for key, value in data.items() if isinstance(data, dict) else ():
            try:
                self.values[key] = self._checked(key, value)
            except (KeyError, ValueError):
                continue

    def _save(self) -> None:
        folder = os.path.dirname(os.path.abspath(self.path))
        os.makedirs(folder, exist_ok=True)
        fd, temporary = tempfile.mkstemp(dir=folder)
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(self.values, f, indent=1, sort_keys=True)
        os.replace(temporary, self.path)

    def get(self, key: str):
        return self.values.get(key, getattr(EngineConfig(), key))

    def set(self, key: str, value) -> None:
        self.values[key] = self._checked(key, value)
        self._save()
        for tell in self._listeners:
            tell(key, self.values[key])

    def reset(self) -> None:
        self.values = {}
        self._save()

    def subscribe(self, listener: Callable[[str, object], None]) -> None:
        self._listeners.append(listener)

    def effective(self, environ: Mapping[str, str] | None = None) -> EngineConfig:
        return replace(EngineConfig.from_env(environ), **self.values)
