"""Parameters of tracking and dynamics, with their defaults, read over from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

# Words that stand for a truth value.
TRUE, FALSE = ("true", "yes", "1", "on"), ("false", "no", "0", "off")


def coerce(value: Any) -> Any:
    """Texts that stand for a truth value become one, within mappings too; lists become tuples."""
    if isinstance(value, dict):
        return {k: coerce(v) for k, v in value.items()}
    if isinstance(value, list):
        return tuple(coerce(v) for v in value)
    if isinstance(value, str) and (word := value.strip().lower()) in TRUE + FALSE:
        return word in TRUE
    return value


@dataclass(frozen=True)
class Tracking:
    n_bots: int = 1
    threshold: int = 7
    areas: tuple[float, float] = (6000, 7500)
    perimeters: tuple[float, float] = (300, 600)
    center: tuple[int, int] = (1512, 1531)
    radius: int = 1512
    search_range: float = 200
    fps: float = 22.46
    diameter_cm: float = 4.975
    diameter_px: float = 97.01
    disc: int = 30
    #: Without these a frame whose detections don't match n_bots is a skipped frame.
    max_offset: int = 0
    fallback_area: tuple[float, float] | None = None
    fallback_perimeters: tuple[float, float] | None = None


@dataclass(frozen=True)
class Dynamics:
    run_duration: float = 6
    pause_duration: float = 1.845
    start_time: float = 5.2
    #: Recordings to work on; none: all that are there.
    name_pogs: tuple[str, ...] = ()
    pwm: tuple[int, ...] = (200, 400, 500, 600, 700, 800, 900, 950, 1023)
    trials: int = 10
    center_x: float = 1518
    center_y: float = 1529
    outer_radius: float = 1200
    max_fraction_skipped: float = 0.3
    max_skipped_frames: int = 4
    max_tau_seconds: float = 1.5
    taus_percentage: float = 0.3
    t_subset: float = 1
    cutoff: float = 1.0
    order: int = 4
    plotting: dict[str, dict] = field(default_factory=dict)


#: Names in YAML files that differ from the fields'.
ALIASES = {
    "n_pogo": "n_bots", "pogobot_diameter_cm": "diameter_cm", "pixel_diameter": "diameter_px", "tested_pwm": "pwm",
    "trials_per_pwm": "trials", "default_start_time": "start_time",
}


def load(kind: type, path: str | None = None, **values: Any):
    """The parameters of a kind (Tracking or Dynamics) from a YAML file, if any, and values that override it. Names
    count in either case; unknown ones are left out."""
    read: dict[str, Any] = {}
    if path:
        import yaml

        with open(path) as f:
            read = yaml.safe_load(f) or {}
    known = {f.name for f in fields(kind)}
    out = {}
    for name, value in {**read, **values}.items():
        name = ALIASES.get(name.lower(), name.lower())
        if name in known:
            out[name] = coerce(value)
    return kind(**out)
