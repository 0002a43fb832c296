"""Layered options: command line over the file's section over its top level over defaults."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

SECTIONS: dict[str, dict[str, Any]] = {
    "run": {"model": None, "tasks": None, "inspect": False, "output_dir": "outputs", "run_id": None, "overwrite": False},
    "runtime": {"dp_size": 1, "tp_size": 1},
    "generation": {"n": None, "max_new_tokens": None, "temperature": None, "top_p": None, "top_k": None, "min_p": None, "seed": None},
    "metrics": {"bootstrap_resamples": 1000, "bootstrap_seed": 42, "bootstrap_confidence": 0.95},
}


def resolve(given: Mapping[str, Any], file: Mapping[str, Any] | None = None) -> dict[str, dict[str, Any]]:
    """Each section's options; a null at one level leaves the choice to the next."""
    file = file or {}
    out: dict[str, dict[str, Any]] = {}
    for section, defaults in SECTIONS.items():
        own = file.get(section) or {}
        if not isinstance(own, Mapping):
            raise ValueError(f"section {section} must be a mapping")
        levels = [given, own, {k: v for k, v in file.items() if k not in SECTIONS}]
        out[section] = {k: next((x[k] for x in levels if x.get(k) is not None), d) for k, d in defaults.items()}
    return out
