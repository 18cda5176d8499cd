"""Settings files of jobs: small TOML files on the driver."""

from __future__ import annotations

import os
import tomllib


def load(name: str, path: str | None = None) -> dict:
    """The settings in ``path``, or those beside the jobs. A key that the latter do not know is an error."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.toml"), "rb") as f:
        known = tomllib.load(f)
    if path is None:
        return known
    with open(path, "rb") as f:
        given = tomllib.load(f)
    strange = [k for k in given if k not in known] + [f"{k}.{x}" for k, v in given.items() if isinstance(known.get(k), dict) for x in v if x not in known[k]]
    if strange:
        raise ValueError(f"unknown settings: {', '.join(sorted(strange))}")
    return {k: v | given.get(k, {}) if isinstance(v, dict) else given.get(k, v) for k, v in known.items()}
