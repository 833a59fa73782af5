"""Configuration: defaults, presets, secrets from the environment."""

from __future__ import annotations

import copy
import os
from pathlib import Path
from typing import Any

#: Settings that hold where neither the shared block nor the preset says otherwise.
MODEL_DEFAULTS: dict[str, Any] = {
    "criterion": "aic", "max_terms": 30, "lams": [0.1, 1.0, 10.0, 100.0], "cv_splits": 5, "n_splines": 25, "embargo": 60, "collinearity": 0.97,
    "nu_tau_window": 60, "sigma_source": "gam", "bags": 5, "bag_block": 21,
}
SECRETS = ("EIA_API_KEY", "FRED_API_KEY", "ALPHA_VANTAGE_API_KEY")


def is_placeholder(value: Any) -> bool:
    return value is None or str(value).startswith("YOUR_")


def load_config(path: str | None = None) -> dict[str, Any]:
    """A YAML file's settings, or a minimal built-in set; environment secrets replace placeholders."""
    config: dict[str, Any] = {"model": {}, "features": {"target": "close"}, "secrets": {}}
    if path and Path(path).exists():
        import yaml  # only needed for files

        config |= yaml.safe_load(Path(path).read_text()) or {}
    secrets = config.setdefault("secrets", {})
    for name in SECRETS:
        if is_placeholder(secrets.get(name)) and os.environ.get(name):
            secrets[name] = os.environ[name]
    return config


def model_config(config: dict[str, Any], mode: str | None = None) -> dict[str, Any]:
    """A flat model block as it is; else defaults, overridden by its shared block, then by the preset of the mode."""
    block = copy.deepcopy(config.get("model", {}))
    if "presets" not in block:
        return MODEL_DEFAULTS | block
    mode = mode or block.get("mode", "fast")
    if mode not in block["presets"]:
        raise ValueError(f"unknown mode {mode!r}")
    return MODEL_DEFAULTS | block.get("shared", {}) | block["presets"][mode]


def secret(config: dict[str, Any], name: str) -> str:
    value = config.get("secrets", {}).get(name)
    if is_placeholder(value):
        raise ValueError(f"{name} isn't set")
    return str(value)
