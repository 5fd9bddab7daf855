"""Nested settings and the names under which metrics are shown."""

from __future__ import annotations

from collections.abc import Mapping

# How a metric is shown when higher should mean better, and task names.
DISPLAY = {"jsd": "1 - JSD", "mae": "1 - MAE", "mse": "1 - MSE"}
SPLITS = ("trn", "val", "tst")


def merged(base: Mapping, changes: Mapping) -> dict:
    """``base`` with ``changes`` laid over it, nested mappings merged key by key."""
    out = dict(base)
    for k, v in changes.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def shown(metric: str, value: float) -> tuple[str, float]:
    """A metric's display name and value; errors are shown as one minus themselves."""
    name = DISPLAY.get(metric.lower())
    return (name, 1 - value) if name else (metric, value)
