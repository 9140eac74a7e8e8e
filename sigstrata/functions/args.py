"""Argument checks for operator parameters."""

from __future__ import annotations

import math
from numbers import Real

from ..schemas import LAYERS


def num(v, name: str = "value"):
    """A required finite number (bool and NaN rejected)."""
    if isinstance(v, bool) or not isinstance(v, Real) or (isinstance(v, float) and math.isnan(v)):
        raise ValueError(f"parameter {name} missing or invalid: {v!r}")
    return v


def nullable_num(v, name: str = "value"):
    return None if v is None else num(v, name)


def int_arg(v, name: str = "value", minimum: int | None = None) -> int:
    num(v, name)
    if int(v) != v:
        raise ValueError(f"parameter {name} must be an integer: {v!r}")
    v = int(v)
    if minimum is not None and v < minimum:
        raise ValueError(f"parameter {name} must be >= {minimum}: {v!r}")
    return v


def nullable_int(v, name: str = "value", minimum: int | None = None):
    return None if v is None else int_arg(v, name, minimum)


def time_range(start, end) -> tuple[int, int]:
    s, e = int_arg(start, "start"), int_arg(end, "end")
    return s, e


def layer_arg(layer: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}; expected one of {LAYERS}")
    return layer
