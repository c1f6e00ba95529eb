"""Registration of pipeline steps."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

STEPS: dict[str, Callable[..., DataFrame]] = {}


def step(name: str | None = None):
    """Register a function ``(df, **args) -> DataFrame`` as a step.

    An argument named like a Python keyword has an underscore behind it here.
    """

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        key = name or fn.__name__
        if key in STEPS:
            raise ValueError(f"step registered twice: {key}")
        STEPS[key] = fn
        return fn

    return add


def apply_step(df: DataFrame, op: str, args: Mapping | None = None) -> DataFrame:
    """Apply a step by name.  Arguments that it doesn't know are ignored, as are nulls."""
    if op not in STEPS:
        raise ValueError(f"unknown step: {op}")
    fn = STEPS[op]
    known = inspect.signature(fn).parameters
    given = {}
    for k, v in (args or {}).items():
        key = f"{k}_" if f"{k}_" in known else k
        if key in known and v is not None:
            given[key] = v
    return fn(df, **given)
