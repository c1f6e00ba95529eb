"""Replayable pipelines: a list of steps folded over a DataFrame."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame

from ..operators import STEPS, apply_step


@dataclass(frozen=True)
class Step:
    op: str
    args: dict = field(default_factory=dict)


def steps_of(items: Sequence) -> list[Step]:
    return [i if isinstance(i, Step) else Step(i["op"], dict(i.get("args") or {})) for i in items]


def pipeline_hash(items: Sequence) -> str:
    """SHA-256 of the steps as JSON with sorted keys."""
    plain = [{"op": s.op, "args": s.args} for s in steps_of(items)]
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()


def run_pipeline(df: DataFrame, items: Sequence) -> DataFrame:
    """Apply the steps in order; lazy, so Catalyst sees the whole as one plan."""
    return reduce(lambda d, s: apply_step(d, s.op, s.args), steps_of(items), df)


def pipeline_view(df: DataFrame, items: Sequence, dataset: str) -> str:
    """Register a pipeline's result as a view named by the dataset and the steps' hash."""
    name = f"ds_{dataset}_p_{pipeline_hash(items)[:16]}".replace("-", "_")
    run_pipeline(df, items).createOrReplaceTempView(name)
    return name


def catalogue() -> dict[str, str]:
    """Every step's name and what it does."""
    return {name: (fn.__doc__ or "").strip().splitlines()[0] for name, fn in STEPS.items()}
