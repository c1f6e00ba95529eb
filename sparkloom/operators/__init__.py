"""The named steps of a pipeline, in families; :data:`STEPS` holds them all."""

from . import aggregation, cleaning, computed, dates, filters, quality, rows, shaping, statistics, text, windows  # noqa: F401
from .registry import STEPS, apply_step

__all__ = ["STEPS", "apply_step"]
