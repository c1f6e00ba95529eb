"""Pipelines over streams."""

from .pipelines import STATELESS, stream_pipeline, windowed

__all__ = ["STATELESS", "stream_pipeline", "windowed"]
