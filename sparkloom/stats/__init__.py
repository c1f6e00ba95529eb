"""Statistical analyses from sufficient statistics that Spark adds up."""

from .analyses import ANALYSES, analyse, result

__all__ = ["ANALYSES", "analyse", "result"]
