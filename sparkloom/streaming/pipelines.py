"""Structured Streaming: stateless steps as they are, and windowed aggregates with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from ..functions.aggregates import aggregate
from ..plans.pipeline import run_pipeline, steps_of

#: Steps that look at one row at a time.
STATELESS = frozenset(
    "select_columns drop_columns rename_columns reorder_columns add_constant_column duplicate_column move_column "
    "filter_rows filter_rows_safe filter_by_range add_computed_column add_computed_safe add_conditional_column "
    "add_math_column drop_nulls fill_nulls replace_values change_type coalesce clean_whitespace text_trim text_lower "
    "text_upper text_replace text_split text_merge text_length text_substring text_pad text_contains text_starts_with "
    "text_ends_with date_from_text date_part date_trunc format_datetime date_diff date_add date_subtract "
    "age_calculation quarter_from_date week_of_year data_validation missing_value_flag data_type_check "
    "row_quality_score unpivot".split()
)


def stream_pipeline(stream: DataFrame, items: Sequence) -> DataFrame:
    """A pipeline of stateless steps over a stream (or a table)."""
    whole = [s.op for s in steps_of(items) if s.op not in STATELESS]
    if stream.isStreaming and whole:
        raise ValueError(f"steps that need the whole table: {', '.join(whole)}")
    return run_pipeline(stream, items)


def windowed(stream: DataFrame, time: str, every: str, aggs: Sequence[dict], group_by=(), late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates {fn, column, as} of tumbling or sliding windows; rows later than ``late`` are left out on streams."""
    own = stream.withColumn(time, compat.col(time).cast("timestamp"))
    own = own.withWatermark(time, late) if own.isStreaming else own
    window = F.window(time, every, slide) if slide else F.window(time, every)
    out = own.groupBy(window.alias("w"), *compat.cols(group_by)).agg(
        *[aggregate(a["fn"], a.get("column", "*")).alias(a["as"]) for a in aggs]
    )
    return out.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        *compat.cols(group_by),
        *[compat.col(a["as"]) for a in aggs],
    )
