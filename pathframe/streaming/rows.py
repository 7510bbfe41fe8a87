"""Expressions over streams: rows are independent, so the typed and document forms need no state."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathframe.plans.column import lower_row

if TYPE_CHECKING:
    from pathframe.api import Expression


def select_stream(expression: Expression, stream: DataFrame) -> DataFrame:
    """The expression for each row of a stream: a column for each field of an object, else ``value``."""
    v = lower_row(expression, stream)
    if v.fields is not None:
        return stream.select(*[f.as_column().alias(k) for k, f in v.fields.items()])
    return stream.select(v.as_column().alias("value"))


def windowed_groups(expression: Expression, stream: DataFrame, time: str, window: str, watermark: str) -> DataFrame:
    """``(window, key, n)``: rows of each key, a text per row, in event-time windows; late rows are dropped past the watermark."""
    key = lower_row(expression, stream).as_column().alias("key")
    keyed = stream.withWatermark(time, watermark).select(F.col(time), key)
    return keyed.groupBy(F.window(time, window), "key").agg(F.count("*").alias("n"))
