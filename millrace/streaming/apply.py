"""Fitted steps on streams: parameters come from a batch, rows are changed one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import replaced
from ..operators.profiling import is_outlier, numbers, quoted
from ..types import Notes


def apply_scaling(stream: DataFrame, notes: Notes) -> DataFrame:
    """Scales a stream with the parameters of the notes of a scaling."""
    return replaced(stream, {d["column"]: (numbers(stream, d["column"]) - F.lit(d["center"])) / F.lit(d["scale"]) for d in notes.details})


def apply_outlier_flags(stream: DataFrame, notes: Notes) -> DataFrame:
    """Flags a stream with the bounds of the notes on outliers."""
    return stream.select("*", *(is_outlier(numbers(stream, d["column"]), (d["lower"], d["upper"])).alias(f"{d['column']}__is_outlier") for d in notes.details))


def apply_fills(stream: DataFrame, notes: Notes) -> DataFrame:
    """Fills nulls of a stream with the values of the notes of an imputation."""
    types = dict(stream.dtypes)
    return replaced(stream, {d["column"]: F.coalesce(quoted(d["column"]), F.lit(d["fill_value"]).try_cast(types[d["column"]])) for d in notes.details if d["fill_value"] is not None})


def drop_repeats(stream: DataFrame, keys: list[str], time_column: str, delay: str) -> DataFrame:
    """Drops rows that repeat others within the watermark."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(keys)
