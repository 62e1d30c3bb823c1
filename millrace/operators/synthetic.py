"""Synthetic rows from the distribution of each column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import parse_datetime
from ..types import DataLossError, Notes
from .profiling import clean, family, numbers, profile_dataframe, quoted, visible
from .ranks import number_rows


def generate_synthetic(df: DataFrame, *, n_rows: int = 100, seed: int | None = None) -> tuple[DataFrame, Notes]:
    """``n_rows`` rows whose columns are drawn independently of each other.

    Numbers are drawn from the source and jittered by 3 % of their deviation,
    datetimes uniformly from their span, identifiers are placeholders, and
    all else keeps its frequencies. A value is drawn as the rank of a source
    row, so draws are a join on ranks and no column is collected.
    """
    if n_rows < 0:
        raise ValueError("n_rows is negative")
    seed = 0 if seed is None else seed
    notes = Notes(warnings=["columns are drawn by themselves: correlations are NOT preserved"])
    types = dict(df.dtypes)
    out = df.sparkSession.range(n_rows).withColumnRenamed("id", "__i")
    for k, p in enumerate(profile_dataframe(df)):
        draw = F.rand(seed + 2 * k)
        if p.kind == "empty":
            out = out.withColumn(p.column_name, F.lit(None).cast(types[p.column_name]))
        elif p.kind == "identifier":
            out = out.withColumn(p.column_name, F.concat(F.lit(f"synthetic_{p.column_name}_"), F.col("__i").cast("string")))
        elif p.kind == "datetime":
            native = family(types[p.column_name]) == "datetime"
            moment = quoted(p.column_name) if native else parse_datetime(clean(df, p.column_name).cast("string"))
            span = df.agg(*(f(F.unix_micros(moment.cast("timestamp"))) for f in (F.min, F.max))).first()
            drawn = F.timestamp_micros((F.lit(span[0]) + F.floor(draw * (span[1] - span[0] + 1))).cast("long"))
            out = out.withColumn(p.column_name, drawn.cast(types[p.column_name] if native else "timestamp_ntz"))
        else:
            binary = p.kind == "numeric" and set(p.stats.values()) and p.n_unique <= 2 and {p.stats["min"], p.stats["max"]} <= {0.0, 1.0}
            jittered = p.kind == "numeric" and not binary
            value = numbers(df, p.column_name) if jittered else clean(df, p.column_name)
            ranked = number_rows(df.select(value.alias("__v")).where("__v is not null"))
            n = p.non_null
            out = out.withColumn("__rank", F.floor(draw * n).cast("long")).join(ranked, "__rank", "left").drop("__rank")
            if jittered:
                whole = df.agg(F.bool_and(value == F.rint(value))).first()[0]
                moved = F.col("__v") + F.randn(seed + 2 * k + 1) * (0.03 * p.stats["std"])
                out = out.withColumn(p.column_name, (F.rint(moved) if whole else moved).try_cast(types[p.column_name] if family(types[p.column_name]) == "numeric" else "double")).drop("__v")
            else:
                out = out.withColumnRenamed("__v", p.column_name)
            if p.kind == "text":
                notes.warnings.append(f"{p.column_name}: free text is drawn from the source as it is")
    return out.select(*(quoted(c) for c in visible(df))), notes


def augment_with_synthetic(df: DataFrame, *, n_rows: int = 100, seed: int | None = None) -> tuple[DataFrame, Notes]:
    """The source rows followed by synthetic ones; fails if a source row is lost."""
    made, notes = generate_synthetic(df, n_rows=n_rows, seed=seed)
    source = df.select(*(quoted(c) for c in visible(df)))
    both = source.union(made.select(*(quoted(c).try_cast(t).alias(c) for c, t in source.dtypes)))
    if both.count() != source.count() + n_rows:
        raise DataLossError("augmentation changed the source rows")
    return both, notes
