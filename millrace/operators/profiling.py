"""Column profiles: aggregates over all columns at once, one shuffle of hashes for their distinct values."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parsing import FALSE_WORDS, TRUE_WORDS, parse_datetime, parse_number, strip
from ..types import ROW_ID, limits, shape
from .ranks import quantiles

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
NESTED = ("array", "struct", "map", "binary", "variant")
UNIQUE_LIMIT, UNIQUE_SHARE, IDENTIFIER_ROWS, KIND_SHARE = 50, 0.5, 20, 0.95
#: Text with so large a share of numbers is not tried as dates.
DATE_SHARE = 0.9
QUARTILES = (0.25, 0.5, 0.75)
#: Different values up to which one aggregate buffer holds a column for its quantiles.
PERCENTILE_VALUES = 1_000_000


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def family(dtype: str) -> str:
    """numeric, boolean, datetime, string or nested."""
    if dtype.startswith(NUMERIC):
        return "numeric"
    if dtype == "boolean":
        return "boolean"
    if dtype.startswith(("timestamp", "date")):
        return "datetime"
    return "nested" if dtype.startswith(NESTED) else "string"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN as null, and nested values as JSON text."""
    dtype, c = dict(df.dtypes)[name], quoted(name)
    if dtype in ("float", "double"):
        return F.when(~F.isnan(c), c)
    if family(dtype) == "nested":
        return F.to_json(c) if not dtype.startswith("binary") else F.base64(c)
    return c


def numbers(df: DataFrame, name: str) -> Column:
    """The column's values as doubles, by parsing where it is text."""
    kind = family(dict(df.dtypes)[name])
    return clean(df, name).cast("double") if kind == "numeric" else parse_number(clean(df, name).cast("string"))


def finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


def shape_metrics(df: DataFrame) -> dict[str, Column]:
    """Aggregates of which ``shape_from`` makes a table's shape."""
    return {"rows": F.count(F.lit(1))} | {f"n{k}": F.count_if(clean(df, c).isNull()) for k, c in enumerate(visible(df))}


def shape_from(df: DataFrame, found: dict) -> Row:
    return shape(found["rows"], {c: found[f"n{k}"] for k, c in enumerate(visible(df))}, {c: t for c, t in df.dtypes if c != ROW_ID})


def shape_of(df: DataFrame) -> Row:
    return shape_from(df, df.agg(*(x.alias(k) for k, x in shape_metrics(df).items())).first().asDict())


def classify(dtype: str, non_null: int, unique: int, numeric_ratio: float, datetime_ratio: float, is_boolean: bool) -> str:
    """The kind of a column from its counts."""
    kind = family(dtype)
    if not non_null:
        return "empty"
    if kind in ("boolean", "datetime", "numeric"):
        return kind
    if kind == "nested":
        return "text"
    if is_boolean:
        return "boolean"
    if numeric_ratio >= KIND_SHARE:
        return "numeric"
    if datetime_ratio >= KIND_SHARE:
        return "datetime"
    if unique == non_null and non_null > IDENTIFIER_ROWS:
        return "identifier"
    return "categorical" if unique <= UNIQUE_LIMIT or unique / non_null <= UNIQUE_SHARE else "text"


def iqr_bounds(n: int, q1: float | None, q3: float | None) -> tuple[float, float] | None:
    """Outlier bounds; none under four values or without spread."""
    if n < 4 or q1 is None or q3 is None or q3 == q1:
        return None
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def value_counts(df: DataFrame, names: list[str], order: Column | None = None) -> DataFrame:
    """``column``, ``value`` (text), ``n`` and, with ``order``, ``first``: all columns in one shuffle."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), clean(df, c).cast("string").alias("value")) for c in names)))
    rows = df.select(*([order.alias("at")] if order is not None else []), pairs.alias("p")).where("p.value is not null")
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.min("at").alias("first")] if order is not None else [])
    return rows.groupBy(F.col("p.column").alias("column"), F.col("p.value").alias("value")).agg(*aggs)


def distinct_counts(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Distinct values of each column; values are shuffled as 128-bit hashes, never as text."""
    hashed = (F.struct(F.lit(k).alias("k"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(k), v).alias("h2"), v.isNotNull().alias("there")) for k, c in enumerate(names) for v in (clean(df, c),))
    rows = df.select(F.explode(F.array(*hashed)).alias("p")).where("p.there").select("p.k", "p.h1", "p.h2")
    found = {r.k: r.u for r in rows.distinct().groupBy("k").agg(F.count(F.lit(1)).alias("u")).collect()}
    return {c: found.get(k, 0) for k, c in enumerate(names)}


def first_values(df: DataFrame, names: list[str], order: Column, limit: int = 5) -> dict[str, list[str]]:
    """The first distinct values of each column; tasks hand on ``limit`` rows of a column at most."""
    place = F.row_number().over(W.partitionBy("column").orderBy("first", "value"))
    rows = value_counts(df, names, order).select("column", "value", "first", place.alias("place")).where(F.col("place") <= limit).collect()
    found: dict[str, list[str]] = {c: [] for c in names}
    for r in sorted(rows, key=lambda r: r.place):
        found[r.column].append(r.value)
    return found


def quartiles_of(df: DataFrame, names: list[str], unique: dict[str, int]) -> dict[str, list[float]]:
    """Quartiles of numeric columns: by one aggregate where they have few different values, else by a distributed sort."""
    few = [c for c in names if unique[c] <= PERCENTILE_VALUES]
    found: dict[str, list[float]] = {}
    if few:
        row = df.agg(*(F.percentile(finite(numbers(df, c)), F.array(*map(F.lit, QUARTILES))).alias(f"q{k}") for k, c in enumerate(few))).first()
        found = {c: list(row[f"q{k}"]) for k, c in enumerate(few) if row[f"q{k}"] is not None}
    if rest := [c for c in names if c not in few]:
        found |= quantiles(df, {c: finite(numbers(df, c)) for c in rest}, QUARTILES)
    return found


def _counts(df: DataFrame, names: list[str], stats: bool) -> tuple[Row, dict[int, float], dict[int, float]]:
    """Counts of rows and values, with ``stats`` those of numbers too; and the shares of numbers and of dates in text columns, by their places.

    Dates are looked for only in text that is neither numeric nor boolean.
    """
    types = dict(df.dtypes)
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    made: list[Column] = []  # values that several aggregates look at are computed once for each row
    for k, c in enumerate(names):
        kind, value = family(types[c]), F.col(f"v{k}")
        made.append(clean(df, c).alias(f"v{k}"))
        aggs.append(F.count(value).alias(f"n{k}"))
        if kind == "string":
            aggs += [F.count(f"x{k}").alias(f"num{k}"), F.bool_and(F.lower(strip(value)).isin(*TRUE_WORDS, *FALSE_WORDS)).alias(f"bool{k}")]
        if kind == "string" or stats and kind == "numeric":
            made.append(numbers(df, c).alias(f"x{k}"))
        if stats and kind in ("string", "numeric"):
            aggs += [f(finite(F.col(f"x{k}"))).alias(f"{f.__name__}{k}") for f in (F.min, F.max, F.avg, F.stddev_samp, F.count)]
    row = df.select(*made).agg(*aggs).first()
    numeric = {k: row[f"num{k}"] / row[f"n{k}"] if row[f"n{k}"] else 0.0 for k, c in enumerate(names) if family(types[c]) == "string"}
    maybe_dates = [k for k, share in numeric.items() if row[f"n{k}"] and share < DATE_SHARE]
    found = df.agg(*(F.count(parse_datetime(clean(df, names[k]))).alias(f"dt{k}") for k in maybe_dates)).first() if maybe_dates else None
    return row, numeric, {k: found[f"dt{k}"] / row[f"n{k}"] for k in maybe_dates}


def kinds(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """The kind of each column, as profiles have it, without their statistics; values are told apart only where the kind depends on it."""
    names, types = columns or visible(df), dict(df.dtypes)
    if not names:
        return {}
    row, numeric, dates = _counts(df, names, False)
    kind = lambda k, unique: classify(types[names[k]], row[f"n{k}"], unique, numeric.get(k, 0.0), dates.get(k, 0.0), k in numeric and bool(row[f"bool{k}"]))
    asked = [c for k, c in enumerate(names) if kind(k, 0) != kind(k, row[f"n{k}"]) or kind(k, 0) == "categorical"]
    unique = distinct_counts(df, asked) if asked else {}
    return {c: kind(k, unique.get(c, 0)) for k, c in enumerate(names)}


def profile_dataframe(df: DataFrame, columns: list[str] | None = None, order_by: list[str] | None = None, samples: bool = False, outlier_keys: list[str] | None = None) -> list[Row]:
    """A profile of each column, a row of PROFILE.

    Dates are looked for only in text that is neither numeric nor boolean.
    ``samples`` adds the first distinct values, in the order of ``order_by``;
    ``outlier_keys`` the keys of the first outlying rows, in their own order.
    """
    names = columns or visible(df)
    if not names:
        return []
    outlier_keys = outlier_keys or ([ROW_ID] if ROW_ID in df.columns else None)
    types = dict(df.dtypes)
    row, numeric, dates = _counts(df, names, True)
    unique = distinct_counts(df, names)
    out: dict[str, dict] = {}
    for k, c in enumerate(names):
        n, kind = row[f"n{k}"], family(types[c])
        p = {"position": k, "column_name": c, "kind": "", "non_null": n, "nulls": row.rows - n, "null_ratio": (row.rows - n) / row.rows if row.rows else 0.0, "n_unique": unique[c], "numeric_ratio": 0.0, "datetime_ratio": 0.0, "samples": [], "n_outliers": 0, "outlier_rows": [], "stats": {}}
        if kind == "string":
            p["numeric_ratio"], p["datetime_ratio"] = numeric[k], dates.get(k, 0.0)
        elif n:
            p["numeric_ratio"], p["datetime_ratio"] = float(kind == "numeric"), float(kind == "datetime")
        p["kind"] = classify(types[c], n, unique[c], p["numeric_ratio"], p["datetime_ratio"], kind == "string" and bool(row[f"bool{k}"]))
        if p["kind"] == "numeric" and row[f"count{k}"]:
            p["stats"] = {"min": row[f"min{k}"], "max": row[f"max{k}"], "mean": row[f"avg{k}"], "std": row[f"stddev_samp{k}"] or 0.0}
        out[c] = p
    for c, q in quartiles_of(df, [c for c, p in out.items() if p["stats"]], unique).items():
        stats, bounds = out[c]["stats"], iqr_bounds(row[f"count{out[c]['position']}"], q[0], q[2])
        stats |= dict(zip(("q1", "median", "q3"), q)) | (dict(zip(("low", "high"), bounds)) if bounds else {})
    bounded = [c for c, p in out.items() if "low" in p["stats"]]
    if bounded:
        outside = {c: is_outlier(numbers(df, c), (out[c]["stats"]["low"], out[c]["stats"]["high"])) for c in bounded}
        counts = df.agg(*(F.count_if(x).alias(f"o{k}") for k, x in enumerate(outside.values()))).first()
        for k, c in enumerate(bounded):
            out[c]["n_outliers"] = counts[k]
            if outlier_keys and counts[k]:
                out[c]["outlier_rows"] = [json.dumps(r[0] if len(r) == 1 else [*r], default=str) for r in outlier_rows(df, Row(**out[c]), outlier_keys).collect()]
    if samples:
        for c, found in first_values(df, names, position(df, order_by)).items():
            out[c]["samples"] = found
    return [Row(**p) for p in out.values()]


def is_outlier(x: Column, bounds: tuple[float, float] | None) -> Column:
    """Strictly outside of the bounds; null is inside."""
    return F.lit(False) if bounds is None else F.coalesce((x < bounds[0]) | (x > bounds[1]), F.lit(False))


def position(df: DataFrame, order_by: list[str] | None) -> Column:
    """What rows are sorted by: ``order_by``, the position from ingestion, or else all columns."""
    names = order_by or ([ROW_ID] if ROW_ID in df.columns else df.columns)
    return F.struct(*(quoted(c) for c in names)) if len(names) > 1 else quoted(names[0])


def outlier_rows(df: DataFrame, profile: Row, order_by: list[str], limit: int = 100) -> DataFrame:
    """Keys of the first outlying rows."""
    return df.where(is_outlier(numbers(df, profile.column_name), limits(profile))).select(*order_by).orderBy(*order_by).limit(limit)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
