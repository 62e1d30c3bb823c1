"""Outliers, encoding, features and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.parsing import word_count
from ..types import Notes, limits
from .cleaning import replaced
from .profiling import PERCENTILE_VALUES, any_of, clean, distinct_counts, family, finite, is_outlier, numbers, profile_dataframe, quoted, value_counts, visible
from .ranks import number_rows, quantiles

#: Distinct values from which label codes come by a join, not from an array.
LABEL_JOIN_VALUES = 1_000


def handle_outliers(
    df: DataFrame, *, default_strategy: str = "flag", overrides: dict[str, str] | None = None, columns: list[str] | None = None, profiles: list[Row] | None = None
) -> tuple[DataFrame, Notes]:
    """flag, clip, remove or skip values outside of the quartile bounds; all bounds come from the input."""
    notes = Notes()
    new: dict[str, Column] = {}
    flags: dict[str, Column] = {}
    masks: list[Column] = []
    for p in profiles or profile_dataframe(df):
        if p.kind != "numeric" or columns is not None and p.column_name not in columns:
            continue
        strategy = (overrides or {}).get(p.column_name, default_strategy)
        if strategy not in ("flag", "clip", "remove", "skip"):
            notes.warnings.append(f"{p.column_name}: unknown outlier strategy {strategy!r}")
            continue
        if strategy == "skip":
            if p.n_outliers:
                notes.warnings.append(f"{p.column_name}: {p.n_outliers} outliers left as they are")
            continue
        if not p.n_outliers:
            continue
        x, (low, high) = numbers(df, p.column_name), limits(p)
        if strategy == "flag":
            flags[f"{p.column_name}__is_outlier"] = is_outlier(x, limits(p))
        elif strategy == "clip":
            new[p.column_name] = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))
        else:
            masks.append(is_outlier(x, limits(p)))
        notes.details.append({"column": p.column_name, "strategy": strategy, "outlier_count": p.n_outliers, "lower": low, "upper": high})
    notes.touched = [*new]
    if masks:
        removed = df.where(any_of(masks)).count()
        notes.details.append({"strategy": "remove", "rows_removed": removed})
        df = df.where(~any_of(masks))
    kept = [c for c in df.columns if c not in flags]
    return df.select(*(new[c].alias(c) if c in new else quoted(c) for c in kept), *(x.alias(c) for c, x in flags.items())), notes


def encode_categoricals(df: DataFrame, *, one_hot_max_cardinality: int = 15, overrides: dict[str, str] | None = None, profiles: list[Row] | None = None) -> tuple[DataFrame, Notes]:
    """Booleans to 0/1, few values to indicator columns in their place, many to sorted codes; null is code -1."""
    notes = Notes()
    by_name = {p.column_name: p for p in profiles or profile_dataframe(df)}
    chosen: dict[str, str] = {}
    for c, p in by_name.items():
        if p.kind in ("identifier", "text"):
            notes.warnings.append(f"{c} looks like {'an identifier' if p.kind == 'identifier' else 'free text'} and is left as it is")
        elif p.kind == "categorical":
            strategy = (overrides or {}).get(c) or ("one_hot" if p.n_unique <= one_hot_max_cardinality else "label")
            if strategy in ("one_hot", "label"):
                chosen[c] = strategy
            elif strategy != "skip":
                notes.warnings.append(f"{c}: unknown encoding {strategy!r}")
    inline = [c for c, s in chosen.items() if s == "one_hot" or by_name[c].n_unique <= LABEL_JOIN_VALUES]
    values: dict[str, list[str]] = {c: [] for c in inline}
    if inline:
        for r in value_counts(df, inline).groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("v")).collect():
            values[r.column] = r.v
    taken = set(df.columns)
    notes.touched = [c for c, p in by_name.items() if p.kind == "boolean" or chosen.get(c) == "label"]
    out: list[Column] = []
    for c in df.columns:
        value = clean(df, c).cast("string") if c in by_name else quoted(c)
        if c in by_name and by_name[c].kind == "boolean":
            out.append(quoted(c).cast("boolean").cast("int").alias(c))
            notes.details.append({"column": c, "strategy": "boolean"})
        elif chosen.get(c) == "one_hot":
            for v in values[c]:
                if f"{c}_{v}" in taken:
                    raise ValueError(f"column {c}_{v} exists already")
                taken.add(f"{c}_{v}")
                out.append(value.eqNullSafe(F.lit(v)).cast("int").alias(f"{c}_{v}"))
            notes.details.append({"column": c, "strategy": "one_hot", "values": values[c]})
        elif c in inline:
            codes = F.create_map(*(F.lit(x) for k, v in enumerate(values[c]) for x in (v, k)))
            out.append(F.coalesce(F.try_element_at(codes, value), F.lit(-1)).cast("int").alias(c))
            notes.details.append({"column": c, "strategy": "label", "mapping": dict(zip(values[c][:20], range(20)))})
        else:
            out.append(quoted(c))
    for c in (c for c in chosen if c not in inline):
        df = _label_by_join(df, c)
        notes.details.append({"column": c, "strategy": "label"})
    return df.select(*out), notes


def _label_by_join(df: DataFrame, column: str) -> DataFrame:
    """Codes of a column with many values: its sorted distinct values are numbered, and joined."""
    distinct = df.select(clean(df, column).cast("string").alias("__value")).where("__value is not null").distinct()
    numbered = number_rows(distinct, ["__value"], "__code")
    joined = df.join(numbered, clean(df, column).cast("string") == F.col("__value"), "left")
    return joined.select(*(F.coalesce("__code", F.lit(-1)).cast("int").alias(c) if c == column else quoted(c) for c in df.columns))


def engineer_features(df: DataFrame, *, datetime_parts: bool = True, text_length: bool = True, profiles: list[Row] | None = None) -> tuple[DataFrame, Notes]:
    """Year, month, day and weekday (Monday is 0) of datetimes; characters and words of text. Null gives null."""
    notes = Notes()
    added: dict[str, Column] = {}
    for p in profiles or profile_dataframe(df):
        value = clean(df, p.column_name)
        if p.kind == "datetime" and datetime_parts and family(dict(df.dtypes)[p.column_name]) == "datetime":
            added |= {f"{p.column_name}__{n}": f(value) for n, f in (("year", F.year), ("month", F.month), ("day", F.day), ("weekday", F.weekday))}
        elif p.kind == "text" and text_length:
            added |= {f"{p.column_name}__length": F.char_length(value.cast("string")), f"{p.column_name}__word_count": word_count(value.cast("string"))}
        else:
            continue
        notes.details.append({"column": p.column_name, "kind": p.kind})
    if not added:
        notes.warnings.append("no column to derive features from")
    return df.select(*(quoted(c) for c in df.columns if c not in added), *(x.alias(c) for c, x in added.items())), notes


def scale_features(
    df: DataFrame, *, method: str = "standard", columns: list[str] | None = None, exclude_binary: bool = True, train_mask: Column | None = None, profiles: list[Row] | None = None
) -> tuple[DataFrame, Notes]:
    """standard, minmax or robust scaling, fitted where ``train_mask`` holds; 0/1 columns stay as they are."""
    notes = Notes()
    if method == "none":
        notes.warnings.append("scaling is switched off")
        return df, notes
    if method not in ("standard", "minmax", "robust"):
        raise ValueError(f"unknown scaling method {method!r}")
    names = [c for c in columns if c in visible(df)] if columns is not None else [p.column_name for p in profiles or profile_dataframe(df) if p.kind == "numeric"]
    if not names:
        return df, notes
    fit = (lambda x: F.when(train_mask, x)) if train_mask is not None else (lambda x: x)
    ranges: dict[str, list[float]] = {}
    if method == "robust":
        values = {c: fit(finite(numbers(df, c))) for c in names}
        known = {p.column_name: p.n_unique for p in profiles or []}
        unique = known | distinct_counts(df, [c for c in names if c not in known]) if any(c not in known for c in names) else known
        ranges = quantiles(df, {c: x for c, x in values.items() if unique[c] > PERCENTILE_VALUES}, (0.25, 0.5, 0.75)) if any(unique[c] > PERCENTILE_VALUES for c in names) else {}
    aggs = []
    for k, c in enumerate(names):
        x = numbers(df, c)
        y = fit(finite(x))
        pair = {"standard": (F.avg(y), F.stddev_pop(y)), "minmax": (F.min(y), F.max(y) - F.min(y)), "robust": tuple(map(F.lit, (ranges[c][1], ranges[c][2] - ranges[c][0]))) if c in ranges else (F.percentile(y, F.lit(0.5)), F.percentile(y, F.lit(0.75)) - F.percentile(y, F.lit(0.25)))}[method]
        aggs += [F.count(y).alias(f"n{k}"), F.coalesce(F.bool_and(x.isin(0.0, 1.0)), F.lit(True)).alias(f"b{k}"), pair[0].alias(f"c{k}"), pair[1].alias(f"s{k}"), F.count_if(clean(df, c).isNotNull() & x.isNull()).alias(f"l{k}"), F.count_if(x.isNull()).alias(f"m{k}")]
    row = df.agg(*aggs).first()
    new = {}
    for k, c in enumerate(names):
        if exclude_binary and row[f"b{k}"]:
            continue
        if row[f"l{k}"]:
            notes.warnings.append(f"{c}: {row[f'l{k}']} values are no numbers, column not scaled")
            continue
        if row[f"n{k}"] < 2:
            notes.warnings.append(f"{c}: fewer than two values to fit, column not scaled")
            continue
        if row[f"m{k}"]:
            notes.warnings.append(f"{c}: {row[f'm{k}']} missing values stay missing")
        center, spread = row[f"c{k}"], row[f"s{k}"] or 1.0
        new[c] = (numbers(df, c) - F.lit(center)) / F.lit(spread)
        notes.details.append({"column": c, "method": method, "center": center, "scale": spread, "fit_rows": row[f"n{k}"]})
    notes.touched = [*new]
    return replaced(df, new), notes
