"""The cleaning pipeline: audited steps with an invariant on rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row

from ..operators import cleaning, combine, synthetic, transform
from ..operators.profiling import profile_dataframe, shape_from, shape_metrics, shape_of, visible
from ..storage import discard, stored_counted
from ..types import DataLossError, Notes, PipelineConfig, shape, step_row

Step = Callable[[DataFrame], tuple[DataFrame, Notes]]
ProfiledStep = Callable[[DataFrame, list[Row]], tuple[DataFrame, Notes]]
DESCRIPTIONS = {
    "coerce_types": "Convert columns to the type of their kind",
    "impute_missing": "Fill missing values",
    "handle_duplicates": "Find repeated rows",
    "handle_outliers": "Treat values outside of the quartile bounds",
    "encode_categoricals": "Encode categories as numbers",
    "engineer_features": "Derive columns",
    "scale_features": "Scale numbers",
    "combine_datasets": "Combine tables",
    "generate_synthetic": "Draw synthetic rows",
    "augment_with_synthetic": "Add synthetic rows",
}
#: Steps whose results are read by several later jobs and are dear to compute again: their tables are written.
WRITTEN = ("coerce_types", "impute_missing", "handle_duplicates")
#: Steps that may lower the number of rows, and the condition on the configuration; no step may raise it.
MAY_DROP: dict[str, Callable[[PipelineConfig], bool]] = {
    "handle_duplicates": lambda c: c.dedupe,
    "handle_outliers": lambda c: c.outlier_default_strategy == "remove" or "remove" in c.outlier_overrides.values(),
}


def written(df: DataFrame, name: str) -> tuple[DataFrame, Row]:
    """Stores a table; its shape is observed while it is written."""
    table, found = stored_counted(df, name, shape_metrics(df))
    return table, shape_from(df, found)


def run_step(df: DataFrame, name: str, step: Step, before: Row | None = None) -> tuple[DataFrame, Row]:
    """Runs a step and writes its table, which gives the shape after it; the one before can be that after the last step."""
    before = before or shape_of(df)
    began = time.perf_counter()
    out, notes = step(df)
    out, after = written(out, name)
    return out, step_row(name, DESCRIPTIONS.get(name, name), before, after, notes, time.perf_counter() - began)


def check_rows(step: Row, allow_decrease: bool = False, allow_increase: bool = False) -> None:
    delta = step.rows_after - step.rows_before
    if delta < 0 and not allow_decrease or delta > 0 and not allow_increase:
        raise DataLossError(f"{step.step} changed the rows from {step.rows_before} to {step.rows_after}")


def steps(config: PipelineConfig, order_by: list[str] | None = None) -> dict[str, ProfiledStep]:
    """The configured steps by name, in order; each takes the table and its profiles."""
    out: dict[str, ProfiledStep] = {}
    if config.coerce_types:
        out["coerce_types"] = cleaning.coerce_types
    out["impute_missing"] = lambda df, profiles: cleaning.impute_missing(
        df, numeric_strategy=config.numeric_impute_strategy, categorical_strategy=config.categorical_impute_strategy,
        datetime_strategy=config.datetime_impute_strategy, overrides=config.impute_overrides, order_by=order_by, profiles=profiles,
    )
    out["handle_duplicates"] = lambda df, profiles: cleaning.handle_duplicates(df, drop=config.dedupe, subset=config.dedupe_subset, order_by=order_by)
    out["handle_outliers"] = lambda df, profiles: transform.handle_outliers(df, default_strategy=config.outlier_default_strategy, overrides=config.outlier_overrides, profiles=profiles)
    if config.encode:
        out["encode_categoricals"] = lambda df, profiles: transform.encode_categoricals(df, one_hot_max_cardinality=config.one_hot_max_cardinality, overrides=config.encoding_overrides, profiles=profiles)
    if config.engineer_features:
        out["engineer_features"] = lambda df, profiles: transform.engineer_features(df, profiles=profiles)
    out["scale_features"] = lambda df, profiles: transform.scale_features(df, method=config.scale_method, columns=config.scale_columns, profiles=profiles)
    return out


def _shape(df: DataFrame, profiles: list[Row]) -> Row:
    """The shape that profiles of all columns amount to."""
    if not profiles:
        return shape_of(df)
    types = dict(df.dtypes)
    return shape(profiles[0].non_null + profiles[0].nulls, {p.column_name: p.nulls for p in profiles}, {p.column_name: types[p.column_name] for p in profiles})


def _refreshed(df: DataFrame, known: list[Row], touched: list[str], rows: int | None) -> list[Row]:
    """Profiles after a step: only columns that are new or touched are profiled anew, or all if rows went (``rows``: how many there should be)."""
    by_name = {p.column_name: p for p in known if p.column_name not in touched}
    changed = [c for c in visible(df) if c not in by_name]
    fresh = profile_dataframe(df, changed) if changed and rows is not None else []
    if rows is None or fresh and fresh[0].non_null + fresh[0].nulls != rows:
        return profile_dataframe(df)
    by_name |= {p.column_name: p for p in fresh}
    return [by_name[c] for c in visible(df)]


def run_pipeline(df: DataFrame, config: PipelineConfig | None = None, order_by: list[str] | None = None) -> tuple[DataFrame, list[Row]]:
    """Runs the configured steps; returns the table, which is stored, and a row of STEP for each of them.

    The table is profiled once, and after each step only where it changed. A
    step that only projects stays in the plan of the next one; the tables of
    WRITTEN steps and of the last one are written to the shared folder, where
    their shapes are observed by the way, and all but the last are removed once
    a later one has been written.
    """
    config = config or PipelineConfig()
    profiles = profile_dataframe(df)
    last, kept, trail = _shape(df, profiles), None, []
    todo = steps(config, order_by)
    for name, step in todo.items():
        began = time.perf_counter()
        out, notes = step(df, profiles)
        may_drop = MAY_DROP.get(name, lambda _: False)(config)
        final, after = name == [*todo][-1], last
        if final or name in WRITTEN and (notes.touched or may_drop):
            out, after = written(out, name)
            if kept is not None:
                discard(kept)
            kept = out
            if not final:
                profiles = _refreshed(out, profiles, notes.touched, None if after.n_rows != last.n_rows else last.n_rows)
        elif out is not df:
            profiles = _refreshed(out, profiles, notes.touched, None if may_drop else last.n_rows)
            after = _shape(out, profiles)
        trail.append(step_row(name, DESCRIPTIONS[name], last, after, notes, time.perf_counter() - began))
        check_rows(trail[-1], allow_decrease=may_drop)
        df, last = out, after
    return df, trail


def run_pipeline_multi_source(sources: list[tuple[str, DataFrame]], config: PipelineConfig | None = None, *, mode: str = "concat", on: list[str] | None = None, how: str = "outer", order_by: list[str] | None = None) -> tuple[DataFrame, list[Row]]:
    """Combines tables, then cleans the result; the combination is the first step."""
    began = time.perf_counter()
    both, notes = combine.combine_datasets(sources, mode=mode, on=on, how=how)
    combined = step_row("combine_datasets", DESCRIPTIONS["combine_datasets"], shape(0, {}, {}), shape_of(both), notes, time.perf_counter() - began)
    out, trail = run_pipeline(both, config, order_by)
    return out, [combined, *trail]


def run_synthetic_augmentation(df: DataFrame, *, n_rows: int = 100, seed: int | None = None) -> tuple[DataFrame, Row]:
    out, step = run_step(df, "augment_with_synthetic", lambda d: synthetic.augment_with_synthetic(d, n_rows=n_rows, seed=seed))
    check_rows(step, allow_increase=True)
    return out, step
