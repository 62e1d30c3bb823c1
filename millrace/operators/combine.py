"""Concatenation and merging of named tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import stored, stored_counted
from ..types import Notes
from .profiling import clean, family, quoted, visible

SOURCE = "__source_file"
#: The sides of which a row of each kind of join must have one.
SIDES = {"outer": (), "left": ("__left",), "right": ("__right",), "inner": ("__left", "__right")}


def combine_datasets(sources: list[tuple[str, DataFrame]], *, mode: str = "concat", on: list[str] | None = None, how: str = "outer") -> tuple[DataFrame, Notes]:
    """Unions tables by column name, or joins them from left to right on keys where null equals null."""
    if not sources:
        raise ValueError("no sources to combine")
    notes = Notes()
    if len(sources) == 1:
        return sources[0][1], notes
    if mode == "concat":
        return concat(sources, notes), notes
    if mode != "merge":
        raise ValueError(f"unknown mode {mode!r}")
    if not on:
        raise ValueError("merge needs keys")
    return merge(sources, on, how, notes), notes


def concat(sources: list[tuple[str, DataFrame]], notes: Notes) -> DataFrame:
    names = list(dict.fromkeys(c for _, df in sources for c in visible(df) if c != SOURCE))
    types = {c: {dict(df.dtypes)[c] for _, df in sources if c in df.columns} for c in names}
    tables, counts = [], []
    for name, df in sources:
        if SOURCE in df.columns:
            notes.warnings.append(f"{name}: its {SOURCE} is replaced")
        missing = [c for c in names if c not in df.columns]
        if missing:
            notes.warnings.append(f"{name}: has no {', '.join(missing)}, filled with missing values")
        columns = [(quoted(c) if len(types[c]) == 1 else quoted(c).cast("string")).alias(c) if c in df.columns else F.lit(None).cast(next(iter(types[c])) if len(types[c]) == 1 else "string").alias(c) for c in names]
        counts.append(Observation())
        tables.append(df.observe(counts[-1], F.count(F.lit(1)).alias("n")).select(*columns, F.lit(name).alias(SOURCE)))
    both, produced = stored_counted(reduce(DataFrame.union, tables), "concat", {"n": F.count(F.lit(1))})
    notes.details.append({"sources": [n for n, _ in sources], "union_columns": names, "rows_expected": sum(c.get["n"] for c in counts), "rows_produced": produced["n"]})
    return both


def merge(sources: list[tuple[str, DataFrame]], on: list[str], how: str, notes: Notes) -> DataFrame:
    """Each table is read once and joined to what stands so far, both sides whole and marked; all numbers of the report are counted while the rows that the join keeps are written."""
    if how not in SIDES:
        raise ValueError(f"unknown join {how!r}")
    for name, df in sources:
        if lost := [c for c in on if c not in df.columns]:
            raise ValueError(f"{name} has no key {', '.join(lost)}")
    left = sources[0][1].select(*(quoted(c) for c in visible(sources[0][1])))
    produced = left.count()
    for position, (name, df) in enumerate(sources[1:], 2):
        for key in on:
            if family(dict(left.dtypes)[key]) != family(dict(df.dtypes)[key]):
                raise ValueError(f"key {key} has another type in {name}")
        rest = [c for c in visible(df) if c not in on]
        names = {}
        for c in rest:
            names[c] = c if c not in left.columns else f"{c}__{name}"
            if names[c] in left.columns:
                names[c] = f"{c}__{name}_{position}"
        right = df.select(*(quoted(c).alias(f"__key{k}") for k, c in enumerate(on)), *(quoted(c).alias(names[c]) for c in rest))
        left, right = left.withColumn("__left", F.lit(True)), right.withColumn("__right", F.lit(True))
        same = reduce(lambda a, b: a & b, (left[f"`{c}`"].eqNullSafe(right[f"__key{k}"]) for k, c in enumerate(on)))
        keys = {c: F.coalesce(quoted(c), F.col(f"__key{k}")) for k, c in enumerate(on)}
        both = left.join(right, same, "full").select(*(keys[c].alias(c) if c in keys else quoted(c) for c in left.columns), *(quoted(names[c]) for c in rest), "__right")
        there = {"__left": F.col("__left").isNotNull(), "__right": F.col("__right").isNotNull()}
        kept = reduce(lambda a, b: a & b, (there[s] for s in SIDES[how]), F.lit(True))
        null_key = reduce(lambda a, b: a | b, (clean(both, c).isNull() for c in on))
        watch = Observation()
        counted_ = both.observe(watch, F.count_if(~there["__right"]).alias("left"), F.count_if(~there["__left"]).alias("right"), F.count_if(kept).alias("produced"), F.count_if(kept & null_key).alias("null_keys"))
        left = stored(counted_.where(kept).drop("__left", "__right"), "merged")
        before, found = produced, watch.get
        produced, null_keys, unmatched = found["produced"], found["null_keys"], found
        notes.details.append({"merged": name, "rows_before": before, "rows_produced": produced, "null_key_rows": null_keys if how != "inner" else 0, "unmatched_left": unmatched["left"], "unmatched_right": unmatched["right"]})
        notes.warnings.append(f"{name}: {before} rows became {produced} ({how} join); {unmatched['left']} rows before and {unmatched['right']} of {name} have no match, {null_keys} rows have a null key")
    notes.details.append({"sources": [n for n, _ in sources], "join_on": on, "how": how, "rows_produced": produced})
    return left


def counted(df: DataFrame, on: list[str]) -> tuple[int, int]:
    """Rows, and rows with a null in a key."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(reduce(lambda a, b: a | b, (clean(df, c).isNull() for c in on))).alias("k")).first()
    return row.n, row.k


def null_key_rows(df: DataFrame, on: list[str]) -> int:
    """Rows of a merge's result with a null in a key."""
    return counted(df, on)[1]
