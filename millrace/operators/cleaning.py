"""Type coercion, imputation and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parsing import parse_boolean, parse_datetime
from ..storage import SMALL_ROWS, range_parts, stored
from ..types import ROW_ID, Notes
from .profiling import PERCENTILE_VALUES, clean, family, numbers, position, profile_dataframe, quoted, visible

#: Repeated rows that a report names.
NAMED_DUPLICATES = 200


def replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One projection in which some columns are computed anew."""
    return df.select(*(new[c].alias(c) if c in new else quoted(c) for c in df.columns)) if new else df


def coerce_types(df: DataFrame, profiles: list[Row] | None = None) -> tuple[DataFrame, Notes]:
    """Casts columns to the type of their kind; what can't be parsed becomes null and is counted."""
    notes = Notes()
    new: dict[str, Column] = {}
    for p in profiles or profile_dataframe(df):
        parse = {"numeric": numbers(df, p.column_name), "boolean": parse_boolean(clean(df, p.column_name).cast("string")), "datetime": parse_datetime(clean(df, p.column_name).cast("string"))}.get(p.kind)
        if parse is None:
            continue
        typed = family(dict(df.dtypes)[p.column_name]) == p.kind
        new[p.column_name] = clean(df, p.column_name) if typed else parse
        notes.touched += [] if typed else [p.column_name]
        notes.details.append({"column": p.column_name, "to": p.kind, "failed_count": 0})
    if new:
        failed = df.agg(*(F.count_if(clean(df, c).isNotNull() & x.isNull()).alias(f"f{k}") for k, (c, x) in enumerate(new.items()))).first()
        for k, detail in enumerate(notes.details):
            detail["failed_count"] = failed[k]
            if failed[k]:
                notes.warnings.append(f"{failed[k]} values of {detail['column']} could not be converted to {detail['to']} and are missing now")
    return replaced(df, new), notes


def fill_forward_backward(df: DataFrame, columns: list[str], order_by: list[str] | None = None) -> DataFrame:
    """Each null takes the last value before it, or else the first one after it.

    Rows are dealt out by ranges of the order and stored, so that all later
    reads see the same ranges. Each range is filled forward by itself; the last
    values of the ranges before it and the first ones from it on, one row for
    each range, are carried over, so no task sees more than its range. Rows
    that are equal in the order may be taken in any order, and however many
    there are, they may lie in several ranges.
    """
    names = order_by or ([ROW_ID] if ROW_ID in df.columns else df.columns)
    clear = df.select(*(clean(df, c).alias(c) if c in columns else quoted(c) for c in df.columns))
    order = [*(quoted(c) for c in names), F.col("__tie")]
    ranged = clear.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(range_parts(clear), *order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("__part", F.spark_partition_id()), "ranged")
    key = F.struct(*order)
    edges = ranged.groupBy("__part").agg(
        *(x.alias(f"{side}{k}") for k, c in enumerate(columns) for side, x in (("l", F.max_by(quoted(c), F.when(quoted(c).isNotNull(), key))), ("f", F.min_by(quoted(c), F.when(quoted(c).isNotNull(), key)))))
    )
    over = W.orderBy("__part")  # a row for each range
    carried = edges.select("__part", *(
        x.alias(f"{side}{k}") for k in range(len(columns)) for side, x in (
            ("l", F.last(f"l{k}", True).over(over.rowsBetween(W.unboundedPreceding, -1))), ("f", F.first(f"f{k}", True).over(over.rowsBetween(0, W.unboundedFollowing))))
    ))
    of = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    filled = ranged.join(F.broadcast(carried), "__part")  # bounded by the number of ranges
    # What is still null stands before its range's first value and has none in an earlier range.
    new = {c: F.coalesce(quoted(c), F.last(quoted(c), True).over(of), F.col(f"l{k}"), F.col(f"f{k}")) for k, c in enumerate(columns)}
    return filled.select(*(new[c].alias(c) if c in new else quoted(c) for c in df.columns))


def most_frequent(df: DataFrame, profiles: list[Row]) -> dict[str, object]:
    """The most frequent value of each column, the least one of several: in one aggregate where values are few, else by counts of each value."""
    few = [p.column_name for p in profiles if p.n_unique <= PERCENTILE_VALUES]
    found = dict(zip(few, df.agg(*(F.mode(clean(df, c), True) for c in few)).first())) if few else {}
    for c in (p.column_name for p in profiles if p.column_name not in few):
        counts = df.select(clean(df, c).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        found[c] = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), "v"))).first()[0].v
    return found


def impute_missing(
    df: DataFrame, *, numeric_strategy: str = "median", categorical_strategy: str = "mode", datetime_strategy: str = "ffill_bfill",
    overrides: dict[str, str] | None = None, order_by: list[str] | None = None, profiles: list[Row] | None = None,
) -> tuple[DataFrame, Notes]:
    """Fills nulls by strategy: mean, median, mode, ffill_bfill, constant:<value> or skip."""
    notes = Notes()
    by_kind = {"numeric": numeric_strategy, "datetime": datetime_strategy} | dict.fromkeys(("categorical", "boolean", "text", "identifier"), categorical_strategy)
    constants: dict[str, Column] = {}
    fills: dict[str, object] = {}
    modes: dict[str, Row] = {}
    carried: list[str] = []
    plan: dict[str, str] = {}
    types = dict(df.dtypes)
    nulls = {}
    for p in profiles or profile_dataframe(df):
        if not p.nulls:
            continue
        nulls[p.column_name] = p.nulls
        strategy = (overrides or {}).get(p.column_name) or by_kind.get(p.kind, "skip")
        plan[p.column_name] = strategy
        if strategy == "skip":
            notes.warnings.append(f"{p.column_name}: {p.nulls} missing values left as they are")
        elif strategy in ("mean", "median") and p.kind == "numeric":
            if strategy in p.stats:
                fills[p.column_name] = p.stats[strategy]
        elif strategy == "mode":
            modes[p.column_name] = p
        elif strategy == "ffill_bfill":
            carried.append(p.column_name)
        elif strategy.startswith("constant:"):
            constant = F.lit(strategy.split(":", 1)[1]).try_cast(types[p.column_name])
            if df.sparkSession.range(1).select(constant.isNull()).first()[0]:
                notes.warnings.append(f"{p.column_name}: the constant does not fit type {types[p.column_name]}, column left as it is")
                plan[p.column_name] = "skip"
            else:
                constants[p.column_name] = constant
        else:
            notes.warnings.append(f"{p.column_name}: strategy {strategy!r} is not applicable to kind {p.kind}")
            plan[p.column_name] = "skip"
    fills |= {c: v for c, v in most_frequent(df, [*modes.values()]).items() if v is not None}
    new: dict[str, Column] = {}
    for c, value in fills.items():
        base = numbers(df, c) if plan[c] in ("mean", "median") else clean(df, c)
        literal = F.lit(value) if plan[c] in ("mean", "median") else F.lit(value).cast(types[c])
        new[c] = F.coalesce(base, literal)
    new |= {c: F.coalesce(clean(df, c), x) for c, x in constants.items()}
    notes.touched = [*new, *carried]
    filled = replaced(df, new)
    if carried:
        filled = fill_forward_backward(filled, carried, order_by)
    for c, strategy in plan.items():
        done = c in new or c in carried
        notes.details.append({"column": c, "strategy": strategy, "filled_count": nulls[c] if done else 0, "fill_value": None if c not in fills else str(fills[c])})
        if not done and strategy != "skip":
            notes.warnings.append(f"{c}: {nulls[c]} values are still missing")
    return filled, notes


def _hashed(df: DataFrame, keys: list[str], order_by: list[str] | None) -> DataFrame:
    """``df`` with a 128-bit hash of its keys, in which NaN is null and -0.0 is 0.0, and ``__at``, what rows are ordered by."""
    marked = [x for c in keys for x in (clean(df, c), clean(df, c).isNull())]  # hashes skip nulls
    return df.withColumns({"__h1": F.xxhash64(*marked), "__h2": F.xxhash64(F.lit(1), *marked), "__at": F.struct(position(df, order_by))})


def duplicate_flags(df: DataFrame, subset: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """``df`` with boolean ``__duplicate``: an earlier row has the same values; nulls are equal, NaN is one.

    Rows are numbered and stored; the first of each key comes from an aggregate
    that each task begins by itself, so a frequent key is no single task's.
    """
    numbered = stored(_hashed(df, subset or visible(df), order_by).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    at = F.struct("__at", "__row")
    first = numbered.groupBy("__h1", "__h2").agg(F.min(at).alias("__first"))
    return numbered.join(first, ["__h1", "__h2"]).select(*(quoted(c) for c in df.columns), (at > F.col("__first")).alias("__duplicate"))


def handle_duplicates(df: DataFrame, *, drop: bool = False, subset: list[str] | None = None, order_by: list[str] | None = None) -> tuple[DataFrame, Notes]:
    """Counts rows that repeat an earlier one, by 128-bit hashes, names the first of them by ``order_by``, and drops them if asked to.

    One aggregate gives the keys that come up more than once, each with its
    least position. Rows of other keys stay where they are; of the rows of
    those, an aggregate keeps the first, so neither needs all rows of a key in
    one task. NaN counts as null.
    """
    notes = Notes()
    keys = subset or visible(df)
    hashed = _hashed(df, keys, order_by)
    repeated = stored(hashed.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first")).where("__n > 1"), "repeated")
    found = repeated.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("d"), F.count(F.lit(1)).alias("k")).first()
    several = F.broadcast(repeated) if found.k <= SMALL_ROWS else repeated
    named = order_by or ([ROW_ID] if ROW_ID in df.columns else None)
    first = []
    if found.d and named:
        rows = hashed.join(several, ["__h1", "__h2"]).where(F.col("__at") > F.col("__first")).select(*(quoted(c) for c in named)).orderBy(*(quoted(c) for c in named)).limit(NAMED_DUPLICATES).collect()
        first = [r[0] if len(named) == 1 else tuple(r) for r in rows]
    notes.details.append({"duplicate_count": found.d, "dropped": bool(drop), "first_duplicates": first})
    if found.d and not drop:
        notes.warnings.append(f"{found.d} duplicate rows found and NOT removed")
    if drop and found.d:
        marked = hashed.join(several.drop("__first"), ["__h1", "__h2"], "left")
        columns = [quoted(c) for c in df.columns]
        order = F.struct("__at", F.xxhash64(*columns)) if not any(t.startswith("map") for _, t in df.dtypes) else F.struct("__at")
        firsts = marked.where("__n is not null").groupBy("__h1", "__h2").agg(F.min_by(F.struct(*columns), order).alias("__r"))
        df = marked.where("__n is null").select(*columns).union(firsts.select(*(F.col("__r")[c].alias(c) for c in df.columns)))
    return df, notes
