"""Dense row numbers and exact quantiles over any number of rows, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import discard, range_parts, stored

_ROW_BITS = 33  # monotonically_increasing_id holds the row below these bits and the partition above


def number_rows(df: DataFrame, order: Sequence[str] = (), name: str = "__rank") -> DataFrame:
    """``df`` with numbers from 0 in column ``name``: in the given order, or else in the order of its partitions.

    Rows are stored once in ranges of the order; a row's number is its place in
    its range and the rows of the ranges before it, one sum for each range.
    Equal rows may lie in several ranges.
    """
    columns = df.columns
    if order:
        df = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(range_parts(df), *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    placed = stored(df.withColumn("__place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__place", _ROW_BITS)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    offsets = counts.select("__part", before.alias("__before"))
    numbered = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # bounded by the number of ranges
    within = F.col("__place").bitwiseAND((1 << _ROW_BITS) - 1)
    return numbered.select(*columns, (F.col("__before") + within).alias(name))


def quantiles(df: DataFrame, values: dict[str, Column], probabilities: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles of several columns of doubles, with linear interpolation; nulls are left out.

    Equal values are counted first, which each task begins by itself, so ranges
    of the order hold different values only and no frequent one makes a range
    large. The weights of the ranges, one row for each range and column, tell
    which ranges hold the wanted places; those alone are looked at again. A
    column without values has no entry.
    """
    names = [*values]
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), x.cast("double").alias("v")) for k, x in enumerate(values.values()))))
    counts = df.select(pairs.alias("p")).select("p.k", "p.v").where("v is not null").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    ranged = stored(counts.repartitionByRange(range_parts(counts), "k", "v").withColumn("part", F.spark_partition_id()), "ranged")
    weights: dict[int, list[tuple[int, int]]] = {}
    for r in ranged.groupBy("k", "part").agg(F.sum("n").alias("n")).orderBy("k", "part").collect():
        weights.setdefault(r.k, []).append((r.part, r.n))
    total = {k: sum(n for _, n in parts) for k, parts in weights.items()}
    places = {(k, p): (n - 1) * p for k, n in total.items() for p in probabilities}
    wanted: list[tuple[int, int, int, int]] = []  # column, range, place in the column, places before the range
    for k, place in sorted({(k, f(x)) for (k, _), x in places.items() for f in (floor, ceil)}):
        before = 0
        for part, n in weights[k]:
            if place < before + n:
                wanted.append((k, part, place, before))
                break
            before += n
    at = {}
    if wanted:
        asked = df.sparkSession.createDataFrame(wanted, "k int, part int, place long, before long")
        held = ranged.join(F.broadcast(asked.select("k", "part").distinct()), ["k", "part"], "left_semi")
        within = W.partitionBy("k", "part").orderBy("v")  # a range
        summed = held.withColumn("upto", F.sum("n").over(within))
        hit = (F.col("place") - F.col("before") < F.col("upto")) & (F.col("place") - F.col("before") >= F.col("upto") - F.col("n"))
        at = {(r.k, r.place): r.v for r in summed.join(F.broadcast(asked), ["k", "part"]).where(hit).select("k", "place", "v").collect()}
    discard(ranged)
    out: dict[str, list[float]] = {}
    for (k, _), x in places.items():
        low, high = at[k, floor(x)], at[k, ceil(x)]
        out.setdefault(names[k], []).append(low + (high - low) * (x - floor(x)) if high != low else low)
    return out
