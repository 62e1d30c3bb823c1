"""Sharding by a k-d tree over document metadata.

The rows of a node are split along the dimension that is widest in it, at the
weighted median (or the quantile that fits the shards on both sides), until
each leaf is one shard. Medians come from histograms that are refined around
the target weight: Spark sums weights by bin, the driver sees a bounded number
of bins, and no row leaves the executors. Rows only carry their metadata.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import lookup_join
from .scratch import stored

#: Bits of a sort key: a dimension's code, a hash of the text, a hash of the id.
CODE_BITS, GROUP_BITS, ROW_BITS = 16, 24, 22
KEY_BITS = CODE_BITS + GROUP_BITS + ROW_BITS
#: Bits that one histogram resolves.
BIN_BITS = 12
#: A split is good enough within this share of a shard's weight.
TOLERANCE = 0.002
#: Rows of a shard that are numbered in one task.
SLOT_ROWS = 200_000
SLOT_BLOCKS = 8


def _log_code(n: Column) -> Column:
    return F.least((F.log1p(n.cast("double")) * 2500).cast("int"), F.lit((1 << CODE_BITS) - 1))


def _quantiles(rows: DataFrame, targets: dict[int, float], totals: dict[int, float], tolerance: float) -> dict[int, int]:
    """For each node, the key below which the weight is nearest to its target; ``rows`` has node, key and weight."""
    shift, found = KEY_BITS, {}
    state = {node: (0, 0.0) for node in targets}  # prefix of the bin, weight below it
    while state:
        step = min(BIN_BITS, shift)
        shift -= step
        prefix = F.create_map(*(F.lit(x).cast("long") for node, (p, _) in state.items() for x in (node, p)))
        inside = rows.where(F.col("node").isin(list(state))).withColumn("p", F.element_at(prefix, F.col("node").cast("long")))
        inside = inside.where(F.shiftright("key", shift + step) == F.col("p"))
        bins: dict[int, list] = {node: [] for node in state}
        for r in inside.groupBy("node", F.shiftright("key", shift).alias("bin")).agg(F.sum("weight").alias("w")).collect():  # nodes x 2**BIN_BITS at most
            bins[r.node].append((r.bin, r.w))
        following = {}
        for node, (_, below) in state.items():
            for at, weight in sorted(bins[node]):
                if below + weight >= targets[node]:
                    if weight <= tolerance or not shift:
                        later = below + weight - targets[node] < targets[node] - below
                        found[node] = (at + later) << shift
                    else:
                        following[node] = (at, below)
                    break
                below += weight
            else:
                found[node] = 1 << KEY_BITS
        state = following
    return found


def shard(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, doc_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """``doc_col``, ``size``, ``text_crc32``, ``shard`` and ``slot`` for each row.

    Give the number of shards, or the bytes that each should have. A row's
    size is the UTF-8 length of its text plus ``overhead``; a null text has
    none, and the crc of an empty text. Dimensions are the size, the share of
    other than ASCII bytes and the number of lines, all functions of the text,
    so equal texts share a shard unless a split must cut their group to keep
    sizes near equal. Ids may repeat. Texts of any length are measured whole;
    of rows that are equal in a dimension a split goes by the hash of the text,
    then of the id. Other columns aren't looked at. An empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text)
    mask = lambda bits: F.lit((1 << bits) - 1)
    low = F.shiftleft(F.xxhash64(text).bitwiseAND(mask(GROUP_BITS)), ROW_BITS).bitwiseOR(F.xxhash64(F.col(doc_col).cast("string")).bitwiseAND(mask(ROW_BITS)))
    rows = docs.select(
        F.col(doc_col).alias("doc"), (size + overhead).cast("long").alias("weight"), F.crc32(text.cast("binary")).alias("crc"), low.alias("low"), F.lit(0).alias("node"),
        _log_code(size).alias("c0"),
        ((size - F.char_length(text)) * 65535 / F.greatest(size, F.lit(1))).cast("int").alias("c1"),
        _log_code(size - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).alias("c2"),
    )
    rows = stored(rows, "kd-rows")
    dims = ("c0", "c1", "c2")
    total = rows.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w"), F.count(F.lit(1)).alias("n")).first()
    if n_shards is None:
        n_shards = max(1, math.ceil(total.w / target_bytes))
    leaf = total.w / n_shards
    tree = {0: (0, n_shards)}  # node -> first shard, shards
    spread: dict[str, float] = {}
    next_node = 1
    while total.n and any(n > 1 for _, n in tree.values()):
        stats = rows.groupBy("node").agg(F.sum("weight").alias("w"), *(f(c).alias(f"{f.__name__}_{c}") for c in dims for f in (F.min, F.max))).collect()
        if not spread:
            spread = {c: max(stats[0][f"max_{c}"] - stats[0][f"min_{c}"], 1) for c in dims}
        widest = {s.node: max(dims, key=lambda c: (s[f"max_{c}"] - s[f"min_{c}"]) / spread[c]) for s in stats}
        weights = {s.node: s.w for s in stats}
        split = {node: at for node, at in tree.items() if at[1] > 1 and node in weights}
        dim = F.create_map(*(F.lit(x) for node in split for x in (node, dims.index(widest[node]))))
        code = F.element_at(F.array(*dims), F.element_at(dim, F.col("node")) + 1)
        keyed = rows.where(F.col("node").isin(list(split))).select("node", "weight", F.shiftleft(code.cast("long"), GROUP_BITS + ROW_BITS).bitwiseOR(F.col("low")).alias("key"))
        targets = {node: weights[node] * (n // 2) / n for node, (_, n) in split.items()}
        keys = _quantiles(keyed, targets, weights, TOLERANCE * leaf)
        moved = F.col("node")
        for node, (first, n) in split.items():
            key = F.shiftleft(F.col(widest[node]).cast("long"), GROUP_BITS + ROW_BITS).bitwiseOR(F.col("low"))
            moved = F.when((F.col("node") == node) & (key >= keys[node]), F.lit(next_node)).otherwise(moved)
            tree[node], tree[next_node] = (first, n // 2), (first + n // 2, n - n // 2)
            next_node += 1
        tree = {node: at for node, at in tree.items() if at[1] == 1 or node in weights or node >= next_node - len(split)}
        rows = stored(rows.withColumn("node", moved), "kd-rows")
    names = F.create_map(*(F.lit(x) for node, (first, _) in tree.items() for x in (node, first)))
    rows = rows.withColumn("shard", F.element_at(names, F.col("node")))
    return _with_slots(rows, n_shards, total.n).select(F.col("doc").alias(doc_col), F.col("weight").alias("size"), F.col("crc").alias("text_crc32"), "shard", "slot")


def _with_slots(rows: DataFrame, n_shards: int, n_rows: int) -> DataFrame:
    """``slot``: the position of each row in its shard, numbered in blocks that bound what one task sorts."""
    blocks = max(SLOT_BLOCKS, math.ceil(n_rows / n_shards / SLOT_ROWS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.col("doc").cast("string"), F.lit(3)), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("part", F.concat_ws("/", "shard", "block"))
    sizes = rows.groupBy("shard", "block", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = stored(sizes.select("part", before.alias("before")), "slots")
    number = F.row_number().over(W.partitionBy("part").orderBy("doc", "low"))
    return lookup_join(rows.withColumn("number", number), starts, "part").withColumn("slot", (F.col("before") + F.col("number") - 1).cast("long"))
