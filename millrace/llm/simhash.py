"""Near duplicates by SimHash: a self-join of a binary trie of 64-bit fingerprints.

A fingerprint is a path of a binary trie, its first bit on top. Pairs of trie
nodes are traversed together from (root, root): each pair is replaced by the
pairs of its children, bits that differ are added up, and a pair is given up
once they exceed the budget. Spark does so with tables of nodes as long as
nodes are large, four bits at a time; a dense node is opened further than a
sparse one. Pairs of nodes with few fingerprints are joined inside tasks, where
the same traversal goes on bit by bit over all pairs of a batch at once.

Different fingerprints only are joined, and one has 2,080 neighbours within two
bits at most, so no group of copies grows with its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jaccard_join import connected
from .joins import checked_broadcast
from .scratch import discard, small_batches, stored
from .textkit import blank_words, text_bytes

BITS = 64
SEED = 42
#: Differing bits up to which two fingerprints link.
BUDGET = 2
#: A node with more fingerprints is opened by Spark, one with fewer inside a task.
NODE_SIZE = 2048
#: Bits by which Spark opens nodes.
STEP = 4
#: Pairs of fingerprints that are compared directly once two nodes hold no more.
DIRECT = 16
#: Pairs of nodes that one task traverses at once.
PAIRS_AT_ONCE = 64


def _fingerprint(text: memoryview, shingle: int) -> int:
    """The SimHash of all shingles of a text, repeats included, as a signed integer."""
    total, ones, before = 0, np.zeros(BITS, np.int64), []
    for words in blank_words(text):
        words = before + words
        if len(words) < shingle:
            before = words
            continue
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)))]
        ones += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes)
        before = words[len(words) - shingle + 1 :]
    if not total and before:
        ones += np.unpackbits(np.array([xxhash.xxh64_intdigest(b" ".join(before), SEED)], ">u8").view(np.uint8))
        total = 1
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def _fingerprint_batches(shingle: int):
    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_fingerprint(text, shingle) for text in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc", "print"])

    return batches_of


def fingerprints(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc`` and ``print`` (a signed 64-bit integer) for each row; a text without words has the fingerprint 0."""
    kind = docs.schema[doc_col].dataType.simpleString()
    return docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(_fingerprint_batches(shingle), f"doc {kind}, print long")


def _mask(depth: Column | int) -> Column:
    """The first ``depth`` bits."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), (BITS - depth).cast("int")))


def _nodes(prints: DataFrame, node_size: int) -> tuple[DataFrame, list[DataFrame]]:
    """For each fingerprint its leaf, the first node of the trie's opened levels that is small enough; and for each level (``parent``, ``node``, ``depth``, ``leaf``), leaves above it included as their own children."""
    count = prints.count()
    depth = max(0, ceil(log2(max(1, count / node_size))))
    above = [*range(STEP, depth, STEP), depth] if depth else [0]
    levels, leaves, rest, parents = [], [], prints, 0
    for d in above[:-1]:
        level = prints.select(F.col("print").bitwiseAND(_mask(parents)).alias("parent"), F.col("print").bitwiseAND(_mask(d)).alias("node")).distinct()
        levels.append(stored(level.select("parent", "node", F.lit(d).alias("depth"), F.lit(False).alias("leaf")), "nodes"))
        parents = d
    while True:
        at = F.col("print").bitwiseAND(_mask(depth))
        sizes = rest.groupBy(F.col("print").bitwiseAND(_mask(parents)).alias("parent"), at.alias("node")).agg(F.count(F.lit(1)).alias("n"))
        level = sizes.select("parent", "node", F.lit(depth).alias("depth"), (F.col("n") <= node_size).alias("leaf"))
        if levels:
            level = level.union(levels[-1].where("leaf").select("node", "node", "depth", "leaf"))
        levels.append(stored(level, "nodes"))
        here = rest.withColumn("node", at)
        large = checked_broadcast(levels[-1].where(~F.col("leaf")).select("node"))
        leaves.append(stored(here.join(large, "node", "left_anti").select("print", "node"), "leaves"))
        if not levels[-1].where(~F.col("leaf")).limit(1).count():
            return _union(leaves), levels
        rest = stored(here.join(large, "node", "left_semi").select("print"), "open")
        parents, depth = depth, min(BITS, depth + STEP)


def _union(tables: list[DataFrame]) -> DataFrame:
    """Of tables that are stored, so that files of all are read as they are."""
    found = tables[0]
    for table in tables[1:]:
        found = found.unionByName(table)
    return found


def _leaf_pairs(spark, levels: list[DataFrame], budget: int) -> DataFrame:
    """Pairs (a, b) of leaves whose common bits differ within the budget, each once, with the number of those bits and of differing ones."""
    open_pairs = spark.range(1).select(*(F.lit(0).cast("long").alias(c) for c in ("a", "b")))
    done = []
    for level in levels:
        side = lambda s: level.select(F.col("parent").alias(s), F.col("node").alias(f"{s}_node"), F.col("depth").alias(f"{s}_depth"), F.col("leaf").alias(f"{s}_leaf"))
        common = F.least("a_depth", "b_depth")
        differ = F.bit_count(F.col("a_node").bitwiseXOR(F.col("b_node")).bitwiseAND(_mask(common)))
        once = (F.col("a") != F.col("b")) | (F.col("a_node") <= F.col("b_node"))
        both = open_pairs.join(side("a"), "a").join(side("b"), "b").where(once & (differ <= budget))
        both = stored(both.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), common.alias("depth"), differ.alias("differ"), (F.col("a_leaf") & F.col("b_leaf")).alias("leaf")), "node-pairs")
        done.append(both.where("leaf").select("a", "b", "depth", "differ"))
        open_pairs = both.where("not leaf").select("a", "b")
    return _union(done)


def _traversed(sets: np.ndarray, ones: tuple[np.ndarray, ...], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``sets`` of the pairs within the budget; ``ones`` describes the pairs of nodes (two ranges of ``sets``, differing bits and depth of each), of which the fingerprints of each node ascend."""
    low1, high1, low2, high2, differ, depths = ones
    found: list[tuple[np.ndarray, np.ndarray]] = []
    live = tuple(np.zeros(0, np.int64) for _ in range(5))
    for depth in range(int(depths.min(initial=BITS)), BITS + 1):
        starts = depths == depth
        live = tuple(np.concatenate((x, y[starts])) for x, y in zip(live, (low1, high1, low2, high2, differ)))
        l1, h1, l2, h2, d = live
        direct = ((h1 - l1) * (h2 - l2) <= DIRECT) | (depth == BITS)
        if direct.any():
            a, b, c, e = (x[direct] for x in (l1, h1, l2, h2))
            width = e - c
            n = (b - a) * width
            owner = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            one, two = a[owner] + k // width[owner], c[owner] + k % width[owner]
            near = (np.bitwise_count(sets[one] ^ sets[two]) <= budget) & ((a[owner] != c[owner]) | (one < two))
            found.append((one[near], two[near]))
        if depth == BITS:
            break
        l1, h1, l2, h2, d = (x[~direct] for x in live)
        if not len(l1) and not (depths > depth).any():
            break
        bits = np.concatenate(([0], np.cumsum((sets >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)))
        m1, m2 = h1 - (bits[h1] - bits[l1]), h2 - (bits[h2] - bits[l2])  # zeros come first
        children = []
        for left, right, more in (((l1, m1), (l2, m2), 0), ((m1, h1), (m2, h2), 0), ((l1, m1), (m2, h2), 1), ((m1, h1), (l2, m2), 1)):
            keep = (left[1] > left[0]) & (right[1] > right[0]) & (d + more <= budget)
            if more and left[0] is m1:
                keep &= l1 != l2  # of a node with itself, once
            children.append(tuple(x[keep] for x in (*left, *right, d + more)))
        live = tuple(np.concatenate(x) for x in zip(*children))
    empty = np.zeros(0, np.int64)
    return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (empty, empty)


def _forest(one: np.ndarray, two: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as the given ones, one less than nodes at most: each node with the least that it reaches."""
    label = np.arange(size)
    while True:
        before = label.copy()
        np.minimum.at(label, two, label[one])
        np.minimum.at(label, one, label[two])
        label = label[label]
        if (label == before).all():
            moved = np.flatnonzero(label != np.arange(size))
            return moved, label[moved]


def _pair_batches(budget: int, forest: bool):
    """From pairs of leaves with their fingerprints, pairs of fingerprints: all within the budget, or a forest of them for each few leaves."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PAIRS_AT_ONCE):
                batch = whole.slice(start, PAIRS_AT_ONCE)
                same = batch.column(0).to_numpy() == batch.column(1).to_numpy()
                parts, low = [], [np.zeros(0, np.int64)] * 2
                place = 0
                for side in (4, 5):
                    lists = batch.column(side)
                    n = np.diff(lists.offsets.to_numpy())
                    parts.append(lists.flatten().to_numpy().view(np.uint64))
                    low[side - 4] = place + np.cumsum(n) - n
                    place += int(n.sum())
                sets = np.concatenate(parts)
                size = [np.diff(batch.column(side).offsets.to_numpy()).astype(np.int64) for side in (4, 5)]
                low[1] = np.where(same, low[0], low[1])
                ranges = (low[0], low[0] + size[0], low[1], low[1] + size[1], batch.column(3).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(np.int64))
                one, two = _traversed(sets, ranges, budget)
                if forest:
                    names, place = np.unique(sets, return_inverse=True)
                    one, two = _forest(place[one], place[two], len(names))
                    sets = names
                yield pa.RecordBatch.from_arrays([pa.array(sets[x].view(np.int64)) for x in (one, two)], names=["a", "b"])

    return batches_of


def _near(prints: DataFrame, budget: int, node_size: int, forest: bool) -> DataFrame:
    """Pairs (a, b) of different fingerprints of a stored table; of a forest, with the same components only."""
    spark = prints.sparkSession
    leaves, levels = _nodes(prints, node_size)
    pairs = _leaf_pairs(spark, levels, budget)
    sets = stored(leaves.groupBy("node").agg(F.sort_array(F.collect_list(F.col("print").bitwiseXOR(F.lit(-(1 << 63))))).alias("prints")), "sets")  # node_size entries at most
    sets = sets.select("node", F.transform("prints", lambda x: x.bitwiseXOR(F.lit(-(1 << 63)))).alias("prints"))  # in unsigned order
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("prints").alias("one")), "a").join(sets.select(F.col("node").alias("b"), F.col("prints").alias("two")), "b")
    with small_batches(spark):
        return stored(both.select("a", "b", "depth", "differ", "one", "two").mapInArrow(_pair_batches(budget, forest), "a long, b long"), "near")


def _hex(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def links(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = BUDGET, node_size: int = NODE_SIZE) -> DataFrame:
    """``print_a``, ``print_b`` and ``distance`` for each pair of different fingerprints within the budget, each pair once."""
    with small_batches(docs.sparkSession):
        prints = stored(fingerprints(docs, doc_col, text_col, shingle).select("print").distinct(), "prints")
    found = _near(prints, budget, node_size, forest=False)
    a, b = F.least("a", "b"), F.greatest("a", "b")
    return found.select(_hex(a).alias("print_a"), _hex(b).alias("print_b"), F.bit_count(a.bitwiseXOR(b)).alias("distance"))


def components(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = BUDGET, node_size: int = NODE_SIZE) -> DataFrame:
    """``doc_col``, ``fingerprint``, ``component_id`` and ``class_id`` for each row of ``docs``.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, shingles ``shingle``
    words in a row, repeats included; a text with fewer words has them all as
    one. A bit of the fingerprint is 1 if more than half the shingles' XXH64
    (seed 42) have it. Fingerprints within ``budget`` differing bits link;
    ``component_id`` is the least id that links lead to, ``class_id`` the least
    with the same fingerprint. Null, empty and wordless texts have fingerprint
    0, which links like any other. Texts of any length are read whole, in
    pieces. Ties can't arise: equal fingerprints are one class. Repeated rows
    are returned each, rows with a null id too; a null id is never the least
    one, and a component without other ids is null. An empty table gives an
    empty result, and other columns of ``docs`` aren't looked at.
    """
    with small_batches(docs.sparkSession):
        prints = stored(fingerprints(docs, doc_col, text_col, shingle), "prints")
    classes = stored(prints.groupBy("print").agg(F.min("doc").alias("class")), "classes")
    found = _near(classes.select("print"), budget, node_size, forest=True)
    labels = connected(found).select(F.col("doc").alias("print"), "comp")
    named = classes.join(labels, "print", "left").withColumn("comp", F.coalesce("comp", "print"))
    least = named.groupBy("comp").agg(F.min("class").alias("component"))
    named = stored(named.join(least, "comp").select("print", "class", "component"), "named")
    discard(classes)
    rows = prints.join(named, "print")
    return rows.select(F.col("doc").alias(doc_col), _hex(F.col("print")).alias("fingerprint"), F.col("component").alias("component_id"), F.col("class").alias("class_id"))
