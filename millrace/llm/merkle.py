"""A Merkle manifest of a table: a tree for each group, and one over their roots.

Leaves are numbered within their group by a range sort, and aligned blocks of
``ARITY ** levels`` of them are gathered. A block's root is a node of the next
tier, whose blocks are made alike, until a group is one block; the roots of
the groups are a tree of their own. Authentication paths then come down from
the top: each block gets the path of its root, which distributed joins carry,
and walks its leaves in order (fractal traversal): for each level it holds the
existing subtree, whose nodes the next leaves need as siblings, and the desired
one beside it, which grows by one node whenever a node below is done and
replaces the other at the border. So a block holds its leaves and two runs of
nodes for each level, however large the tree is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import range_parts
from .joins import checked_broadcast
from .scratch import small_batches, stored

ARITY = 16
#: Levels of a block: 4,096 nodes.
LEVELS = 3
_ROW_BITS = 33  # monotonically_increasing_id holds the row below these bits

_PATH = "array<struct<before:string,after:string>>"

Step = tuple[str, str]  # the digests of the siblings before and after a node


def _parent(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def height(nodes: int) -> int:
    """Levels above so many nodes."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


def block_root(leaves: list[str], levels: int) -> str:
    """The node that is ``levels`` above; runs of fewer nodes become one too."""
    for _ in range(levels):
        leaves = [_parent(leaves[k : k + ARITY]) for k in range(0, len(leaves), ARITY)]
    return leaves[0]


def traverse(leaves: list[str], levels: int) -> Iterator[list[Step]]:
    """The path of each leaf of a block in turn: its siblings on each level, lowest first."""

    def node(level: int, place: int) -> str:
        """Computed from the nodes below it, or from leaves."""
        return block_root(leaves[place * ARITY**level : (place + 1) * ARITY**level], level)

    def count(level: int) -> int:
        return -(-len(leaves) // ARITY**level)

    existing = [[node(level, k) for k in range(min(ARITY, count(level)))] for level in range(levels)]
    desired: list[list[str]] = [[] for _ in range(levels)]
    for at in range(len(leaves)):
        place, path = at, []
        for level in range(levels):
            run, k = existing[level], place % ARITY
            path.append(("".join(run[:k]), "".join(run[k + 1 :])))
            place //= ARITY
        yield path
        for level in range(levels):
            if (at + 1) % ARITY**level:
                break
            done = (at + 1) // ARITY**level  # so many nodes of this level lie behind
            ahead = done - 1 + ARITY  # the node of the next run that takes the place of the one just left
            if ahead < count(level):
                desired[level].append(node(level, ahead))
            if done % ARITY == 0:
                existing[level], desired[level] = desired[level], []


def fold(leaf: str, path: list[Step]) -> str:
    """The root that a leaf and the siblings of its path give."""
    for before, after in path:
        leaf = sha256(f"{before}{leaf}{after}".encode()).hexdigest()
    return leaf


def _levels(size: int, blocks: int, levels: int) -> int:
    """Levels of a block of a group: all of them where the group has more blocks."""
    return levels if blocks > 1 else height(size)


def _root_batches(levels: int):
    """tree, block, the number of blocks of the tree and the block's root."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [block_root([x.hex() for x in digests], _levels(len(digests), blocks, levels)) for blocks, digests in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(roots, pa.string())], names=["tree", "block", "blocks", "root"])

    return batches_of


def _path_batches(levels: int):
    """For each node of a block its place and its path to the top, as siblings before and after it on each level."""
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, blocks, digests, above in zip(*(batch.column(k).to_pylist() for k in range(5))):
                rest = [(x["before"], x["after"]) for x in above]
                paths = [[{"before": b, "after": a} for b, a in [*path, *rest]] for path in traverse([x.hex() for x in digests], _levels(len(digests), blocks, levels))]
                n, first = len(paths), block * ARITY**levels
                yield pa.RecordBatch.from_arrays([pa.array([tree] * n, pa.binary()), pa.array(range(first, first + n), pa.int64()), pa.array(paths, kind)], names=["tree", "block", "path"])

    return batches_of


def _proof_batches(id_type: pa.DataType, levels: int):
    """For each leaf of a block the digest of its path, and the root that its claimed digest folds to."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blocks, digests, above, ids, claims, subroot in zip(*(batch.column(k).to_pylist() for k in range(2, 8))):
                rest = [(x["before"], x["after"]) for x in above]
                proofs, folded, leaves = [], [], [x.hex() for x in digests]
                for path, claim in zip(traverse(leaves, _levels(len(leaves), blocks, levels)), claims):
                    whole = [*path, *rest]
                    proofs.append(sha256("".join(b + a for b, a in whole).encode()).hexdigest())
                    folded.append(fold(claim.hex(), whole))
                columns = (pa.array(ids, id_type), pa.array(leaves), pa.array([subroot] * len(leaves)), pa.array(proofs), pa.array(folded))
                yield pa.RecordBatch.from_arrays(list(columns), names=["id", "leaf", "subroot", "proof_sha256", "folded_root"])

    return batches_of


def _placed(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` (``tree``, ...) with the ``place`` of each in its tree, from 0, by the given order."""
    keys = ("tree", *order)
    sorted_ = nodes.repartitionByRange(range_parts(nodes), *keys, "salt").sortWithinPartitions(*keys)
    ranged = stored(sorted_.withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", _ROW_BITS).alias("part")
    runs = ranged.groupBy("tree", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))  # a row for each range and tree in it
    before = F.coalesce(F.sum("n").over(W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = stored(runs.select(F.col("tree").alias("t"), "part", (before - F.col("first")).alias("shift")), "runs")
    numbered = ranged.withColumn("part", part).join(checked_broadcast(starts.withColumnRenamed("part", "p")), F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
    return numbered.select(*(c for c in nodes.columns if c != "salt"), (F.col("at") + F.col("shift")).alias("place"))


def _blocks(placed: DataFrame, levels: int, *more: str) -> DataFrame:
    """One row for each aligned block of nodes (``tree``, ``place``, ``digest`` and others): ``tree``, ``block``, ``blocks`` of its tree, and lists in order."""
    block = F.floor(F.col("place") / ARITY**levels).cast("long")
    entry = F.struct("place", "digest", *more)
    lists = placed.groupBy("tree", block.alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("e"))  # a block's entries at most
    rows = lists.select("tree", "block", F.col("e.digest").alias("digests"), *(F.col(f"e.{c}").alias(c) for c in more))
    rows = stored(rows, "blocks")
    counts = rows.groupBy("tree").agg((F.max("block") + 1).alias("blocks"))
    counted = rows.alias("r").join(counts.withColumnRenamed("tree", "t"), F.col("tree").eqNullSafe(F.col("t")))
    return stored(counted.select("tree", "block", "blocks", "digests", *more), "blocks")


def _roots(blocks: DataFrame, levels: int) -> DataFrame:
    found = blocks.select("tree", "block", "blocks", "digests").mapInArrow(_root_batches(levels), "tree binary, block long, blocks long, root string")
    return stored(found, "roots")


def _tiers(blocks: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of all tiers, the lowest first, and each tree's root (``tree``, ``root``). Trees of one block leave, others go on."""
    tiers, tops = [blocks], []
    while True:
        roots = _roots(tiers[-1], levels)
        tops.append(roots.where("blocks = 1").select("tree", "root"))
        if not roots.where("blocks > 1").limit(1).count():
            found = tops[0]
            for top in tops[1:]:
                found = found.union(top)
            return tiers, found
        nodes = roots.where("blocks > 1").select("tree", F.col("block").alias("place"), F.unhex("root").alias("digest"))
        tiers.append(_blocks(nodes, levels))


def _with_paths(blocks: DataFrame, paths: DataFrame, *more: str) -> DataFrame:
    """Blocks beside the paths of their roots."""
    above = paths.select(F.col("tree").alias("t"), F.col("block").alias("b"), "path")
    both = blocks.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b")))
    return both.select("tree", "block", "blocks", "digests", "path", *more)


def _down(tiers: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The paths (``tree``, ``block``, ``path``) of the roots of the lowest tier's blocks, from those of the trees' roots (``tree``, ``path``)."""
    top = tops.select("tree", F.lit(0).cast("long").alias("block"), "path")
    paths = None
    for tier in reversed(tiers):
        single = tier.where("blocks = 1").select(F.col("tree").alias("t")).join(top, F.col("tree").eqNullSafe(F.col("t"))).select("tree", "block", "path")
        paths = single if paths is None else paths.union(single)
        if tier is tiers[0]:
            return stored(paths, "paths")
        with small_batches(tier.sparkSession):
            paths = stored(_with_paths(tier, paths).mapInArrow(_path_batches(levels), f"tree binary, block long, path {_PATH}"), "paths")


def record_digest(values: Iterable[Column]) -> Column:
    """SHA-256 of the given values in order: ``-`` for a null, else the number of its UTF-8 bytes, ``:`` and the value."""
    texts = [value.cast("string") for value in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def manifest(docs: DataFrame, claims: dict[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), levels: int = LEVELS) -> DataFrame:
    """``id_col``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` for each row of ``docs``.

    A leaf is the ``record_digest`` of ``columns``; ``claims`` gives for some of
    them the values that are verified against the manifest (default: the rows
    themselves). Leaves of a group ascend by ``id_col``, null first, rows of
    one id by their digests; 16 consecutive nodes become one while there are
    several, and the groups' roots, null first and by UTF-8 bytes, likewise
    give the root. ``proof_sha256`` is the digest of a leaf's siblings on all
    levels, ``folded_root`` what its claimed digest gives with them. Values may
    be null, empty or very long (a row is hashed where it is read). Repeated
    rows have a leaf each; equal leaves are interchangeable. An empty table
    gives an empty result; columns of other names aren't looked at. ``levels``
    are those of a block, of which a task holds one at a time.
    """
    spark, named = docs.sparkSession, {c: F.col(c) for c in columns}
    leaf, claim = record_digest(named.values()), record_digest((named | (claims or {})).values())
    tree = F.col(group_col).cast("string").cast("binary")
    salt = F.xxhash64(F.monotonically_increasing_id())  # equal rows may be many
    leaves = stored(docs.select(F.col(id_col).alias("id"), tree.alias("tree"), F.unhex(leaf).alias("digest"), F.unhex(claim).alias("claim"), salt.alias("salt")), "leaves")
    blocks = _blocks(_placed(leaves, "id", "digest"), levels, "id", "claim")
    tiers, subroots = _tiers(blocks, levels)
    subroots = stored(subroots.withColumnRenamed("root", "subroot"), "subroots")

    groups = subroots.select(F.lit(b"").alias("tree"), F.col("tree").alias("name"), F.unhex("subroot").alias("digest"), F.lit(0).alias("salt"))
    placed = stored(_placed(groups, "name"), "groups")
    upper, roots = _tiers(_blocks(placed.select("tree", "place", "digest"), levels), levels)
    inner = _down(upper, roots.select("tree", F.array().cast(_PATH).alias("path")), levels)
    with small_batches(spark):
        group_paths = stored(_with_paths(upper[0], inner).mapInArrow(_path_batches(levels), f"tree binary, block long, path {_PATH}"), "paths")
    tops = placed.select("name", "place").join(group_paths.select(F.col("block").alias("place"), "path"), "place").select(F.col("name").alias("tree"), "path")

    below = _with_paths(blocks, _down(tiers, stored(tops, "tops"), levels), "id", "claim")
    below = below.join(subroots.withColumnRenamed("tree", "t"), F.col("tree").eqNullSafe(F.col("t"))).drop("t")
    id_type = leaves.schema["id"].dataType
    with small_batches(spark):
        found = below.mapInArrow(_proof_batches(to_arrow_type(id_type), levels), f"id {id_type.simpleString()}, leaf string, subroot string, proof_sha256 string, folded_root string")
        found = stored(found, "proofs")
    top = roots.first()
    root = F.lit(top.root if top else None).cast("string")
    return found.select(F.col("id").alias(id_col), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
