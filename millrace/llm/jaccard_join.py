"""Exact Jaccard self-join of word shingles by relations between sets.

Sets take over the answers of a highly similar set: near copies, which agree in
minima of their shingles, name a leader, are compared with it, and what leads
to one leader is one component that needs no comparison inside. Rounds with new
leaders follow while many near copies stand in different components.

Large groups of similar sets that stay apart, as they lie just below the
threshold, are described by their differences from a centre, the shingles that
most of them have. Whether two of them link follows from sizes and differences
alone, so those pairs are settled and the index has none of them.

The inverted index then holds the prefix of each set, rarest shingles first,
with positions. A list inside one component or one centre's group is skipped;
long lists are cut into
blocks of like set sizes, and a pair of entries is skipped whose sizes or
positions leave too few common shingles, counting only those that any set of
another component has. Pairs of different components that
meet in enough lists are compared exactly, those first that may join two
components, so that the others need no comparison.

``links`` gives every link, those inside components too: sets that link to one
leader are described by their differences from it, and their links follow from
those differences alone; all other pairs of the lists are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import checked_broadcast
from .scratch import discard, small_batches, stored
from .textkit import BLANKS, Chunk, byte_codes, chunks, mix, owner

#: Shingles in which frequent ones are looked for at once; batches of texts are smaller, so that little is held outside the heap.
COUNTED_AT_ONCE = 2_500_000
BATCH_BYTES = "4m"
#: A shingle that so many different sets of those have is counted over the corpus.
HEAVY_IN_BATCH = 3
#: Of those, the most frequent ones are ordered last in every prefix; the bound touches the order only, not results.
HEAVY_SHINGLES = 200_000
#: Prefixes are so long that sets with a link share so many shingles of them at least.
SHARED = 4
#: Minima of a set's shingles under so many hash functions; near copies agree in most.
SKETCH = 4
#: A set is compared with a leader that has so many of these minima too; the index finds what this misses.
SAME_MINIMA = 2
#: Rounds of leaders; the first ones may have leaders that link with nothing.
MIN_ROUNDS, MAX_ROUNDS = 3, 8
#: Another round follows one that finds more links for each set than this: what is one component by then needs no pairs of the index.
LINKS_A_SET = 0.001
#: A list of so many entries is paired where it is gathered; longer ones are joined by blocks of like sizes.
SHORT_LIST = 64
#: Lists of frequent shingles are gathered in so many parts.
SALTS = 64
#: Pairs of texts that are compared at once.
PAIRS_AT_ONCE = 256
#: Members of one leader whose pairs are made in one task, about; larger groups are cut into squares of so many.
MEMBERS_A_BUCKET = 500
#: Components that share a minimum, from which on their sets get a centre; the pairs of fewer ones are left to the index.
LARGE_GROUP = 64
#: Sets of which a centre is made, about, and components that a core of such a group has at least; any other centre gives the same links.
CENTRE_OF = 32
#: Members of one centre in a side of a square of pairs, about.
MEMBERS_A_SQUARE = 150
#: Shingles of all centres up to which these are broadcast.
BROADCAST_SHINGLES = 2_000_000


def shingle_sets(chunk: Chunk, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text after text, ascending; and the index of each text's first (n + 1 values)."""
    starts, ends, first = chunk.runs(BLANKS)
    words = chunk.hasher(byte_codes(True))(starts, ends)
    n_words = np.diff(first)
    n_shingles = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
    text = np.repeat(np.arange(chunk.n), n_shingles)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    end = np.minimum(at + shingle, first[text + 1])
    with np.errstate(over="ignore"):
        hashes = np.zeros(len(at), np.uint64)
        for k in range(shingle):
            inside = at + k < end
            hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + np.where(inside, words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else 0, np.uint64(0x5851F42D4C957F2D))
    hashes = mix(hashes)
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(chunk.n + 1))


def least_size(percent: int) -> int:
    """The size from which a set can link with a different one, which has one shingle more at least."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def least_shared(percent: int) -> int:
    """Prefix shingles that two different sets with a link have in common, at least."""
    return max(1, min(SHARED, -(-percent * least_size(percent) // 100)))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of n of which another set with enough similarity must have ``least_shared``."""
    return np.minimum(n, n - -(-percent * n // 100) + least_shared(percent))


def _lists(values: list[np.ndarray], first: list[np.ndarray]) -> pa.Array:
    """An Arrow column of lists, from the values and list starts of each chunk."""
    parts = [pa.LargeListArray.from_arrays(pa.array(f, pa.int64()), pa.array(v.view(np.int64))) for v, f in zip(values, first)]
    return pa.concat_arrays(parts).cast(pa.list_(pa.int64())) if parts else pa.array([], pa.list_(pa.int64()))


def _minima(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SKETCH minima for each set, one after another; zeros for an empty one."""
    found = np.zeros((len(first) - 1, SKETCH), np.uint64)
    full = np.flatnonzero(np.diff(first))
    for k in range(SKETCH if len(full) else 0):
        with np.errstate(over="ignore"):
            found[full, k] = np.minimum.reduceat(mix(hashes + np.uint64(k)), first[full])
    return found.ravel()


def _often(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that come up HEAVY_IN_BATCH times at least in all parts together, and how often; by ranges of hashes, to hold few of them twice."""
    names, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(16 if parts else 0):
        some = np.concatenate([p[p >> np.uint64(60) == k] for p in parts])
        some.sort()
        last = np.flatnonzero(np.append(some[1:] != some[:-1], True)) if len(some) else np.zeros(0, np.int64)
        n = np.diff(last, prepend=-1)
        names.append(some[last[n >= HEAVY_IN_BATCH]].view(np.int64))
        counts.append(n[n >= HEAVY_IN_BATCH])
    return np.concatenate(names), np.concatenate(counts)


def _fingerprint_batches(shingle: int):
    """Writes for each text its set's size, fingerprint and minima; and for every COUNTED_AT_ONCE shingles those that several different sets of them have."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, seen, held, doc_type = [], np.zeros(0, np.uint64), 0, None

        def told(docs: pa.Array, n: np.ndarray, p1: np.ndarray, p2: pa.Array, minima: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([docs, pa.array(n, pa.int64()), pa.array(p1.view(np.int64), pa.int64()), p2, minima], names=["doc", "n", "p1", "p2", "minima"])

        def often() -> pa.RecordBatch:
            names, n = _often(heavy)
            return told(pa.nulls(len(n), doc_type), n, names, pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.list_(pa.int64())))

        for batch in batches:
            doc_type, sizes, prints, minima = batch.column(0).type, [np.zeros(0, np.int64)], ([np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]), []
            for chunk in chunks(batch.column(1)):
                hashes, first = shingle_sets(chunk, shingle)
                total = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(h))) for h in (hashes, mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
                both = [mix(t[first[1:]] - t[first[:-1]]) for t in total]
                sizes.append(np.diff(first))
                prints[0].append(both[0])
                prints[1].append(both[1])
                minima.append(_minima(hashes, first))
                _, once = np.unique(both[0], return_index=True)
                once = once[~np.isin(both[0][once], seen)]  # copies don't make a shingle frequent
                seen = np.concatenate((seen, both[0][once]))
                heavy.append(hashes[np.isin(owner(first), once)])
                held += len(heavy[-1])
            sketches = _lists(minima, [np.arange(0, len(m) + 1, SKETCH) for m in minima])
            yield told(batch.column(0), np.concatenate(sizes), np.concatenate(prints[0]), pa.array(np.concatenate(prints[1]).view(np.int64)), sketches)
            if held >= COUNTED_AT_ONCE:
                yield often()
                heavy, seen, held = [], np.zeros(0, np.uint64), 0
        if heavy:
            yield often()

    return batches_of


def _prefix_batches(heavy: np.ndarray, rank: np.ndarray, shingle: int, percent: int):
    """Writes doc, n, the prefix (shingles in order) of each set and how many shingles of it come before the frequent ones."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rare, values, starts = [], [], [], []
            for chunk in chunks(batch.column(1)):
                hashes, first = shingle_sets(chunk, shingle)
                n = np.diff(first)
                order = np.zeros(len(hashes), np.int64)
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, hashes), len(heavy) - 1)
                    order = np.where(heavy[at] == hashes, rank[at], 0)
                text = owner(first)
                ordered = np.lexsort((hashes, order, text))
                keep = np.where(n >= least_size(percent), prefix_length(n, percent), 0)
                inside = np.arange(len(hashes)) - first[text] < keep[text]
                values.append(hashes[ordered][inside])
                starts.append(np.concatenate(([0], np.cumsum(keep))))
                rare.append(np.bincount(text[order == 0], minlength=len(n)))
                sizes.append(n)
            join = lambda parts: pa.array(np.concatenate(parts).astype(np.int32) if parts else [], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), join(sizes), join(rare), _lists(values, starts)], names=["doc", "n", "rare", "prefix"])

    return batches_of


def _sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The shingles of each text, ascending."""
    found = []
    for chunk in chunks(texts):
        hashes, first = shingle_sets(chunk, shingle)
        found += np.split(hashes, first[1:-1])
    return found


def _set_batches(shingle: int):
    """Writes doc and the shingles of each set."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_sets(chunk, shingle) for chunk in chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([h for h, _ in found], [f for _, f in found])], names=["doc", "items"])

    return batches_of


def _link_batches(shingle: int, percent: int):
    """Keeps the pairs (a, b, and their texts) whose sets are similar enough."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PAIRS_AT_ONCE):
                batch = whole.slice(start, PAIRS_AT_ONCE)
                both = zip(_sets(batch.column(2), shingle), _sets(batch.column(3), shingle))
                linked = []
                for x, y in both:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return batches_of


#: Kinds of rows of ``_meeting_batches``, and of index entries.
PAIR, ENTRY, SHARED = 0, 1, 2
PLAIN, BESIDE_FREQUENT, FREQUENT = 0, 1, 2


def _meeting_batches(percent: int):
    """From index entries in order of shingles: the pairs of short lists that may link, and the entries of other lists as they are.

    Of sets that have frequent shingles in their prefix, the entries of short
    lists that hold several components and groups come too (SHARED).
    """
    names = ["kind", "shingle", "a", "b", "c1", "c2", "n1", "n2", "i", "known", "grp"]

    def rows(kind: int, x: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray) -> dict[str, np.ndarray]:
        found = {"kind": np.full(len(one), kind), "shingle": x["shingle"][one], "i": x["i"][one], "known": (x["often"][one] > PLAIN).astype(np.int64), "grp": x["grp"][one]}
        return found | {f: x[k][at] for f, k, at in (("a", "doc", one), ("b", "doc", two), ("c1", "comp", one), ("c2", "comp", two), ("n1", "n", one), ("n2", "n", two))}

    def pairs_of(x: dict[str, np.ndarray], at: np.ndarray, run: np.ndarray) -> list[dict[str, np.ndarray]]:
        """Pairs of the entries ``at``, which lie in lists ``run``."""
        found = []
        for step in range(1, int(np.unique(run, return_counts=True)[1].max(initial=0))):
            one = np.flatnonzero(run[step:] == run[:-step])
            one, two = at[one], at[one + step]
            swap = x["doc"][one] > x["doc"][two]
            one, two = np.where(swap, two, one), np.where(swap, one, two)
            n1, n2, i1, i2 = x["n"][one], x["n"][two], x["i"][one], x["i"][two]
            most = np.minimum(i1, i2) + np.minimum(n1 - i1, n2 - i2)
            good = (x["comp"][one] != x["comp"][two]) & (x["grp"][one] != x["grp"][two]) & (100 * most >= percent * (n1 + n2 - most)) & (x["doc"][one] != x["doc"][two])
            found.append(rows(PAIR, x, one[good], two[good]))
        return found

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        long = None  # the shingle of a long list that goes on in the next batch

        def settle(x: dict[str, np.ndarray], ended: bool) -> pa.RecordBatch:
            """Rows of the lists that have ended; the entries of the last one are kept until it has."""
            nonlocal long, rest
            size = len(x["shingle"])
            if not size:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * len(names), names=names)
            starts = np.flatnonzero(np.concatenate(([True], x["shingle"][1:] != x["shingle"][:-1])))
            length = np.diff(np.append(starts, size))
            run = np.repeat(np.arange(len(starts)), length)
            differ = lambda k: np.minimum.reduceat(x[k], starts) != np.maximum.reduceat(x[k], starts)
            several = (differ("comp") & differ("grp"))[run]
            whole = (length[run] > SHORT_LIST) | (x["often"] == FREQUENT)
            whole |= False if long is None else x["shingle"] == long
            going = np.zeros(size, bool) if ended else (run == run[-1]) & ~whole
            long = x["shingle"][-1] if not ended and whole[-1] else None
            rest = {k: v[going] for k, v in x.items()}
            mixed = np.flatnonzero(~whole & ~going & several)
            entry, beside = np.flatnonzero(whole), mixed[x["often"][mixed] == BESIDE_FREQUENT]
            parts = [rows(ENTRY, x, entry, entry), rows(SHARED, x, beside, beside), *pairs_of(x, mixed, run[mixed])]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts]), pa.int64()) for k in names], names=names)

        for batch in batches:
            x = {k: batch.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j, k in enumerate(("shingle", "doc", "comp", "n", "i", "often", "grp"))}
            yield settle({k: np.concatenate((rest[k], v)) for k, v in x.items()} if rest else x, False)
        if rest:
            yield settle(rest, True)

    return batches_of


def connected(edges: DataFrame) -> DataFrame:
    """A stored table of ``doc`` and ``comp``, the least document that links lead to, for the ends of ``edges`` (a, b); labels spread to neighbours and jump along labels."""
    both = stored(edges.select(F.col("a").alias("doc"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("doc").agg(F.least(F.min("doc"), F.min("other")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("doc").alias("other"), "comp"), "other").groupBy("doc").agg(F.min("comp").alias("near"))
        lower = labels.select("doc", "comp").join(near, "doc").select("doc", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        jump = labels.select(F.col("doc").alias("to"), F.col("comp").alias("far"))
        moved = stored(lower.join(jump, "to", "left").select("doc", F.least("to", F.coalesce("far", "to")).alias("comp"), "was"), "labels")
        discard(labels)
        labels = moved
        if not moved.where("comp <> was").limit(1).count():
            discard(both)
            return moved  # doc, comp and was


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The labels (``doc``, ``comp``) after more links (a, b), which are looked at as links between components."""
    if labels is None:
        return connected(links)
    ends = stored(_named(links.select(F.col("a").alias("doc")).union(links.select("b")).distinct(), labels), "ends")
    both = links.join(ends.select(F.col("doc").alias("a"), F.col("comp").alias("c1")), "a").join(ends.select(F.col("doc").alias("b"), F.col("comp").alias("c2")), "b")
    joined = connected(both.where("c1 <> c2").select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).distinct())
    every = labels.select("doc", "comp").union(ends.join(labels, "doc", "left_anti").select("doc", "comp"))
    moved = every.join(joined.select(F.col("doc").alias("comp"), F.col("comp").alias("to")), "comp", "left")
    found = stored(moved.select("doc", F.coalesce("to", "comp").alias("comp")), "labels")
    for table in (ends, joined, labels):
        discard(table)
    return found


def _links(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, compared exactly; only texts of documents in a pair are moved."""
    needed = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    spelled = texts.join(checked_broadcast(needed), "doc", "left_semi")
    doc_type = texts.schema["doc"].dataType.simpleString()
    one = pairs.join(spelled.alias("s1"), F.col("a") == F.col("s1.doc")).select("a", "b", F.col("s1.text").alias("x"))
    both = one.join(spelled.alias("s2"), F.col("b") == F.col("s2.doc")).select("a", "b", "x", F.col("s2.text").alias("y"))
    with small_batches(pairs.sparkSession, BATCH_BYTES):
        return stored(both.mapInArrow(_link_batches(shingle, percent), f"a {doc_type}, b {doc_type}"), "links")


def _index(texts: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame, tuple[np.ndarray, np.ndarray]]:
    """Size and class of each row; size and minima of each class, by the document that stands for it; names of frequent shingles, ascending, with their places in the order."""
    doc_type = texts.schema["doc"].dataType.simpleString()
    with small_batches(texts.sparkSession, BATCH_BYTES):
        scanned = stored(texts.mapInArrow(_fingerprint_batches(shingle), f"doc {doc_type}, n long, p1 long, p2 long, minima array<bigint>"), "prints")
    prints, often = scanned.where("p2 is not null"), scanned.where("p2 is null")
    classes = stored(prints.where("n > 0").groupBy("p1", "p2", "n").agg(F.min("doc").alias("class"), F.any_value("minima").alias("minima")), "classes")
    named = prints.select("doc", "n", "p1", "p2").join(classes.drop("minima"), ["p1", "p2", "n"], "left").select("doc", "n", F.coalesce("class", "doc").alias("class"))
    members = stored(named, "members")
    owners = classes.where("class is not null").select(F.col("class").alias("doc"), F.col("n").cast("int").alias("n"), "minima")

    top = often.groupBy("p1").agg(F.sum("n").alias("times")).orderBy(F.desc("times"), "p1").limit(HEAVY_SHINGLES).toPandas()
    discard(scanned)
    names = top["p1"].to_numpy(np.int64).view(np.uint64)
    ranks = np.arange(len(names), 0, -1)  # the most frequent one last
    by_name = np.argsort(names)
    return members, owners, (names[by_name], ranks[by_name])


def _leader_links(lists: DataFrame, turn: int, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a < b) of sets with a leader: of those with the same minima, the one that agrees in most of them.

    The leader of a minimum is of the component that most of its sets are in,
    another member each turn, so that what is linked already draws others in,
    and a set that links with nothing leads once at most.
    """
    of_comp = lists.groupBy("k", "least", "comp").agg(F.min(F.struct(F.xxhash64("doc", F.lit(turn)) if turn else F.lit(0), "doc", "n", "comp")).alias("member"), F.count(F.lit(1)).alias("size"))
    first = F.xxhash64("member.doc", F.lit(turn)) if turn else -F.col("member.doc")
    leaders = of_comp.groupBy("k", "least").agg(F.max_by("member", F.struct("size", first, "member.doc")).alias("leader"), F.sum("size").alias("size")).where("size > 1")
    leaders = stored(leaders.select("k", "least", F.col("leader.doc").alias("b"), F.col("leader.n").alias("n2"), F.col("leader.comp").alias("c2")), "leaders")
    near = lists.join(leaders, ["k", "least"]).where((F.col("comp") != F.col("c2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")))
    best = near.groupBy("doc", "b").agg(F.count(F.lit(1)).alias("same")).where(F.col("same") >= SAME_MINIMA).groupBy("doc").agg(F.max_by("b", F.struct("same", "b")).alias("b"))
    pairs = stored(best.select(F.least("doc", "b").alias("a"), F.greatest("doc", "b").alias("b")).distinct(), "pairs")
    found = _links(pairs, texts, shingle, percent)
    discard(leaders)
    discard(pairs)
    return found


def _minima_lists(owners: DataFrame, percent: int) -> DataFrame:
    """``doc``, ``n``, ``comp`` (itself) and a row for each minimum."""
    return stored(owners.where(F.col("n") >= least_size(percent)).select("doc", "n", F.col("doc").alias("comp"), F.posexplode("minima").alias("k", "least")), "minima")


def _named(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``comp`` of each row by labels, or its own document."""
    if labels is None:
        return rows.withColumn("comp", F.col("doc"))
    return rows.drop("comp").join(labels.select("doc", "comp"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))


def _candidates(texts: DataFrame, owners: DataFrame, frequent: tuple[np.ndarray, np.ndarray], shingle: int, percent: int) -> DataFrame:
    """Pairs (a < b) of different ``comp`` (c1, c2) and ``grp`` that meet in enough lists; ``owners`` has doc, comp and grp."""
    doc_type = texts.schema["doc"].dataType.simpleString()
    prefixes = texts.mapInArrow(_prefix_batches(*frequent, shingle, percent), f"doc {doc_type}, n int, rare int, prefix array<bigint>").where("size(prefix) > 0")
    entries = prefixes.join(owners.select(F.col("doc").cast("long").alias("doc"), F.col("comp").cast("long").alias("comp"), F.col("grp").cast("long").alias("grp")), "doc").select("doc", "comp", "grp", "n", "rare", F.size("prefix").alias("size"), F.posexplode("prefix").alias("i", "shingle"))
    often = F.when(F.col("i") >= F.col("rare"), FREQUENT).when(F.col("size") > F.col("rare"), BESIDE_FREQUENT).otherwise(PLAIN)
    salt = F.when(often == FREQUENT, F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(0).cast("int")
    gathered = entries.select("shingle", "doc", "comp", "n", "i", often.alias("often"), "grp", salt.alias("salt")).repartition("shingle", "salt").sortWithinPartitions("shingle").drop("salt")
    with small_batches(texts.sparkSession, BATCH_BYTES):
        met = stored(gathered.mapInArrow(_meeting_batches(percent), "kind long, shingle long, a long, b long, c1 long, c2 long, n1 long, n2 long, i long, known long, grp long"), "met")

    entries = met.where(F.col("kind") == ENTRY).select("shingle", F.col("a").alias("doc"), F.col("c1").alias("comp"), F.col("n1").alias("n"), "i", "known", "grp")
    ends = (f(c).alias(f"{f.__name__}_{c}") for c in ("comp", "grp") for f in (F.min, F.max))
    mixed = stored(entries.groupBy("shingle").agg(*ends).where("min_comp <> max_comp and min_grp <> max_grp").select("shingle"), "mixed")
    listed = stored(entries.join(mixed, "shingle"), "listed")
    beside = met.where(F.col("kind") == SHARED).select(F.col("a").alias("doc"), "i").join(listed.select("doc").distinct(), "doc", "left_semi")
    both = listed.unionByName(beside, allowMissingColumns=True)
    of = W.partitionBy("doc")  # a prefix
    counted = both.withColumn("e", F.count(F.lit(1)).over(of.orderBy("i").rowsBetween(W.unboundedPreceding, -1))).withColumn("shared", F.count(F.lit(1)).over(of)).where("shingle is not null")
    enough = (F.col("known") == 0) | (F.col("shared") >= least_shared(percent))
    lists = stored(counted.where(enough).select("shingle", "doc", "comp", "grp", "n", "i", F.when(F.col("known") == 1, F.col("e")).otherwise(F.col("i")).alias("e"), F.when(F.col("known") == 1, F.col("shared")).otherwise(F.col("n")).alias("shared")), "lists")
    block = _size_block(F.col("n"), percent)
    left = lists.select("shingle", *(F.col(x).alias(y) for x, y in (("doc", "a"), ("n", "n1"), ("i", "i1"), ("e", "e1"), ("comp", "c1"), ("grp", "g1"), ("shared", "s1"))), F.explode(F.array(block, block + 1)).alias("block"))
    right = lists.select("shingle", *(F.col(x).alias(y) for x, y in (("doc", "b"), ("n", "n2"), ("i", "i2"), ("e", "e2"), ("comp", "c2"), ("grp", "g2"), ("shared", "s2"))), block.alias("block"))
    larger = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("a") < F.col("b")))
    most = F.least("e1", "e2") + F.least(F.col("n1") - F.col("i1"), F.col("n2") - F.col("i2"))
    # Of the two prefixes, all of the one that ends first must be in the other but for the shingles that may differ.
    common = F.ceil(percent * (F.col("n1") + F.col("n2")) / (100 + percent))
    must = F.greatest(F.lit(1), F.least(*(least_shared(percent) - F.ceil(percent * F.col(n) / 100) + common for n in ("n1", "n2"))))  # prefix length - (n - common)
    possible = F.least("s1", "s2") >= must  # neither prefix has fewer shingles that other components have
    joined = left.join(right, ["shingle", "block"]).where(larger & (F.col("c1") != F.col("c2")) & (F.col("g1") != F.col("g2")) & possible & _enough(F.col("n1"), F.col("n2"), most, percent))
    turned = [F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("a", "b", "a"), ("b", "a", "b"), ("c1", "c2", "c1"), ("c2", "c1", "c2"), ("n1", "n2", "n1"), ("n2", "n1", "n2"))]
    pairs = met.where(F.col("kind") == PAIR).select("a", "b", "c1", "c2", "n1", "n2").union(joined.select(*turned))

    enough = pairs.groupBy("a", "b", "c1", "c2", "n1", "n2").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= must)
    found = stored(enough.select(F.col("a").cast(doc_type).alias("a"), F.col("b").cast(doc_type).alias("b"), F.col("c1").cast(doc_type).alias("c1"), F.col("c2").cast(doc_type).alias("c2"), "k"), "candidates")
    for table in (met, mixed, listed, lists):
        discard(table)
    return found


def _size_block(n: Column, percent: int) -> Column:
    """Sets of two sizes can link only if their blocks are the same or next to each other."""
    return F.floor(F.log(n) / F.log(F.lit(100 / percent))).cast("int")


def _enough(n: Column, m: Column, common: Column, percent: int) -> Column:
    """100 * intersection >= percent * union."""
    return 100 * common >= percent * (n + m - common)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the minima of each set (centre, l)."""
    for batch in batches:
        lists = batch.column(1)
        first = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))))
        minima = _minima(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), first)
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, _lists([minima], [np.arange(0, len(minima) + 1, SKETCH)])], names=["centre", "l", "minima"])


def _cores(lists: DataFrame, percent: int) -> DataFrame | None:
    """``doc``, ``core`` and ``size`` of sets that agree in two minima and about in size with CENTRE_OF components or more; none without such sets.

    A frequent shingle is a minimum of many sets that have nothing else in
    common, which one minimum doesn't show. Each set is in its largest core only.
    """
    of_comp = lists.groupBy("k", "least", "comp").agg(F.count(F.lit(1)).alias("size"))
    large = stored(of_comp.groupBy("k", "least").agg(F.count(F.lit(1)).alias("comps")).where(F.col("comps") >= LARGE_GROUP).select("k", "least"), "large")
    if not large.limit(1).count():
        discard(large)
        return None
    near = lists.join(checked_broadcast(large), ["k", "least"]).groupBy("doc", "comp", "n").agg(F.collect_list(F.struct("k", "least")).alias("minima"))
    pairs = F.flatten(F.transform("minima", lambda x: F.transform(F.filter("minima", lambda y: x["k"] < y["k"]), lambda y: F.xxhash64(x, y, _size_block(F.col("n"), percent)))))
    shared = stored(near.select("doc", "comp", F.explode(pairs).alias("core")), "shared")
    of_core = shared.groupBy("core", "comp").agg(F.count(F.lit(1)).alias("size")).groupBy("core").agg(F.count(F.lit(1)).alias("comps"), F.sum("size").alias("size"))
    several = stored(of_core.where(F.col("comps") >= CENTRE_OF).select("core", "size"), "several")
    best = stored(shared.join(checked_broadcast(several), "core").groupBy("doc").agg(F.max_by("core", F.struct("size", "core")).alias("core")), "best")
    sizes = best.groupBy("core").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= CENTRE_OF)
    found = stored(best.join(checked_broadcast(sizes), "core").select("doc", "core", "size"), "cores")
    for table in (large, shared, several, best):
        discard(table)
    return found if found.limit(1).count() else None


def _centre_members(lists: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """``doc``, ``n``, ``comp``, ``grp`` and what ``_settled`` needs for the sets that are near the centre of a large group; none without such groups.

    Sets of one core have a candidate for a centre, and equal ones count as
    one. Sets of other cores or of none try it too if they share a minimum with
    it and are about as large, one candidate for each minimum. Each set keeps the
    candidate that most sets are near to, and ``grp`` is the least document of
    those that keep it.
    """
    cores = _cores(lists, percent)
    if cores is None:
        return None
    doc_type = texts.schema["doc"].dataType.simpleString()

    def sets_of(docs: DataFrame, label: str) -> DataFrame:
        needed = texts.join(checked_broadcast(docs), "doc", "left_semi")
        with small_batches(texts.sparkSession, BATCH_BYTES):
            return stored(needed.mapInArrow(_set_batches(shingle), f"doc {doc_type}, items array<bigint>").dropDuplicates(["doc"]), label)

    voters = stored(cores.where(F.pmod(F.xxhash64("doc"), F.ceil(F.col("size") / CENTRE_OF)) == 0), "voters")
    voting = sets_of(voters.select("doc"), "voting")
    votes = voting.join(checked_broadcast(voters), "doc").select("core", F.explode("items").alias("item")).groupBy("core", "item").agg(F.count(F.lit(1)).alias("n"))
    every = voters.groupBy("core", "size").agg(F.count(F.lit(1)).alias("all"))
    elected = votes.join(checked_broadcast(every), "core").where(2 * F.col("n") > F.col("all")).groupBy("core", "size").agg(F.array_sort(F.collect_list("item")).alias("l"))
    named = stored(elected.withColumn("centre", F.xxhash64("l")), "elected")
    centres = named.groupBy("centre").agg(F.any_value("l").alias("l"))
    centres = stored(centres.mapInArrow(_sketch_batches, "centre long, l array<bigint>, minima array<bigint>"), "centres")
    held = centres.select("centre", F.size("l").alias("nl"), "minima").join(checked_broadcast(named.groupBy("centre").agg(F.sum("size").alias("size"))), "centre")
    around = F.explode(F.array(*(_size_block(F.col("nl"), percent) + k for k in (-1, 0, 1)))).alias("block")
    sketched = held.select("centre", "size", around, "minima").select("centre", "size", "block", F.posexplode("minima").alias("k", "least"))
    sketched = stored(sketched.groupBy("k", "least", "block").agg(F.max_by("centre", F.struct("size", "centre")).alias("centre")), "sketched")
    beside = lists.withColumn("block", _size_block(F.col("n"), percent)).join(checked_broadcast(sketched), ["k", "least", "block"]).select("doc", "centre")
    own = cores.join(checked_broadcast(named.select("core", "centre")), "core").select("doc", "centre")
    sized = lists.where("k = 0").select("doc", "n", "comp")
    tried = stored(beside.union(own).distinct().join(sized, "doc").select("doc", "n", "comp", "centre"), "tried")
    sets = sets_of(tried.select("doc").distinct(), "sets")
    spelled = centres.select("centre", "l")
    if (centres.agg(F.sum(F.size("l"))).first()[0] or 0) <= BROADCAST_SHINGLES:
        spelled = F.broadcast(spelled)
    parted = tried.join(sets, "doc").join(spelled, "centre").select("doc", "n", "comp", "centre", F.size("l").alias("nl"), F.array_except("l", "items").alias("minus"), F.array_except("items", "l").alias("plus"))
    alike = 3 * (F.col("nl") - F.size("minus")) >= F.col("n") + F.col("nl")  # half of the union at least, so differences are bounded
    parted = stored(parted.where(alike).select("doc", "n", "comp", "centre", "nl", F.size("minus").alias("m"), F.size("plus").alias("p"), F.concat("minus", "plus").alias("d")), "parted")
    liked = parted.groupBy("centre").agg(F.count(F.lit(1)).alias("likes"))
    kept = parted.select("doc", "centre").join(checked_broadcast(liked), "centre").groupBy("doc").agg(F.max_by("centre", F.struct("likes", "centre")).alias("centre"))
    kept = stored(kept, "kept")
    groups = kept.groupBy("centre").agg(F.min("doc").alias("grp"), F.count(F.lit(1)).alias("size")).where("size > 1")
    found = stored(parted.join(kept, ["doc", "centre"]).join(checked_broadcast(stored(groups, "groups")), "centre"), "centred")
    for table in (cores, voters, voting, named, centres, sketched, tried, sets, parted, kept):
        discard(table)
    return found


def _settled(lists: DataFrame, texts: DataFrame, shingle: int, percent: int) -> tuple[DataFrame | None, DataFrame]:
    """Groups (``doc``, ``grp``) of sets whose pairs are settled by their centre, and the links (a < b) inside them between different ``comp``.

    A set is its centre l without m shingles and with p others, d in all, so
    two of them share |l| - m1 - m2 + |d1 & d2|, and d1 & d2 has
    min(m1, m2) + min(p1, p2) shingles at most. Members are dealt into squares
    of pairs of bounded size; a pair becomes a row only if it links.
    """
    members = _centre_members(lists, texts, shingle, percent)
    doc_type = texts.schema["doc"].dataType.simpleString()
    if members is None:
        return None, stored(texts.sparkSession.createDataFrame([], f"a {doc_type}, b {doc_type}"), "links")
    g = F.ceil(F.col("size") / MEMBERS_A_SQUARE).cast("int")
    dealt = members.withColumn("g", g).withColumn("u", F.pmod(F.xxhash64("doc"), F.col("g")).cast("int"))
    fields = ("doc", "n", "m", "p", "d", "comp")
    left = dealt.select("grp", "nl", F.col("u").alias("k1"), F.explode(F.sequence("u", F.col("g") - 1)).alias("k2"), *(F.col(c).alias(f"{c}1") for c in fields))
    right = dealt.select("grp", F.explode(F.sequence(F.lit(0), "u")).alias("k1"), F.col("u").alias("k2"), *(F.col(c).alias(f"{c}2") for c in fields))
    once = (F.col("comp1") != F.col("comp2")) & ((F.col("k1") < F.col("k2")) | (F.col("doc1") < F.col("doc2")))
    common = lambda both: F.col("nl") - F.col("m1") - F.col("m2") + both
    possible = _enough(F.col("n1"), F.col("n2"), common(F.least("m1", "m2") + F.least("p1", "p2")), percent)
    linked = _enough(F.col("n1"), F.col("n2"), common(F.size(F.array_intersect("d1", "d2"))), percent)
    pairs = left.join(right, ["grp", "k1", "k2"]).where(once & F.when(possible, linked).otherwise(False))
    found = stored(pairs.select(F.least("doc1", "doc2").alias("a"), F.greatest("doc1", "doc2").alias("b")), "links")
    groups = stored(members.select("doc", "grp"), "groups")
    discard(members)
    return groups, found


def _with_groups(owners: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``grp`` of each row by groups, or its own document."""
    if groups is None:
        return owners.withColumn("grp", F.col("doc"))
    return owners.join(groups, "doc", "left").withColumn("grp", F.coalesce("grp", "doc"))


def _group_links(star: DataFrame, texts: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Groups (``doc``, ``comp``) of sets that link to one leader, by the links with leaders; and all links inside groups.

    A set x of leader l is (l - minus) + plus, so two sets of l share what
    neither has lost and what both have added: |l| - |minus1 + minus2| +
    |plus1 & plus2|. The differences are bounded, as x and l link.
    """
    doc_type = texts.schema["doc"].dataType.simpleString()
    named = stored(star.groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("comp")), "named")
    follows = stored(named.join(named.select(F.col("doc").alias("comp")), "comp", "left_anti"), "follows")  # a leader has no leader
    groups = stored(follows.select("doc", "comp").union(follows.select("comp", "comp").distinct()), "groups")
    sets = stored(texts.join(groups, "doc", "left_semi").mapInArrow(_set_batches(shingle), f"doc {doc_type}, items array<bigint>"), "sets").dropDuplicates(["doc"])
    both = groups.join(sets, "doc").join(sets.select(F.col("doc").alias("comp"), F.col("items").alias("l")), "comp")
    parted = both.select("doc", "comp", F.size("items").cast("long").alias("n"), F.size("l").cast("long").alias("nl"), F.array_except("l", "items").alias("minus"), F.array_except("items", "l").alias("plus"))
    buckets = groups.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_A_BUCKET).cast("int").alias("g"))
    parted = stored(parted.join(buckets, "comp").withColumn("u", F.pmod(F.xxhash64("doc"), F.col("g")).cast("int")), "parted")
    every = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    left = parted.select("comp", F.col("u").alias("k1"), every.alias("k2"), "nl", *(F.col(c).alias(f"{c}1") for c in ("doc", "n", "minus", "plus")))
    right = parted.select("comp", every.alias("k1"), F.col("u").alias("k2"), *(F.col(c).alias(f"{c}2") for c in ("doc", "n", "minus", "plus")))
    common = F.col("nl") - F.size(F.array_union("minus1", "minus2")) + F.size(F.array_intersect("plus1", "plus2"))
    inside = left.join(right, ["comp", "k1", "k2"]).where(F.col("doc1") < F.col("doc2")).where(_enough(F.col("n1"), F.col("n2"), common, percent))
    return groups, inside.select(F.col("doc1").alias("a"), F.col("doc2").alias("b"))


def _all_links(owners: DataFrame, frequent: tuple[np.ndarray, np.ndarray], texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a < b) of all classes that link, each once."""
    lists = _minima_lists(owners, percent)
    groups, inside = _group_links(_leader_links(lists, 0, texts, shingle, percent), texts, shingle, percent)
    centred, across = _settled(stored(_named(lists, groups), "minima"), texts, shingle, percent)
    named = stored(_with_groups(_named(owners.select("doc"), groups), centred), "owners")
    candidates = _candidates(texts, named, frequent, shingle, percent)
    return stored(inside.union(across).union(_links(candidates.select("a", "b"), texts, shingle, percent)), "all-links")


def _texts(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    if docs.schema[doc_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{doc_col} must be an integer: number the rows and join other names afterwards")
    return docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text"))


def links(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``class_a`` and ``class_b`` (the lesser id first) for each pair of different shingle sets that link, each pair once.

    Texts with one set are named by their ``class_id``, as ``components`` gives
    it, and link with each other besides. The pairs of a group of similar texts
    grow with the square of its size.
    """
    texts = _texts(docs, doc_col, text_col)
    _, owners, frequent = _index(texts, shingle)
    return _all_links(owners, frequent, texts, shingle, percent).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))


def link_counts(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_col`` and ``n_links``, the number of other rows that its text links to, for each row of ``docs``.

    Rows with the same shingle set link. A text without shingles has no links;
    a null id counts with an equal text that has an id, else ``n_links`` is null.
    """
    texts = _texts(docs, doc_col, text_col)
    members, owners, frequent = _index(texts, shingle)
    found = _all_links(owners, frequent, texts, shingle, percent)
    sizes = stored(members.where("n > 0 and class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("k")), "sizes")
    both = found.union(found.select("b", "a"))
    others = both.join(sizes.select(F.col("class").alias("b"), "k"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("k").alias("others"))
    totals = sizes.join(others, "class", "left").select("class", (F.col("k") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    counted = F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("n_links"))
    return members.join(totals, "class", "left").select(F.col("doc").alias(doc_col), counted.cast("long").alias("n_links"))


def components(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_col``, ``n_shingles``, ``class_id`` and ``component_id`` for each row of ``docs``.

    Shingles are ``shingle`` words in a row, words being [^\\x20\\x09-\\x0D]+ with
    A-Z lower-cased; a text with fewer words has them all as one. Two texts
    link if 100 * intersection >= percent * union. ``class_id`` is the least
    id with the same set, ``component_id`` the least that links lead to. Null,
    empty and wordless texts have no shingles and stand alone. A null id has
    the class and component of an equal text with an id, else null. Other ids
    than integers raise a TypeError. Texts of any length are read whole; of
    several least or best ones the lesser id counts. Repeated
    rows are returned each; rows with one id are assumed to have one text. An
    empty table gives an empty result. Sets are compared by 64-bit hashes of
    their shingles.
    """
    texts = _texts(docs, doc_col, text_col)
    members, owners, frequent = _index(texts, shingle)
    lists, labels = _minima_lists(owners, percent), None
    few = LINKS_A_SET * owners.count()
    for turn in range(MAX_ROUNDS):
        named = stored(_named(lists, labels), "minima") if turn else lists
        more = _leader_links(named, turn, texts, shingle, percent)
        if turn:
            discard(named)
        n_more = more.count()
        labels = _merged(labels, more)
        discard(more)
        if n_more <= few and turn >= MIN_ROUNDS - 1:
            break
    named = stored(_named(lists, labels), "minima")
    centred, across = _settled(named, texts, shingle, percent)
    labels = _merged(labels, across)
    for table in (lists, named, across):
        discard(table)
    named = stored(_with_groups(_named(owners.select("doc"), labels), centred), "owners")
    candidates = _candidates(texts, named, frequent, shingle, percent)
    ends = (F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2"))
    first = stored(candidates.select("a", "b", "k", *ends).groupBy("c1", "c2").agg(F.max_by(F.struct("a", "b"), F.struct("k", "a", "b")).alias("p")).select("p.a", "p.b"), "pairs")
    labels = _merged(labels, _links(first, texts, shingle, percent))
    rest = candidates.select("a", "b").join(first, ["a", "b"], "left_anti")
    for end, comp in (("a", "c1"), ("b", "c2")):
        rest = rest.join(labels.select(F.col("doc").alias(end), F.col("comp").alias(comp)), end, "left")
    apart = stored(rest.where(F.coalesce("c1", "a") != F.coalesce("c2", "b")).select("a", "b"), "pairs")
    labels = _merged(labels, _links(apart, texts, shingle, percent)).select(F.col("doc").alias("class"), "comp")
    for table in (named, candidates, first, apart):
        discard(table)
    return members.join(labels, "class", "left").select(F.col("doc").alias(doc_col), F.col("n").alias("n_shingles"), F.col("class").alias("class_id"), F.coalesce("comp", "class").alias("component_id"))
