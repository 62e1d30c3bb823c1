"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every text is cut into words, and each run of K words is hashed. Of every W
consecutive hashes the least is kept as a fingerprint with its position; texts
that share K + W - 1 words in a row share one of those. Fingerprints of
documents and of benchmark items are joined, and each hit is extended word by
word to both sides. A benchmark item with fewer words than a window is looked
up by the hash of all its words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import checked_broadcast
from .scratch import stored

#: Words of a window; an occurrence of one in a document is a hit.
WINDOW = 10
#: Words of a hashed run, and runs of which one is kept: K + W - 1 == WINDOW.
K = 7
W = WINDOW - K + 1
#: Bits of a packed fingerprint that hold its position; the others hold its hash.
POSITION_BITS = 30
#: Benchmark fingerprints that are broadcast at most; beyond, both sides are shuffled.
BROADCAST_FINGERPRINTS = 500_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; none for null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.coalesce(F.array_remove(F.split(lowered, _SEPARATORS), ""), F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _runs(words: Column, k: int) -> Column:
    """Packed (hash of k words, position) of each run of k words."""
    def pack(word: Column, i: Column) -> Column:
        run = F.xxhash64(word, *(F.get(words, i + j) for j in range(1, k)))
        return F.shiftleft(run, POSITION_BITS).bitwiseOR(i.cast("long"))

    return F.slice(F.transform(words, pack), F.lit(1), F.size(words) - (k - 1))


def _least(runs: Column, length: int = 1) -> Column:
    """The least of every W consecutive runs, and of fewer at the end, each time from the least of up to three shorter stretches."""
    if length == W:
        return F.array_distinct(runs)
    longer = min(3 * length, W)
    last = longer - length
    shifts = sorted({min(length, last), last})
    stretch = F.transform(runs, lambda x, i: F.least(x, *(F.get(runs, i + s) for s in shifts)))
    return let(stretch, lambda x: _least(x, longer))


def winnowed(words: Column) -> Column:
    """Fingerprints of a text of a window at least; null for a shorter one."""
    return F.when(F.size(words) >= WINDOW, let(_runs(words, K), lambda runs: _least(runs)))


def _packed(rows: DataFrame, of: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``id``, ``n_words`` and, for each name, packed runs of the words."""
    # Words and runs are made in one expression, or the optimizer would repeat the split for every use of the words.
    made = let(words_of(F.col("text")), lambda words: F.struct(F.size(words).cast("long").alias("n_words"), *(f(words).alias(name) for name, f in of.items())))
    return rows.select("id", made.alias("m")).select("id", "m.*")


def _unpacked(rows: DataFrame) -> DataFrame:
    """``print`` and ``at`` of ``packed``."""
    at = F.col("packed").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")
    return rows.withColumns({"print": F.shiftright("packed", POSITION_BITS), "at": at}).drop("packed")


def _prints(rows: DataFrame) -> DataFrame:
    """A row for each fingerprint, the first of each text with ``k`` 0; one row with a null ``print`` for a text without any."""
    packed = _packed(rows, {"kept": winnowed}).select("id", "n_words", F.posexplode_outer("kept").alias("k", "packed"))
    return _unpacked(packed).withColumn("k", F.coalesce("k", F.lit(0)))


def _met(prints: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of documents whose fingerprint an item has, and the first row of each document in any case."""
    if items.count() <= BROADCAST_FINGERPRINTS:
        items = F.broadcast(items)
        return prints.join(items, "print", "left").where(F.col("class_id").isNotNull() | (F.col("k") == 0))
    hits = prints.where("print is not null").join(items, "print")  # a null, of which there may be many, meets nothing
    none = [F.lit(None).cast(t).alias(c) for c, t in items.dtypes if c != "print"]
    return hits.unionByName(prints.where("k = 0").select("print", "id", "n_words", "k", "at", *none))


def _classes(items: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of items (``id`` and ``key``) by their keys: stored tables of ``class_id`` with the key, and of ``class_id`` with each ``item_id``."""
    items = stored(items.distinct(), "bench-prints")
    classes = stored(items.select(*key).distinct().withColumn("class_id", F.monotonically_increasing_id()), "bench-classes")
    return classes, stored(items.join(classes, key).select("class_id", F.col("id").alias("item_id")), "bench-members")


def _extended(found: DataFrame) -> DataFrame:
    """Spans of documents, of a window at least, that are in an item."""
    def agrees(shift: int) -> Column:
        i, j = F.col("before") + shift, F.col("item_before") + shift
        return (i >= 0) & (j >= 0) & F.coalesce(F.get("words", F.greatest(i, F.lit(0))) == F.get("item_words", F.greatest(j, F.lit(0))), F.lit(False))

    def reach(shifts: range) -> Column:
        """How many words in a row agree."""
        length = F.lit(len(shifts))
        for n, shift in reversed(list(enumerate(shifts))):
            length = F.when(~agrees(shift), n).otherwise(length)
        return length

    same = F.lit(True)
    for shift in range(K):
        same = same & agrees(shift)
    spans = found.where(same).select("id", "class_id", "at", reach(range(-1, K - WINDOW - 1, -1)).alias("left"), reach(range(K, WINDOW)).alias("right"))
    return spans.where(F.col("left") + F.col("right") + K >= WINDOW).select("id", "class_id", (F.col("at") - F.col("left")).alias("start"), (F.col("left") + K + F.col("right")).alias("length"))


def _around() -> Column:
    """The words beside a fingerprint that an extension may look at."""
    return F.slice("words", F.greatest(F.col("at") - (WINDOW - K), F.lit(0)) + 1, F.lit(2 * WINDOW - K))


def _short_runs(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``id``, ``n_words``, ``length``, ``print`` and ``at`` of all runs of each of a few lengths, in one pass over the texts."""
    packed = _packed(rows, {f"runs{n}": (lambda words, n=n: F.when(F.size(words) >= n, _runs(words, n))) for n in lengths})
    each = F.array(*(F.struct(F.lit(n).alias("length"), F.col(f"runs{n}").alias("runs")) for n in lengths))
    return _unpacked(packed.select("id", "n_words", F.explode(each).alias("r")).select("id", "n_words", "r.length", F.explode("r.runs").alias("packed")))


def find_overlaps(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", doc_text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each document, the words that lie in windows of benchmark items, and those items.

    Returns ``doc_col``, ``n_words``, ``n_hit``, ``item_ids`` (sorted as
    strings), ``hit_spans`` (start and length, in words), ``contaminated`` and
    ``text_hash`` (xxhash64) for each row. A null or wordless text has no words
    and no hits; a null or wordless item hits nothing. Rows that repeat an id,
    or have none, are told apart by their texts. An empty table on either side
    gives no hits. Texts of any length are read whole; items that repeat count
    once each by id. Other columns are ignored.
    """
    bench = items.select(F.col(item_col).cast("string").alias("id"), F.col(item_text).alias("text"), F.size(words_of(F.col(item_text))).alias("n"))
    bench = stored(bench.where("id is not null and n > 0"), "bench-words")
    key = F.struct(F.col(doc_col).alias("doc"), F.xxhash64(doc_text).alias("text_hash"))
    texts = docs.select(key.alias("id"), F.col(doc_text).alias("text"))

    spelled = bench.select("id", words_of(F.col("text")).alias("words"))
    before = F.least("at", F.lit(WINDOW - K))
    of_items = _prints(bench).where("print is not null").join(spelled, "id").select("print", "id", before.alias("item_before"), _around().alias("item_words"))
    # Items that agree in a run and the words around it are one class, so a run that many of them share is few rows of the join.
    classes, members = _classes(of_items, ["print", "item_before", "item_words"])
    met = stored(_met(_prints(texts), classes), "met")

    # Only texts with a hit are cut into words again; their words never go through the join of the fingerprints.
    hits = met.where("class_id is not null").select("id", "at", "class_id", "item_before", "item_words")
    hit_ids = stored(hits.select("id").distinct(), "hit-ids")
    spelled = texts.join(checked_broadcast(hit_ids), "id", "left_semi").select("id", words_of(F.col("text")).alias("words")).dropDuplicates(["id"])
    spans = _extended(hits.join(spelled, "id").select("id", "at", before.alias("before"), _around().alias("words"), "class_id", "item_before", "item_words"))
    spans = stored(spans, "spans")
    found_items = spans.select("id", "class_id").distinct().join(members, "class_id").select("id", "item_id")

    lengths = sorted(r.n for r in bench.where(F.col("n") < WINDOW).select("n").distinct().collect())  # nine at most
    if lengths:
        short = _short_runs(bench.where(F.col("n") < WINDOW), lengths).where("n_words = length").join(bench.select("id", words_of(F.col("text")).alias("item_words")), "id")
        short, members = _classes(short.select("id", "print", "length", "item_words"), ["print", "length", "item_words"])
        shorts = F.broadcast(short) if short.count() <= BROADCAST_FINGERPRINTS else short
        occurring = stored(_short_runs(texts, lengths).join(shorts, ["print", "length"]).select("id", "at", "length", "class_id", "item_words"), "short-met")
        short_ids = stored(occurring.select("id").distinct(), "hit-ids")
        spelled = texts.join(checked_broadcast(short_ids), "id", "left_semi").select("id", words_of(F.col("text")).alias("words")).dropDuplicates(["id"])
        exact = F.slice("words", F.col("at") + 1, F.col("length")) == F.col("item_words")
        occurring = stored(occurring.join(spelled, "id").where(exact).select("id", "class_id", F.col("at").alias("start"), "length"), "short-spans")
        spans = spans.union(occurring)
        found_items = found_items.union(occurring.select("id", "class_id").distinct().join(members, "class_id").select("id", "item_id"))

    covered = F.size(F.array_distinct(F.flatten(F.transform("hit_spans", lambda s: F.sequence(s.start, s.start + s.length - 1)))))
    nothing = F.lit(None)
    rows = met.where("k = 0").select("id", "n_words", nothing.cast("string").alias("item_id"), nothing.cast("struct<start:int,length:int>").alias("span"), F.lit(0).alias("rows"))
    rows = rows.union(spans.select("id", nothing.cast("long"), nothing.cast("string"), F.struct(F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length")), F.lit(0)))
    rows = rows.union(found_items.select("id", nothing.cast("long"), "item_id", nothing.cast("struct<start:int,length:int>"), F.lit(0)))
    rows = rows.union(texts.select("id", nothing.cast("long"), nothing.cast("string"), nothing.cast("struct<start:int,length:int>"), F.lit(1)))
    return (
        rows.groupBy("id")
        .agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.sort_array(F.collect_set("span")).alias("hit_spans"), F.sum("rows").cast("int").alias("rows"))
        .withColumn("row", F.explode(F.sequence(F.lit(1), "rows")))
        .select(F.col("id.doc").alias(doc_col), "n_words", F.coalesce(covered.cast("long"), F.lit(0)).alias("n_hit"), "item_ids", "hit_spans", (F.size("hit_spans") > 0).alias("contaminated"), F.col("id.text_hash").alias("text_hash"))
    )
