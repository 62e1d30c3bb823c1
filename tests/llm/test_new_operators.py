import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from millrace.llm import joins, lexical, merkle, simhash, textkit  # noqa: E402

WORDS = [f"w{k % 97}x{k % 13}" for k in range(400)]
LONG = " ".join(WORDS)
TEXTS = [None, "", " \n\t", LONG, LONG.upper(), LONG.replace("w5x5", "other"), "one", "one two", "One\ttwo  three", "Été ñ İ one \u2028two", "rep " * 500, "z" * 5000, LONG, "a\x00b c d", "one two"]


def linked(n, links):
    """The least member of each one's component."""
    label = [*range(n)]
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


# --- pieces of texts ---

def test_pieces_cut_before_separators_only(monkeypatch):
    rng = random.Random(1)
    for size in (1, 7, 5000):
        monkeypatch.setattr(textkit, "PIECE_BYTES", size)
        for _ in range(60):
            text = "".join(rng.choice("aé  \n") * rng.choice([1, 1, 30, 5000]) for _ in range(rng.randrange(12))).encode()
            parts = [*textkit.pieces(memoryview(text), b" \t\n\x0b\x0c\r")]
            assert b"".join(parts) == text and all(p[:1] in (b" ", b"\n") for p in parts[1:])
            assert [w for ws in textkit.blank_words(memoryview(text)) for w in ws] == text.split()


# --- SimHash ---

def simhash_by_force(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + shingle]) for k in range(max(len(words) - shingle + 1, min(len(words), 1)))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(w if rng.random() > 0.004 else "new" for w in WORDS) for _ in range(60)] + [" ".join(rng.choices(WORDS, k=rng.randrange(1, 6))) for _ in range(40)]
    docs = spark.createDataFrame([(k if k != 3 else None, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, fingerprint string").repartition(5)
    want = [simhash_by_force(t) for t in texts]
    n = len(texts)
    label = linked(n, [(a, b) for a in range(n) for b in range(a) if (want[a] ^ want[b]).bit_count() <= 2])
    named = lambda members: min((k for k in members if k != 3), default=None)
    rows = sorted((r.doc_id if r.doc_id is not None else 3, r.fingerprint, r.component_id, r.class_id) for r in simhash.components(docs, node_size=8).collect())
    assert rows == [(k, f"{want[k]:016x}", named(j for j in range(n) if label[j] == label[k]), named(j for j in range(n) if want[j] == want[k])) for k in range(n)]
    assert len({c for _, _, c, _ in rows}) < len({f for _, f, _, _ in rows}) < n
    assert simhash.components(docs.where("false")).count() == 0


def test_fingerprints_of_long_texts_are_those_of_their_pieces(monkeypatch):
    text = LONG * 3
    monkeypatch.setattr(textkit, "PIECE_BYTES", 10)
    assert simhash._fingerprint(memoryview(text.encode()), 3) % (1 << 64) == simhash_by_force(text)
    assert simhash._fingerprint(memoryview(b"one two"), 3) % (1 << 64) == simhash_by_force("one two")


@pytest.mark.parametrize(("node_size", "budget"), [(1, 2), (10, 0), (10, 2), (5000, 3)])
def test_trie_join_finds_each_pair_once(spark, node_size, budget):
    """A dense region, fingerprints at the budget and one bit beyond, and far ones."""
    rng = random.Random(node_size + budget)
    prints = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1, 1 << 63, 3}
    for p in [*prints][:80]:
        for bits in (1, budget, budget + 1):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), bits)))
    dense = rng.getrandbits(64)
    prints |= {dense ^ rng.getrandbits(7) for _ in range(90)}
    prints = sorted(prints)
    want = {(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= budget}
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    pairs = [tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash._near(table, budget, node_size, forest=False).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    if node_size == 10:
        place = {p: k for k, p in enumerate(prints)}
        few = [(place[r.a % (1 << 64)], place[r.b % (1 << 64)]) for r in simhash._near(table, budget, node_size, forest=True).collect()]
        both = [(place[a], place[b]) for a, b in want]
        assert linked(len(prints), few) == linked(len(prints), both)


def test_links_name_fingerprints_and_distances(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b c d e f", "A b c d e f", "a b c d e f g", "other words entirely here now"])], "doc_id long, text string")
    got = {(r.print_a, r.print_b): r.distance for r in simhash.links(docs, budget=64).collect()}
    prints = sorted({simhash_by_force(t) for t in ("a b c d e f", "a b c d e f g", "other words entirely here now")}, key=lambda p: p - (1 << 64) if p >> 63 else p)
    assert got == {(f"{a:016x}", f"{b:016x}"): (a ^ b).bit_count() for k, a in enumerate(prints) for b in prints[k + 1 :]}


# --- Merkle manifest ---

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_by_force(leaves):
    """The root, and for each leaf its siblings before and after it on all levels."""
    paths, level = [[] for _ in leaves], [(d, [k]) for k, d in enumerate(leaves)]
    while len(level) > 1:
        above = []
        for start in range(0, len(level), 16):
            run = level[start : start + 16]
            for k, (_, below) in enumerate(run):
                for leaf in below:
                    paths[leaf].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :])))
            above.append((digest(*(d for d, _ in run)), [x for _, below in run for x in below]))
        level = above
    return level[0][0], paths


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 255, 256, 257, 600, 4096])
def test_traversal_gives_each_path(n):
    leaves = [digest(str(k)) for k in range(n)]
    root, paths = tree_by_force(leaves)
    levels = merkle.height(n)
    assert [*merkle.traverse(leaves, levels)] == paths and merkle.block_root(leaves, levels) == root
    assert all(merkle.fold(leaf, path) == root for leaf, path in zip(leaves, paths))


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_equals_brute_force(spark, levels):
    sources = [None] * 3 + ["", "é", "z"] + ["b"] * 16 + ["a"] * 17 + [f"s{k:02d}" for k in range(20)] + ["hot"] * 700
    data = [(k if k not in (9, 40) else None, None if k % 11 == 0 else f"T{k} É" * (k % 4), [None, "en"][k % 2], s, k if k % 7 else None) for k, s in enumerate(sources)]
    data += [data[50]] * 40  # repeated rows
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars int").repartition(6)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", "TABC", "tabc")).otherwise(F.col("text"))
    got = [tuple(r) for r in merkle.manifest(docs.withColumn("tree", F.lit("clash")).withColumn("leaf", F.lit(1)), claims={"text": tampered}, levels=levels).collect()]

    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda k, text, lang, source, n: digest(*map(field, (k, source, lang, n, text)))
    trees = {}
    for r in data:
        lower = r[1] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        trees.setdefault(r[3], []).append((-1 if r[0] is None else r[0], leaf(*r), leaf(r[0], r[1].translate(str.maketrans("TABC", "tabc")) if lower else r[1], *r[2:]), r[0]))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: tree_by_force([x[1] for x in sorted(trees[s], key=lambda x: x[:2])]) for s in names}
    root, upper = tree_by_force([made[s][0] for s in names])
    want = []
    for s, above in zip(names, upper):
        for (_, own, claim, k), path in zip(sorted(trees[s], key=lambda x: x[:2]), made[s][1]):
            folded = merkle.fold(claim, path + above)
            want.append((k, own, made[s][0], root, digest(*(b + a for b, a in path + above)), folded, folded == root))
    order = lambda r: tuple(map(str, r))
    assert sorted(got, key=order) == sorted(want, key=order)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3
    assert merkle.manifest(docs.where("false")).count() == 0


def test_manifest_of_one_row_and_of_text_ids(spark):
    one = spark.createDataFrame([("x", "t", "en", "s", 1)], "doc_id string, text string, lang string, source string, n_chars int")
    r = merkle.manifest(one).first()
    assert r.doc_id == "x" and r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == digest("")


# --- lexical search ---

def ranked_by_force(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = [(doc, Counter(terms(t))) for doc, t in docs]
    n_docs, n_terms = sum(1 for _, c in found if c), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for item, t in items:
        asked.setdefault(item, Counter()).update(terms(t))
    out = []
    for item, want in asked.items():
        scores = []
        for doc, c in found:
            m = 75 + (25 * c.total() * n_docs) // n_terms if n_terms else 0
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in want.items() if c[t])
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(item, rank, doc if there else None, -score) for rank, (score, there, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize("broadcast", [True, False])
def test_search_equals_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(joins, "BROADCAST_KEYS", 0)
    rng = random.Random(8)
    words = [f"t{k}" for k in range(60)] + ["The", "É", "x_y"]
    docs = [(k, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(63)], k=rng.randrange(0, 80)))) for k in range(300)]
    docs += [(k, docs[5][1]) for k in range(300, 330)] + [(5, docs[5][1]), (None, docs[7][1]), (400, None), (401, ""), (402, "!?"), (403, "t1 " * 4000 + "t2")]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for k in range(25)] + [(30, None), (31, ""), (32, "absent words"), (0, "t1 T1 t2"), (33, docs[5][1])]
    table = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, term string, row int").repartition(5)
    asked = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, bucket string")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank(table, asked, k=7).collect()), key=lambda r: r[:2])
    assert got == ranked_by_force(docs, items, 7)
    assert lexical.rank(table.where("false"), asked).count() == lexical.rank(table, asked.where("false")).count() == 0


def test_postings_of_all_terms_serve_any_search(spark, monkeypatch):
    monkeypatch.setattr(textkit, "PIECE_BYTES", 8)
    docs = [(1, "red red blue"), (2, "blue green"), (3, "Green-green tea")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    index = lexical.postings(table)
    assert sorted((r.term, r.doc, r.times, r.n) for r in index.where("term is not null").collect()) == [("blue", 1, 1, 3), ("blue", 2, 1, 2), ("green", 2, 1, 2), ("green", 3, 2, 3), ("red", 1, 2, 3), ("tea", 3, 1, 3)]
    assert index.where("term is null").count() == 3
    items = [(1, "green"), (2, "red tea")]
    found = lexical.search(index, lexical.item_terms(spark.createDataFrame(items, "item_id long, text string")), k=5)
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()) == ranked_by_force(docs, items, 5)


def test_trie_in_a_task_prunes_as_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    sets = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(6), base ^ np.uint64(7 << 40)]))
    n = len(sets)
    zero, all_ = np.zeros(1, np.int64), np.full(1, n, np.int64)
    one, two = simhash._traversed(sets, (zero, all_, zero, all_, zero, zero), 2)
    assert {(min(a, b), max(a, b)) for a, b in zip(one.tolist(), two.tolist())} == {(a, b) for a in range(n) for b in range(a + 1, n) if int(sets[a] ^ sets[b]).bit_count() <= 2}
