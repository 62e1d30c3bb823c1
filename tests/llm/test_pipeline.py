"""The join, and the stages of the corpus pipeline, against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from millrace.llm import jaccard_join  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def classes_by_force(texts, shingle, percent):
    """The least id that links lead to, for each id."""
    sets = {}
    for k, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[k] = {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1) if words else 0)}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: find(k) for k in texts}


def near_copies(seed, chains=6, links=9):
    """Chains of texts, each some words away from the one before, with copies and short texts between."""
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(300)]
    texts = []
    for _ in range(chains):
        words = rng.choices(vocabulary, k=rng.choice([4, 12, 40, 90]))
        for _ in range(links):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[rng.choice([0, 1]) :] + rng.choices(vocabulary, k=rng.choice([0, 1]))
    texts += [None, "", " \n", "one two", "ONE  two", "one"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize(("shingle", "percent"), [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, shingle, percent):
    texts = near_copies(7)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.components(docs, shingle=shingle, percent=percent).collect()}
    assert got == classes_by_force(texts, shingle, percent)


def test_join_keeps_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", 1), (4, "a b c d e f", 2), (4, "a b c d e f", 2), (2, "A b c d e f", 3), (None, None, 4)], "doc_id long, text string, component_id int")
    got = jaccard_join.components(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 2), (2, 2), (4, 2), (4, 2)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    vocabulary = {"en": "the house and tree with water stands near old mill under grey sky today".split(), "de": "das haus und baum mit wasser steht neben alter muehle unter grauem himmel heute".split()}
    data = []
    for k in range(120):
        lang = ("en", "de")[k % 2]
        words = rng.choices(vocabulary[lang], k=30)
        if k % 10 == 3:
            words += ["idiot", "scum"] * 3
        data.append((k, " ".join(words), lang, "s", 0))
    passage = "a benchmark passage of ten words that must never remain here"
    data += [(200, data[0][1], "en", "s", 0), (201, data[2][1] + " " + passage, "en", "s", 0), (202, None, None, None, None), (203, "", "en", "s", 0), (204, "12 34", None, "s", 0), (None, data[4][1] + " mill", "en", "s", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 10 == 3)) for k in range(120)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, data


def test_stages(spark, corpus):
    folder, data = corpus
    docs = spark.createDataFrame(data, SCHEMA)
    kept = defaultdict(list)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "bpe":
            assert out.columns == docs.columns
        kept[name] = sorted((r.doc_id for r in out.select("doc_id").collect()), key=lambda k: -1 if k is None else k)
    assert {202, 203, 204}.isdisjoint(kept["language_id"]) and set(range(120)) <= {*kept["language_id"]}
    classes = classes_by_force({r[0]: r[1] for r in data if r[0] is not None}, 5, 80)
    assert [k for k in kept["jaccard_join"] if k is not None] == [k for k, c in sorted(classes.items()) if k == c]
    assert {*kept["decontamination"]} == {r[0] for r in data} - {201}
    assert len(kept["bpe"]) == len(data)


def test_run(spark, corpus):
    folder, data = corpus
    got = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert got.isdisjoint({200, 201, 202, 203, 204}) and len(got & {k for k in range(120) if k % 10 != 3}) >= 100


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, corpus, name):
    empty = spark.createDataFrame([], SCHEMA)
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, corpus[0]).select(F.lit(1)).count() == 0


@pytest.mark.parametrize(("shingle", "percent", "bucket"), [(3, 90, 500), (5, 80, 500), (2, 60, 2)])
def test_links_equal_brute_force(spark, monkeypatch, shingle, percent, bucket):
    monkeypatch.setattr(jaccard_join, "MEMBERS_A_BUCKET", bucket)
    texts = near_copies(11)
    sets = {}
    for k, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[k] = frozenset(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1) if words else 0))
    linked = {(a, b) for a in texts for b in texts if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    first = {k: min(j for j in texts if sets[j] == sets[k]) for k in texts}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = [(r.class_a, r.class_b) for r in jaccard_join.links(docs, shingle=shingle, percent=percent).collect()]
    assert sorted(got) == sorted({(a, b) for a, b in linked if first[a] == a and first[b] == b and sets[a] != sets[b]})
    counts = {r.doc_id: r.n_links for r in jaccard_join.link_counts(docs, shingle=shingle, percent=percent).collect()}
    assert counts == {k: sum(k in pair for pair in linked) for k in texts}


def test_stages_take_null_and_repeated_ids(spark, corpus):
    folder, data = corpus
    passage = "a benchmark passage of ten words that must never remain here"
    more = " and then so many more words that it is far from any other text"
    one, two = ("alpha beta gamma delta epsilon zeta eta theta iota kappa", "lorem ipsum dolor sit amet consectetur adipiscing elit sed do")
    rows = [(7, one), (7, one), (None, one), (None, two), (None, two), (None, passage), (None, None), (8, passage + more), (8, "clean words stay")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], SCHEMA)
    key = lambda r: (r[0] or 0, r[1] or "")
    near = corpus_pipeline.drop_near_duplicates(spark, docs, folder).select("doc_id", "text").collect()
    assert sorted(map(tuple, near), key=key) == sorted([(7, one), (None, two), (None, passage), (None, None), (8, passage + more), (8, "clean words stay")], key=key)
    clean = corpus_pipeline.drop_benchmark_passages(spark, docs, folder).select("doc_id", "text").collect()
    assert sorted(map(tuple, clean), key=key) == sorted([(k, t) for k, t in rows if passage not in (t or "")], key=key)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_pass_columns_on_whatever_their_names_are(spark, corpus, name):
    """With columns named like those that operators make, a stage keeps the rows that it keeps without them, repeated and nameless ones too."""
    folder, data = corpus
    clashing = ("score", "predicted", "lang_pred", "row_key", "component_id", "hit_id", "text_hash", "n_tokens", "doc", "class")
    data = [r for r in data if r[0] is not None and r[0] < 40 or r[0] in (200, 201, 202, 203, 204)] + [(None, None, None, None, None), (None, data[5][1], "en", "s", 1)] + [data[1]] * 2
    plain = spark.createDataFrame(data, SCHEMA).coalesce(1)
    wide = plain.select("*", *(F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in clashing))
    stage = dict(corpus_pipeline.STAGES)[name]
    key = lambda r: tuple(map(str, r))
    want, got = stage(spark, plain, folder), stage(spark, wide, folder)
    if name == "bpe":
        assert sorted(map(tuple, got.select(want.columns).collect()), key=key) == sorted(map(tuple, want.collect()), key=key) and want.count() == len(data)
        return
    assert got.columns == wide.columns
    rows = got.collect()
    assert sorted((tuple(r)[: len(plain.columns)] for r in rows), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert all(r[c] == f"{c} {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in clashing)


def just_apart(seed, copies=150):
    """Texts that differ from a text that isn't there in three words each: similar, but most pairs lie below 80 of 100."""
    rng = random.Random(seed)
    base = [f"base{k}" for k in range(150)]
    texts = []
    for k in range(copies):
        words = list(base)
        for at in rng.sample(range(len(base)), 3):
            words[at] = f"other{k}x{at}"
        texts.append(" ".join(words))
    return dict(enumerate(texts))


def test_pairs_just_below_the_threshold_are_not_made(spark, monkeypatch):
    texts, listed, real = just_apart(5), [], jaccard_join.stored

    def counted(df, label, *more):
        found = real(df, label, *more)
        if label == "lists":  # entries that the index joins with each other
            listed.append(found.count())
        return found

    monkeypatch.setattr(jaccard_join, "stored", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.components(docs).collect()}
    assert got == classes_by_force(texts, 5, 80)
    assert listed[0] <= len(texts)


def test_sets_with_one_frequent_shingle_in_common_elect_no_centre(spark, monkeypatch):
    """What a centre is made of must not grow with sets that share a minimum and nothing else; sets just apart get theirs beside them."""
    rng, elected, real = random.Random(3), [], jaccard_join.stored

    def counted(df, label, *more):
        found = real(df, label, *more)
        if label == "elected":
            elected.append(found.count())
        return found

    monkeypatch.setattr(jaccard_join, "stored", counted)
    monkeypatch.setattr(jaccard_join, "LARGE_GROUP", 8)
    monkeypatch.setattr(jaccard_join, "CENTRE_OF", 8)
    texts = {k: " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(15, 31))), "one very common line here"]) for k in range(400)}
    apart = {1000 + k: text for k, text in just_apart(7, 60).items()}
    for more, most in (({}, 0), (apart, 6)):
        elected.clear()
        docs = spark.createDataFrame(list((texts | more).items()), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in jaccard_join.components(docs).collect()}
        assert got == classes_by_force(texts | more, 5, 80)
        assert bool(more) <= sum(elected) <= most


@pytest.mark.parametrize(("shingle", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_centres_of_small_groups_keep_all_links(spark, monkeypatch, shingle, percent):
    for name, value in (("LARGE_GROUP", 2), ("CENTRE_OF", 2), ("MEMBERS_A_SQUARE", 3), ("BROADCAST_SHINGLES", 100)):
        monkeypatch.setattr(jaccard_join, name, value)
    texts = near_copies(13) | {1000 + k: text for k, text in just_apart(6, 20).items()}
    rows = list(texts.items())
    docs = spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.components(docs, shingle=shingle, percent=percent).collect()}
    assert got == classes_by_force(texts, shingle, percent)
    sets = {}
    for k, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[k] = frozenset(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1) if words else 0))
    first = {s: min(k for k in texts if sets[k] == s) for s in sets.values() if s}
    linked = sorted((min(a, b), max(a, b)) for s, a in first.items() for r, b in first.items() if a < b and 100 * len(s & r) >= percent * len(s | r))
    assert sorted((r.class_a, r.class_b) for r in jaccard_join.links(docs, shingle=shingle, percent=percent).collect()) == linked
