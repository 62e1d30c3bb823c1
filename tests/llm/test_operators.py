import hashlib
import re
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from millrace.llm import bpe, chat_format, decontaminate, jaccard_join, language_id, license_scan, quality_rules, sharding, toxicity, url_filter  # noqa: E402

WORDS = [f"w{k % 97}x{k % 13}" for k in range(400)]
LONG = " ".join(WORDS)
TEXTS = [None, "", "   \n", LONG, LONG, LONG.upper(), LONG.replace("w5x5", "other"), "one two", "a\nb\na\n\n", "ein Wort\tÉtude ñandú “quoted” İ ΑΣ ١٢ <|endoftext|> it's x_y 3½", "rep " * 50, "z" * 5000, "idiot " + LONG[:200]]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(k, t, "en", f"s{k % 2}", k) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_words long")


def empty(df):
    return df.where("false")


def test_quality_rules(docs):
    got = {r.doc_id: r for r in quality_rules.score_hosts(docs).collect()}
    for k, text in enumerate(TEXTS):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        at = defaultdict(list)
        for i in range(len(words) - 7):
            at[tuple(words[i : i + 8])].append(i)
        covered = {i + j for found in at.values() if len(found) > 1 for i in found for j in range(8)}
        assert (got[k].n_words, got[k].word_chars, got[k].n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
    assert got[8].n_dup_lines == 1
    assert quality_rules.score_hosts(empty(docs)).count() == 0


def test_bpe_equals_the_library(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = bpe.Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode_documents(docs, path).collect()}
    for k, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[k].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(empty(docs), path).count() == 0


def test_lexicon_finds_all_its_words_and_no_others(tmp_path):
    entries = {w: [k, k + 1][: 1 + k % 2] for k, w in enumerate(["tap", "taps", "top", "tops", "é", "stop"])}
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon(entries))
    lexicon = bpe.Lexicon(str(path))
    assert {w: lexicon.find(w.encode()) for w in entries} == entries
    assert lexicon.find(b"ta") is None and lexicon.find(b"tapss") is None


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, " ".join(WORDS[50:75])), (2, "Two"), (3, None), (4, "not there at all in any of these documents here")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_overlaps(docs, items).collect()}
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: split.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for r in items.collect():
        w = fold(r.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(r.item_id))
    for k, text in enumerate(TEXTS):
        w, hit, found = fold(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit |= {*range(i, i + n)}
                    found |= ids
        assert (got[k].n_words, got[k].n_hit, got[k].item_ids) == (len(w), len(hit), sorted(found))
    assert decontaminate.find_overlaps(empty(docs), items).count() == 0
    assert decontaminate.find_overlaps(docs, empty(items)).where("contaminated").count() == 0


def test_toxicity_and_language(spark, docs):
    labels = spark.createDataFrame([(12, 1), (3, 0)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r.score <= 1 for r in scored)
    found = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert found[0].lang_pred == found[1].lang_pred == "und" and found[3].lang_pred == "en"
    assert language_id.identify(empty(docs), language_id.train(empty(docs))).count() == 0


def test_jaccard(docs):
    got = {r.doc_id: r for r in jaccard_join.components(docs).collect()}
    assert got[0].n_shingles == got[1].n_shingles == got[2].n_shingles == 0 and got[1].component_id == 1
    assert got[4].component_id == got[5].component_id == got[6].component_id == 3
    assert got[7].n_shingles == 1
    assert jaccard_join.components(empty(docs)).count() == 0


def test_sharding(docs):
    many = docs.crossJoin(docs.sparkSession.range(40)).withColumn("doc_id", F.col("doc_id") * 100 + F.col("id")).drop("id")
    sums = sharding.shard(many, n_shards=5).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("s"), F.count_distinct("slot").alias("n")).collect()
    assert len(sums) == 5 and all(r.s + 1 == r.n for r in sums) and max(r.b for r in sums) < 1.1 * min(r.b for r in sums)
    assert sharding.shard(empty(docs), n_shards=5).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.Net/x"), (2, "https://w.example.net/en/1?q"), (3, None), (4, "no scheme"), (5, "http://net")], "page_id long, url string")
    rules = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2] == ("w.example.net", "/en/1", "example.net/en/", "allow")
    assert got[3][:3] == got[4][:3] == ("", "", None) and got[5][:3] == ("net", "", None)


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "ann", "hi"), (1, 1, "bob", "yo <|end|>"), (1, 2, None, None), (2, 0, "system", "s")], "conv_id long, turn long, role string, text string")
    got = {r.perspective: r for r in chat_format.rotate(turns).collect()}
    assert set(got) == {"ann", "bob", "unknown"}
    start, length = map(int, got["bob"].mask.split(":"))
    assert got["bob"].rendered[start : start + length] == "yo < |end|>" + chat_format.END


def test_licenses(spark):
    docs = spark.createDataFrame([(1, "x\nReleased under the MIT License."), (2, "Copyright notes of another kind, with words that no template has"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_documents(docs).collect()}
    assert got[1].license == "MIT" and got[1].confirmed and got[1].block == 1 and not got[2].confirmed and 3 not in got


def test_licenses_inside_lines_and_over_lines(spark):
    wrapped = "Some code\n\n# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n# in the Software without restriction, including without limitation the rights\n# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n# copies of the Software, and to permit persons to whom the Software is\n# furnished to do so, subject to the following conditions:\nx = 1"
    inside = "Many words stand before it. Released under the MIT License. More words stand behind it, and it is licensed under CC BY-NC 4.0. The end."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    docs = spark.createDataFrame([(1, wrapped), (2, inside), (3, mpl), (4, "Released under the Foo License.")], "doc_id long, text string")
    got = {k: [] for k in range(1, 5)}
    for r in license_scan.scan_documents(docs).orderBy("doc_id", "block", "license").collect():
        got[r.doc_id].append((r.block, r.license, r.confirmed))
    assert got[1] == [(2, "MIT", True)]
    assert got[2] == [(0, "CC-BY-NC-4.0", True), (0, "MIT", True)]
    assert (0, "MPL-2.0", True) in got[3] and all(name == "MPL-2.0" and sure for _, name, sure in got[3])
    assert [sure for _, _, sure in got[4]] == [False]


def test_language_of_long_runs(spark):
    letters = {"aa": "абвгдежз", "bb": "ийклмноп"}
    data = [(k, lang, (chars[k % 8 :] + chars[: k % 8]) * 20) for k in range(8) for lang, chars in letters.items()]
    model = language_id.train(spark.createDataFrame(data * 5, "doc_id long, lang string, text string"))
    assert model.langs == ["aa", "bb"] and all(len(w) <= language_id.PIECE for w in model.words)
    docs = spark.createDataFrame([(1, "абвг" * 16 + "ийкл" * 100), (2, "ийкл" * 16 + "абвг" * 100)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert got == {1: "bb", 2: "aa"}


def test_bpe_counts_and_looks_up_words_of_all_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["once upon 5 € <|endoftext|> часы", "часы \x00 nul 😀 upon", "plain words upon"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    counts = {r.piece: r.n for r in bpe.count_pieces(docs, "text", path).collect()}
    assert counts["upon"] == 3 and counts["часы"] == 2 and counts["€"] == counts["plain"] == counts["once"] == 1
    library = bpe.Tokenizer.from_file(path)
    got = {r.doc_id: list(r.ids) for r in bpe.encode_documents(docs, path, with_ids=True).collect()}
    assert got == {k: library.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}


def test_bpe_fuzz_equals_the_library(tmp_path, monkeypatch):
    import random

    import numpy as np

    path = public_tokenizers.path("word_bpe_49k.json")
    library, model, rng = bpe.Tokenizer.from_file(path), bpe.load_model(path), random.Random(5)
    alphabets = ["abcdefghijklmnop  ", "ABCxyz's't're've'm'll'd '\"!?.,-_ ", "0123456789²½ ab", "éÈñÑßÿĀāŽƒǅȺȾɏ İıſ\xa0\xad ab", "“”‐–— ‧ a'b", "\n\t\r ab", "€часы日本😀 ab'", "\x00\x1c\x85　 a1!'s"]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([0, 1, 3, 10, 40, 200]))) + rng.choice(["", "", "<|endoftext|>", " <|startoftext|> x", "<|nope|>", "z" * 70, "'''s"]) for _ in range(3000)]
    texts.append(("lorem ipsum it's " * 5 + "\n") * 3000)  # a very long text
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    flat = tmp_path / "lexicon"
    flat.write_bytes(bpe.compile_lexicon({w: model.merge(w.encode()) for w in ("ab", "a", "'s", "часы", "lorem", "abc")}))
    for lexicon, size in ((None, 1 << 22), (bpe.Lexicon(str(flat)), 1 << 22), (bpe.Lexicon(str(flat)), 50)):
        monkeypatch.setattr(bpe, "CHUNK_CHARS", size)
        codec = bpe.Codec(model, lexicon)
        got = codec.encode_all(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert all(codec.decode(g) == library.decode(ids, skip_special_tokens=False) for g, ids in zip(got, want))


def test_bpe_keeps_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(None, "a b", "x", 5), (1, None, "y", 6), (1, "", "y", 6)], "doc_id long, text string, ids string, words int")
    got = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["ids", "words"]).collect()
    assert sorted((r.doc_id or 0, r.ids, r.words, r.n_tokens) for r in got) == [(0, "x", 5, 2), (1, "y", 6, 0), (1, "y", 6, 0)]


def test_hosts_far_out_in_the_prior_lose_their_documents(spark):
    good, bad = " ".join(f"w{k}" for k in range(40)), "too short"
    rows = [(f"h{h:02d}", bad if k % 100 < (45 if h == 7 else 8 + h % 5) else good) for h in range(20) for k in range(100)]
    docs = spark.createDataFrame([(k, t, h) for k, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    kept = {}
    for r in quality_rules.score_hosts(docs).collect():
        kept.setdefault(rows[r.doc_id][0], set()).add((r.base_failed, r.kept))
    assert kept.pop("h07") == {(True, False), (False, False)}  # under half of it fails, but far more than of the others
    assert all(v == {(True, False), (False, True)} for v in kept.values())
    even = spark.createDataFrame([(k, bad if k % 10 == 0 else good, f"h{k % 7}") for k in range(700)], "doc_id long, text string, source string")
    assert all(r.kept != r.base_failed for r in quality_rules.score_hosts(even).collect())


def test_templates_block_pages_without_a_rule(spark):
    rules = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "org", "/")]
    urls = [f"http://a{h}.net/ads/{k}" for h in range(3) for k in range(20)] + [f"http://a{h}.org/news/{k}.html" for h in range(3) for k in range(20)]
    open_ = [f"http://x.com/{s}/{k}" for s in ("ads", "news", "else") for k in range(10)]
    pages = spark.createDataFrame(list(enumerate(urls + open_)), "page_id long, url string")
    got = {r.url: r for r in pages.join(url_filter.judge(pages, rules), "page_id").collect()}
    assert {got[u].verdict for u in open_ if "/ads/" in u} == {"block"} and all(got[u].rule is None for u in open_)
    assert {got[u].verdict for u in open_ if "/ads/" not in u} == {"allow"}
    assert got["http://x.com/ads/3"].template == "x.com/ads/*" and got["http://a1.org/news/3.html"].verdict == "allow"
    assert url_filter.judge(empty(pages), rules).count() == 0


def test_unlabelled_pages_weigh_against_a_few_bad_ones(spark):
    rules = [url_filter.Rule("block", "x.com", "/p/bad"), url_filter.Rule("allow", "org", "/")]
    urls = [f"http://x.com/p/bad{k}" for k in range(14)] + [f"http://x.com/q/{k}" for k in range(3000)] + [f"http://o.org/z/{k}" for k in range(60)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r.url: r.verdict for r in pages.join(url_filter.judge(pages, rules), "page_id").collect()}
    assert {got[u] for u in urls if "/q/" in u} == {"allow"}


def test_url_parts_and_rules_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    urls = ["".join(rng.choice(["http", "://", "NET", ".", "example", "Example.net", "/", "en/", "/de/", "?q", "#f", "com", "org", "/fr/", "A"]) for _ in range(rng.randrange(1, 9))) for _ in range(600)] + [None, ""]
    rules = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.judge(pages, rules).collect():
        found = re.search(r"://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (found[1].lower(), found[2]) if found else ("", "")
        fits = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best.name)
        assert best is None or r.verdict == best.verdict


def test_short_items_are_found_beyond_the_broadcast_limit(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, " ".join(WORDS[50:75])), (2, "two"), (3, "ONE two"), (4, "b a b"), (5, "wort  tude")], "item_id long, text string")
    want = sorted((r.doc_id, r.n_hit, tuple(r.item_ids)) for r in decontaminate.find_overlaps(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_FINGERPRINTS", 0)
    got = sorted((r.doc_id, r.n_hit, tuple(r.item_ids)) for r in decontaminate.find_overlaps(docs, items).collect())
    assert got == want and dict((k, (n, i)) for k, n, i in got)[7] == (2, ("2", "3"))


def test_long_dialogues_are_whole_or_in_blocks_by_place(spark):
    turns = spark.createDataFrame([(1, None if k < 3 else 7, ("ann", "bob")[k % 2], f"t{k:03d}") for k in range(150)], "conv_id long, turn long, role string, text string")
    whole = {r.perspective: r for r in chat_format.rotate(turns).collect()}
    assert {p: (r.block, r.n_turns) for p, r in whole.items()} == {"ann": (0, 150), "bob": (0, 150)}
    blocks = sorted((r.perspective, r.block, r.n_turns, r.rendered) for r in chat_format.rotate(turns, block_turns=64).collect())
    assert [(p, b, n) for p, b, n, _ in blocks] == [(p, b, n) for p in ("ann", "bob") for b, n in ((0, 64), (1, 64), (2, 22))]
    assert "".join(x for p, _, _, x in blocks if p == "ann") == whole["ann"].rendered
    assert chat_format.rotate(empty(turns)).count() == chat_format.rotate(empty(turns), block_turns=2).count() == 0
    assert license_scan.scan_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_toxicity_is_found_in_held_out_texts(spark):
    import random

    rng = random.Random(9)
    plain, foul = [f"word{k}" for k in range(200)], ["scum", "idiot", "vermin", "filth"]
    data = [(k, " ".join(rng.choices(plain, k=40) + (rng.choices(foul, k=6) if k % 7 == 0 else [])), 5) for k in range(1400)]
    docs = spark.createDataFrame(data + [(5000, "", 1), (5001, None, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, int(k % 7 == 0)) for k in range(1000) if k % 2], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs.where("doc_id < 1000"), labels), keep=["doc_id"]).collect()}
    held = range(1000, 1400)
    assert sum(got[k].predicted for k in held if k % 7 == 0) >= 0.9 * sum(k % 7 == 0 for k in held)
    assert sum(got[k].predicted for k in held if k % 7) <= 0.02 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 1402


def test_language_of_held_out_texts(spark):
    import random

    rng = random.Random(2)
    roots = {"aa": ["tala", "bero", "mino", "sudi", "kapo"], "bb": ["grax", "thwe", "zork", "plym", "vrox"]}
    text = lambda lang: " ".join(rng.choice(roots[lang]) + rng.choice(roots[lang]) for _ in range(12))
    docs = spark.createDataFrame([(k, text(lang), lang, 1) for k in range(300) for lang in roots], "doc_id long, text string, lang string, score int")
    fresh = [(k, rng.choice(roots[lang])[::1] + "x" + rng.choice(roots[lang]) + " " + text(lang), lang) for k, lang in enumerate(["aa", "bb"] * 50)]
    model = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), model, keep=["doc_id"]).collect()}
    assert sum(got[k].lang_pred == lang for k, _, lang in fresh) >= 99
    assert all(0 <= r.score <= 1 for r in got.values())


def test_shards_hold_every_row_once(spark):
    import zlib

    data = [(k % 500 if k else None, "x" * (k * 37 % 900) + "é" * (k % 3) if k % 50 else None, f"s{k % 5}") for k in range(2000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = sharding.shard(docs, n_shards=8).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _ in data)
    shards = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(slots == [*range(len(slots))] for slots in shards.values())
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) < 1.05 * min(sizes)


def cue_lines(rng, n):
    return [f"this line has the word license number {k} {rng.choice('abc')}" for k in range(n)]


@pytest.mark.parametrize("n", [50, 300, 500, 700, 900, 3000])
def test_notices_among_many_mentions_are_found(n):
    import random

    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for seed in range(4):
        lines = cue_lines(random.Random(seed), n)
        lines.insert(seed * n // 3, "Released under the MIT License.")
        sure = [x for x in scanner.scan("\n".join(lines)) if x[5]]
        assert [(x[0], x[1], x[4]) for x in sure] == [(seed * n // 3, "MIT", 0)]


def test_each_template_line_is_found_at_every_offset():
    """Every line that mentions licensing, slid over the words of a text; its line number and wording are exact."""
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    filler = [f"v{k * 7919 % 4999}" for k in range(330)]
    for name, text in license_scan.TEMPLATES.items():
        for line in text.split("\n"):
            if not re.search(license_scan.CUES, line):
                continue
            for offset in range(0, 330, 41):
                around = " ".join(filler[:offset]) + "\n" * (offset % 3) + "\n" + line + " " + " ".join(filler[offset:])
                sure = [x for x in scanner.scan(around) if x[5]]
                assert any(x[1] == name and x[4] == 0 and x[0] <= offset % 3 + 1 for x in sure), (name, line, offset)


def test_templates_are_ranked_by_how_much_they_shrink():
    """A text within the changes allowed of two templates is named by the one that it has more of."""
    words = [f"part{k}" for k in range(20)]
    one, two = " ".join(["license", *words]), " ".join(["license", *words[:17], "x1", "x2", "x3"])
    scanner = license_scan.Scanner({"A": one, "B": two})
    for text, name in ((" ".join(["license", *words[:19], "y"]), "A"), (" ".join(["license", *words[:17], "x1", "x2", "y"]), "B")):
        alone, sizes = scanner.sizes(text)
        assert min(sizes, key=sizes.get) == name and sizes["A"] != sizes["B"] and max(sizes.values()) < alone
        assert [(x[1], x[4], x[5]) for x in scanner.scan(text)] == [(name, 1, True)]
    even = license_scan.Scanner({"A": one, "B": two})
    even.sizes = lambda block: (100, {"A": 50, "B": 50})
    assert [x[1] for x in even.scan(" ".join(["license", *words[:17], "x1", "x2", "y"]))] == ["A"]  # without the ranking the other one wins


def test_scanning_takes_time_in_proportion():
    import random
    import time

    took = []
    for n in (2_000, 10_000):
        text = "\n".join(cue_lines(random.Random(1), n))
        began = time.process_time()
        found = license_scan.Scanner(license_scan.TEMPLATES).scan(text)
        took.append(time.process_time() - began)
        assert len(found) == n and not any(x[5] for x in found)
    assert took[1] < 12 * took[0] + 1


def test_license_scan_keeps_repeats_and_other_columns_apart(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", "x", True)] * 2 + [(2, None, "y", False), (3, "", "y", False)], "doc_id long, text string, license string, confirmed boolean")
    got = [(r.doc_id, r.license, r.confirmed) for r in license_scan.scan_documents(docs).collect()]
    assert got == [(1, "MIT", True)] * 2


def overlaps_by_force(docs, items):
    """Hit words and items of each text."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1) if w else ():
            windows[tuple(w[i : i + n])].add(str(k))
    out = {}
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= {*range(i, i + n)}
                    found |= own
        out[k] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination_equals_brute_force(spark, monkeypatch, limit):
    """Shared runs of all lengths around a window, one run that many items and texts share, equal and short items, hits at both ends."""
    import random

    monkeypatch.setattr(decontaminate, "BROADCAST_FINGERPRINTS", limit)
    rng = random.Random(6)
    fresh = iter(f"q{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(17_000))
    take = lambda n: [next(fresh) for _ in range(n)]
    common, passage = take(9), take(30)
    items = [(k, " ".join(take(5) + common + take(5))) for k in range(25)] + [(100, " ".join(passage)), (101, " ".join(passage)), (102, " ".join(take(4) + passage[3:20])), (103, "uno duo"), (104, "Uno, DUO!"), (105, None), (106, "..."), (107, " ".join(passage[:10]))]
    docs = [(k, " ".join(take(6) + common + take(6))) for k in range(25)]
    docs += [(100 + n, " ".join(take(3) + passage[:n] + take(3))) for n in range(7, 15)] + [(200, " ".join(passage[-10:])), (201, " ".join(passage[5:15] + take(1) + passage[16:27])), (202, "x uno duo"), (203, None), (204, ""), (205, " ".join(passage * 3)), (206, items[3][1].upper())]
    want = overlaps_by_force(docs, items)
    got = decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in got} == want
    assert {k for k, (_, n, _) in want.items() if n} == {*range(110 - 0, 115), 200, 201, 202, 205, 206}
    assert all(r.contaminated == (r.n_hit > 0) for r in got) and rng


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    path = public_tokenizers.path("word_bpe_49k.json")
    library, model = bpe.Tokenizer.from_file(path), bpe.load_model(path)
    texts = ["one two three four one", "alpha beta one\ngamma it's", "z" * 90 + " " + "y" * 90]
    monkeypatch.setattr(bpe, "word_names", lambda chars, starts, ends: (np.arange(len(starts)) % 3).astype(np.uint64))
    got = bpe.Codec(model, None).encode_all(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_leaves_out_kept_columns_named_like_results(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "s")], "doc_id long, text string, n_tokens string, source string")
    r = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["n_tokens", "source", "doc_id"]).first()
    assert (r.doc_id, r.n_tokens, r.source) == (1, 2, "s")


@pytest.mark.parametrize("deep", [3, 12])
def test_branches_may_part_at_any_depth(spark, deep):
    rules = [url_filter.Rule("block", "x.net", "/" + "s/" * deep + "bad/old"), url_filter.Rule("allow", "x.net", "/" + "s/" * deep + "good/old")]
    path = lambda kind, age, k: f"http://x.net/{'s/' * deep}{kind}/{age}/{k}"
    urls = [path(kind, age, k) for kind in ("bad", "good") for age in ("old", "new") for k in range(40)] + ["http://x.net/" + "q/" * 300]
    pages = spark.createDataFrame([(k, u, "t") for k, u in enumerate(urls * 2)], "page_id long, url string, template string")
    got = defaultdict(set)
    for r in pages.drop("template").join(url_filter.judge(pages, rules), "page_id").collect():
        got[r.url].add((r.verdict, r.template.count("*")))
    assert all({v for v, _ in got[path(kind, "new", k)]} == {verdict} for kind, verdict in (("bad", "block"), ("good", "allow")) for k in range(40))
    assert [n for _, n in got[urls[-1]]] == [300]


def test_dialogue_rows_that_repeat_and_other_columns(spark):
    turns = spark.createDataFrame([(None, 1, "ann", "hé", "x")] * 3 + [(None, 2, "bob", None, "y"), (2, 1, "system", "s", "z")], "conv_id long, turn int, role string, text string, rendered string")
    got = {(r.conv_id, r.perspective): r for r in chat_format.rotate(turns).collect()}
    assert set(got) == {(None, "ann"), (None, "bob")} and {r.n_turns for r in got.values()} == {4}
    for (_, who), r in got.items():
        own = [r.rendered[a : a + n] for a, n in (map(int, s.split(":")) for s in r.mask.split(","))]
        assert own == {"ann": ["hé" + chat_format.END] * 3, "bob": [chat_format.END]}[who]


@pytest.mark.parametrize("shards", [7, 40])
def test_shards_by_target_bytes_are_a_tree_of_near_equal_leaves(spark, shards):
    rng = __import__("random").Random(shards)
    data = [(k, ("é" if k % 5 == 0 else "x") * rng.randrange(1, 900) + "\n" * (k % 7)) for k in range(4000)] + [(5000 + k, "the same text " * 20) for k in range(900)]
    docs = spark.createDataFrame([(k, t, 9, "c") for k, t in data], "doc_id long, text string, node int, shard string")
    total = sum(len(t.encode()) + 16 for _, t in data)
    got = sharding.shard(docs, target_bytes=-(-total // shards)).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r.size
    assert sorted(r.doc_id for r in got) == sorted(k for k, _ in data) and sorted(sizes) == [*range(shards)]
    assert max(sizes.values()) < 1.1 * total / shards
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == [*range(sum(r.shard == s for r in got))]
    assert sharding.shard(docs.where("false"), target_bytes=1000).count() == 0
