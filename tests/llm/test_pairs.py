"""Similarity join, components and decontamination by brute force; the pipeline's stages."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from loomgraph.llm import decontam, ngram_join, packing
from loomgraph.llm.common import materialise
from loomgraph.llm.components import components

VOCAB = ["w%d" % i for i in range(300)]


def brute_classes(texts, threshold=0.8):
    """{id: (class, links)} by all pairs of sets."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\W_]+", (t or "").lower())
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else ({t} if t else set())
    parent, links = {i: i for i in texts}, dict.fromkeys(texts, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and len(x & y) >= threshold * len(x | y):
                links[ids[a]] += 1
                links[ids[b]] += 1
                p, q = sorted((root(ids[a]), root(ids[b])))
                parent[q] = p
    return {i: (root(i), links[i]) for i in ids}


def corpus(seed=3):
    r = random.Random(seed)
    texts = {}
    for i in range(60):
        texts[i] = " ".join(r.choices(VOCAB, k=r.randint(1, 150)))
    base = " ".join(r.choices(VOCAB, k=140)).split()
    for i in range(100, 150):  # a large group of near copies, in a chain
        if r.random() < 0.5:
            base = base[:]
            base[r.randrange(len(base))] = r.choice(VOCAB)
        own = base[:]
        if r.random() < 0.7:
            own[r.randrange(len(own))] = r.choice(VOCAB)
        texts[i] = " ".join(own)
    for i in range(200, 210):
        texts[i] = texts[5].upper() + "!" * (i % 3)
    texts[300], texts[301], texts[302], texts[303], texts[304] = None, "", "...", "...", "one"
    return texts


@pytest.mark.parametrize("block", [1500, 7])
def test_similarity_classes(spark, block):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in texts.items()], "doc_id long, text string, key string, rep int").repartition(4)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.similarity_classes(docs, block_texts=block).collect()}
    assert got == brute_classes(texts)


def test_similarity_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in ngram_join.similarity_classes(docs).collect()))
    assert got == [(0, 0, 0), (0, 1, 3), (1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 3, 0)]
    assert ngram_join.similarity_classes(docs.limit(0)).count() == 0


LONG = " ".join(f"word{i}" for i in range(60))


def test_links_of_repeated_and_null_ids(spark):
    """Every text of an id takes part, and so do texts without an id."""
    rows = [(1, "quite another text that is here"), (1, LONG), (2, LONG + " more"), (None, "less " + LONG), (None, "nothing like it in the table at all"), (None, "nothing like it in the table at all")]
    for order in (rows, rows[::-1]):
        got = ngram_join.similarity_rows(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted(((r["doc_id"] or 0), r["class_id"] or 0, r["n_links"], r["head"]) for r in got) == [(0, 0, 1, True), (0, 0, 1, True), (0, 1, 2, False), (1, 1, 0, True), (1, 1, 2, True), (2, 1, 2, False)]


def test_copies_of_most_rows(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 3)
    docs = spark.createDataFrame([(i, LONG) for i in range(50, 90)] + [(i, f"text {i} of the many others here") for i in range(20)] + [(99, LONG + " more"), (None, LONG), (7, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.similarity_classes(docs.where("doc_id <> 7 OR text IS NOT NULL OR doc_id IS NULL")).collect()}
    assert all(got[i] == (50, 41) for i in [*range(50, 90), 99, None]) and all(got[i] == (i, 0) for i in range(20))


def test_ids_that_are_texts(spark):
    docs = spark.createDataFrame([("x9", LONG), ("b", LONG + " more"), (None, "alone and not alike")], "doc_id string, text string")
    got = sorted((r["doc_id"] or "", r["class_id"] or "", r["n_links"]) for r in ngram_join.similarity_classes(docs).collect())
    assert got == [("", "", 0), ("b", "b", 1), ("x9", "b", 1)]


def test_very_long_texts(spark):
    r = random.Random(2)
    a = " ".join(r.choices(VOCAB, k=200_000))
    docs = spark.createDataFrame([(1, a), (2, a + " tail"), (3, " ".join(r.choices(VOCAB, k=200_000)))], "doc_id long, text string")
    assert sorted((x["doc_id"], x["class_id"]) for x in ngram_join.similarity_classes(docs).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_bands_reach_the_recall():
    for t in (0.5, 0.8, 0.9):
        b, r = ngram_join.bands_for(t, 0.99)
        assert 1 - (1 - t**r) ** b >= 0.99 and b * r <= ngram_join.HASHES
    with pytest.raises(ValueError):
        ngram_join.bands_for(0.01, 0.99)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_large_star(spark, monkeypatch):
    from loomgraph.operators import components as module

    monkeypatch.setattr(module, "HOT", 10)
    edges = [(i, 1000) for i in range(500)] + [(2000, i) for i in range(0, 500, 3)] + [(3000 + i, 3001 + i) for i in range(70)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(500), 1000, 2000]}, **{i: 3000 for i in range(3000, 3071)}}


def brute_sw(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_smith_waterman():
    r = np.random.default_rng(5)
    for _ in range(200):
        a, b = r.integers(0, 5, r.integers(0, 12)), r.integers(0, 5, r.integers(0, 20))
        score, s, e = decontam.smith_waterman(a, b)
        assert score == brute_sw(a, b)
        if score:
            assert brute_sw(a, b[s:e]) == score


def leak_corpus():
    r = random.Random(8)
    make = lambda n: " ".join(r.choices(VOCAB, k=n))
    items = {k: make(r.randint(15, 50)) for k in range(12)} | {50: "tiny item", 51: None, 52: ""}
    docs, leaks = {}, set()
    for i in range(80):
        docs[i] = make(r.randint(1, 200))
    for n, k in enumerate(list(range(12)) * 3):
        w = items[k].split()
        for _ in range(len(w) // 9 if n >= 12 else 0):  # edited copies
            j = r.randrange(len(w))
            w[j : j + 1] = r.choice([[], [r.choice(VOCAB)], [w[j], r.choice(VOCAB)]])
        docs[100 + n] = make(r.randint(0, 90)) + " " + " ".join(w).title() + ".\n" + make(r.randint(0, 90))
        leaks.add((100 + n, k))
    docs[200], docs[201], docs[202] = None, "", "This is a Tiny Item, word."
    leaks.add((202, 50))
    return items, docs, leaks


def test_find_leaks(spark):
    items, docs, leaks = leak_corpus()
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs.items()] + [(None, items[0], 0.0)], "doc_id long, text string, score double")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = decontam.find_leaks(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == leaks | {(None, 0)}
    # scores by brute force over whole documents
    for r in got[:15]:
        x = re.findall(r"[^\W_]+", items[r["item_id"]].lower())
        y = re.findall(r"[^\W_]+", (docs[r["doc_id"]] if r["doc_id"] is not None else items[0]).lower())
        assert r["score"] == pytest.approx(brute_sw(x, y) / (2 * len(x)))
    assert decontam.find_leaks(d.limit(0), b).count() == 0 and decontam.find_leaks(d, b.limit(0)).count() == 0
    clean = decontam.without_leaks(d, b)
    assert clean.schema == d.schema and {r["doc_id"] for r in clean.collect()} == docs.keys() - {i for i, _ in leaks}
    assert decontam.without_leaks(d, b.limit(0)).count() == d.count()


def test_a_benchmark_in_parts(spark):
    items, docs, leaks = leak_corpus()
    d, b = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    whole, parts = ({tuple(r) for r in decontam.find_leaks(d, b, part=p).collect()} for p in (1 << 20, 1000))
    assert len(list(decontam._parts(b, "item_id", "text", 3, 1000))) > 1 and parts == whole
    assert {r["doc_id"] for r in decontam.without_leaks(d, b, part=1000).collect()} == docs.keys() - {i for i, _ in leaks}


def test_leaks_with_odd_rows(spark):
    """Null and text ids, repeated rows, ids of several texts, ties and very long texts."""
    item = " ".join(VOCAB[:25])
    far = " ".join(VOCAB[100:] * 500)
    rows = [(None, item), ("x", item), ("x", item), ("x", "clean " + far), ("y", f"{far} {item} {far} {item}")]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    b = spark.createDataFrame([(None, item), ("i", item), ("i", item + " and some more"), ("j", None)], "item_id string, text string")
    got = sorted((r["doc_id"] or "", r["item_id"] or "", r["score"], r["start_word"]) for r in decontam.find_leaks(d, b).collect())
    at = len(far.split())
    assert got == [("", "", 1.0, 0), ("", "i", 1.0, 0), *[("x", "", 1.0, 0)] * 2, *[("x", "i", 1.0, 0)] * 2, ("y", "", 1.0, at), ("y", "i", 1.0, at)]
    assert [r["doc_id"] for r in decontam.without_leaks(d, b).collect()] == ["x"]


def test_an_item_that_opens_and_closes_alike():
    """Only the closing phrase of a copy has a whole seed: its place in the item is the later one."""
    item = "a b c " + " ".join(f"m{i}" for i in range(14)) + " a b c"
    copy = " ".join(f"m{i}" if i % 3 else f"x{i}" for i in range(14)) + " a b c"
    bench = decontam.Benchmark.of([(1, item)], 3)
    got = decontam.leaks_of(bench, "q " * 40 + copy, 0.3)
    want = brute_sw(item.split(), ("q " * 40 + copy).split()) / (2 * len(item.split()))
    assert got[1][0] == pytest.approx(want)


def test_leak_that_is_everywhere(spark):
    item = " ".join(VOCAB[:30])
    d = spark.createDataFrame([(i, f"{VOCAB[40 + i % 50]} {item} {VOCAB[90 + i % 50]}") for i in range(300)], "doc_id long, text string")
    assert decontam.find_leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 300


@pytest.mark.parametrize("copies", [9, 100, 3000])
def test_edited_and_truncated_copies_that_repeat(spark, copies):
    """Forms that break over a quarter of an item's n-grams and stand in many documents."""
    w, v = VOCAB[:30], VOCAB[100:130]
    edited = [f"x{i}" if i in (7, 15, 23) else x for i, x in enumerate(w)]
    forms = [(1, " ".join(edited)), (2, " ".join(v[:21]))]
    rows = [(k * 10_000 + i, f"{VOCAB[200 + i % 50]} {t} {VOCAB[250 + i % 50]}") for k, t in forms for i in range(copies)]
    items = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(v))], "item_id long, text string")
    got = decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted((i, i // 10_000) for i, _ in rows)
    assert {(r["item_id"], round(r["score"], 6)) for r in got} == {(1, 0.85), (2, 0.7)}


def test_windows_take_in_every_alignment_of_a_seed():
    """Against brute force over whole texts, with long gaps before and after the seed."""
    r = random.Random(4)
    for _ in range(150):
        item = [r.randrange(12) for _ in range(r.randint(3, 14))]
        text = [r.randrange(40) for _ in range(r.randint(0, 20))]
        for x in item:
            text += [x] if r.random() < 0.9 else []
            text += [99] * (r.randint(1, len(item)) if r.random() < 0.12 else 0)
        text += [r.randrange(40) for _ in range(r.randint(0, 20))]
        bench = decontam.Benchmark.of([(1, " ".join(f"t{x}" for x in item))], 3)
        numbers = bench.numbers(" ".join(f"t{x}" for x in text))
        at, which = bench.seeds(numbers, bench.lengths)
        got = max((decontam.best_alignment(bench.items[k], numbers, a, p, 0.5)[0] for k, a, p in decontam.possible(bench, numbers, at, which, 0.5)), default=0)
        want = brute_sw(item, text) / (2 * len(item))
        if len(at) and want >= 0.5:
            assert got == pytest.approx(want)


def test_pipeline(spark, sf, tmp_path):
    """Every stage on small documents against brute force."""
    items, leaky, leaks = leak_corpus()
    secret = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    texts = corpus() | {i + 1000: t for i, t in leaky.items()} | {2000: f'w1 w2 token = "{secret}" w3', 2001: "1234 !!"}
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    cls = brute_classes(kept)
    kept = {i: t for i, t in kept.items() if cls[i][0] == i}
    bad = {i for i, t in kept.items() for k, x in items.items() if x and brute_sw(re.findall(r"\w+", x.lower()), re.findall(r"\w+", t.lower())) >= 0.5 * 2 * len(x.split())}
    kept = {i: t.replace(secret, "[SECRET]") for i, t in kept.items() if i not in bad}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    from test_tokens_packing import check_packed

    check_packed(got, kept, packing.LENGTH)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.names == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_near_duplicates_with_repeated_ids(spark, sf):
    """Both clean texts of an id stay, of repeated rows one, of a text without an id one."""
    a, b = "a b c d e f g", "quite another text than that"
    rows = [(1, a), (1, a), (2, a), (None, a), (3, b), (3, b), (3, "and a third one here too"), (4, None), (5, ""), (None, "only here without any id"), (None, LONG), (None, LONG), (7, LONG + " tail")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 8) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, digest int")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    got = sorted(((r["doc_id"] or 0), r["text"] or "") for r in kept.collect())
    assert kept.columns == docs.columns
    assert got == sorted([(1, a), (3, b), (3, "and a third one here too"), (4, ""), (5, ""), (0, "only here without any id"), (7, LONG + " tail")])


def test_a_leak_without_an_id_goes(spark, tmp_path):
    item = " ".join(VOCAB[:30])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(None, item), (None, "clean"), (1, "x " + item), (1, "clean too")], "doc_id long, text string")
    assert sorted(r["text"] for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()) == ["clean", "clean too"]


def test_the_pipeline_leaves_other_results_and_settings(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, held = dict(spark.conf.getAll), packing.pack(docs)
    assert corpus_pipeline.run(spark, sf).count()
    assert held.count() and dict(spark.conf.getAll) == before


def test_components_write_no_round_in_vain(spark, monkeypatch):
    """Stars are done as they come, and rounds over few edges write one file, however many partitions there are."""
    from loomgraph.operators import components as module

    written, cut, name = [], module.cut, "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(module, "cut", lambda df, label: written.append(cut(df, label)) or written[-1])
    spark.conf.set(name, "false")
    try:
        star = spark.createDataFrame([(1, i) for i in range(2, 40)] + [(50, 51)], "a long, b long")
        assert {r["node"]: r["component"] for r in components(star).collect()} == {i: 1 for i in range(1, 40)} | {50: 50, 51: 50}
        assert len(written) == 1
        chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
        assert {r["node"]: r["component"] for r in components(chain).collect()} == dict.fromkeys(range(41), 0)
        assert len(written) > 2 and all(len(t.inputFiles()) == 1 for t in written[2:])
    finally:
        spark.conf.unset(name)


def test_rows_are_told_apart_in_one_table(spark, sf, monkeypatch):
    """Of the rows, only those that go or repeat a head are written."""
    written = []
    monkeypatch.setattr(corpus_pipeline, "materialise", lambda df, label, into=None: written.append(label) or materialise(df, label, into))
    rows = [(1, LONG, "en"), (1, LONG, "de"), (2, LONG + " more", "en"), (2, "quite another text that is here", "en"), (None, None, "en"), (None, None, "en"), (3, "alone and not alike", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["lang"]) for r in got) == [(0, "", "en"), (0, "", "en"), (1, LONG, "de"), (2, "quite another text that is here", "en"), (3, "alone and not alike", "en")]
    assert len(written) == 1
