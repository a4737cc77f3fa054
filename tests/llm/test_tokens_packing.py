"""Token counts against the library, and packing as an exact round trip."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import packing, tokens

ODD = ["a", "B", "é", "'s", " ", "  ", "\n", "\t", ".", "!", "1", "²", "\u3000", "<|endoftext|>", "<|startoftext|>", "x.", "\x1c", "日", "\u0301", " \n", "İ", "Σ", "ς", "word", "Word,", "\u00a0", "。", "，本", "語ガ", "\u3099", "한글", "！", "か"]


def _load(name):
    path = tokens.tokenizer_path(name)
    return path, tokens.load(path)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=14).map("".join) | st.text(max_size=20))
def test_counts_equal_the_library(text):
    path, tok = _load("word_bpe_49k.json")
    assert tokens.count_lengths([text], path, tokens.PieceCache()) == [len(tok.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=14).map("".join) | st.text(max_size=20) | st.text(st.characters(max_codepoint=255), max_size=20))
def test_ids_equal_the_library(text):
    path, tok = _load("byte_bpe_50k.json")
    assert np.frombuffer(packing.encoder(path)([text])[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_ids_of_long_texts(monkeypatch):
    path, tok = _load("byte_bpe_50k.json")
    texts = ["word's 12  é\n\tend. " * 20_000, "x" * 300_000, "short <|endoftext|> " * 30]
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert packing.encoder(path)(texts) == want
    monkeypatch.setattr(packing, "LONG", 3)
    assert packing.encoder(path)([t[:500] for t in texts]) == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch([t[:500] for t in texts], add_special_tokens=False)]


def test_ids_of_whole_documents(sf):
    import pyarrow.parquet as pq

    path, tok = _load("byte_bpe_50k.json")
    assert packing.encoder(path).ranked is not None and packing.encoder(tokens.tokenizer_path("word_bpe_49k.json")).ranked is None
    texts = pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()
    assert packing.encoder(path)(texts) == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_cache_generations():
    path, tok = _load("word_bpe_49k.json")
    r, cache = random.Random(1), tokens.PieceCache(limit=50 * tokens.ENTRY)
    texts = [" ".join("".join(r.choices("abcde.", k=r.randint(1, 3))) for _ in range(30)) for _ in range(60)]
    got = [n for t in texts for n in tokens.count_lengths([t], path, cache)]
    assert got == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_the_cache_is_bounded_in_bytes():
    """Texts without blanks are split at wide marks, and long pieces are never kept."""
    path, tok = _load("word_bpe_49k.json")
    r, cache = random.Random(3), tokens.PieceCache(limit=40_000)
    wide = "日本語を話す人々が街を歩く中国文字한글이다ガギ"
    for _ in range(60):
        text = "".join("".join(r.choices(wide, k=r.randint(1, 30))) + r.choice("。，、！？x") for _ in range(40)) + "q" * r.randint(0, 300)
        assert max(map(len, tokens.safe_pieces(text))) < len(text)
        assert tokens.count_lengths([text], path, cache) == [len(tok.encode(text, add_special_tokens=False).ids)]
        assert all(len(p) <= tokens.LONGEST for p in cache.known)
        assert sum(tokens.ENTRY + 2 * len(p) for p in cache.known) <= 2 * 40_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*ODD, " ", " "]), max_size=60).map("".join), st.integers(1, 30))
def test_segments_count_as_the_whole(text, limit):
    path, tok = _load("word_bpe_49k.json")
    parts = list(tokens.segments(text, limit))
    assert " ".join(parts) == text
    assert sum(tokens.count_lengths(parts, path, tokens.PieceCache())) == len(tok.encode(text, add_special_tokens=False).ids)


def test_token_counts_edges(spark):
    _, tok = _load("word_bpe_49k.json")
    rows = [(1, "Hello, world", 5, "x"), (1, "Hello, world", 5, "x"), (2, None, None, None), (3, "", 0, ""), (None, "été", 1, "y"), (4, "long text " * 100_000, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, id string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(docs, batch_bytes=10).collect())
    want = sorted((i or 0, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in rows)
    assert got == want
    assert tokens.token_counts(docs.limit(0)).count() == 0


def check_packed(rows, texts, length):
    """Every id of every document once, sequences gapless and full or a power of two."""
    _, tok = _load("byte_bpe_50k.json")
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == texts.keys()
    for i, own in pieces.items():
        ids = [*tok.encode(texts[i] or "", add_special_tokens=False).ids, packing.END]
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for spans in seqs.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= length
        padding += 0 if end & (end - 1) == 0 else length - end
    assert padding == 0


def test_packing_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    check_packed(packing.pack(docs, shard_tokens=40_000, piece_tokens=3000).collect(), texts, 2048)


def test_packing_edges(spark):
    rows = [(1, "a", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (4, "word <|endoftext|> word  two " * 900, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")
    check_packed(packing.pack(docs).collect(), {i: t for i, t, _, _ in rows}, 2048)
    assert packing.pack(docs.limit(0)).count() == 0
    twice = packing.pack(docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "x", "", 0)], docs.schema))).collect()
    assert sum(r["length"] for r in twice if r["start"] == 0 and r["doc_id"] == 1) == 4


def test_near_copies_share_a_shard(spark):
    """Copies with a few words changed lie in one shard of many; copies beyond a shard's size are split."""
    r = np.random.default_rng(6)
    make = lambda n: [f"{a}{b}" for a, b in zip(r.choice(["red", "blue", "lamp", "stone", "river", "cloud"], n), r.integers(0, 3000, n))]
    texts = {}
    for g in range(60):
        base = make(120)
        for c in range(3):
            own = list(base)
            own[int(r.integers(120))] = make(1)[0]
            texts[g * 3 + c] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pack(docs, shard_tokens=8000).collect()
    check_packed(rows, texts, 2048)
    shard = {x["doc_id"]: x["sequence_id"] >> 32 for x in rows}
    assert len(set(shard.values())) > 5
    assert sum(len({shard[g * 3 + c] for c in range(3)}) == 1 for g in range(60)) > 40
    hot = spark.createDataFrame([(i, texts[0]) for i in range(300)], "doc_id long, text string")
    rows = packing.pack(hot, shard_tokens=8000).collect()
    size = Counter()
    for x in rows:
        size[x["sequence_id"] >> 32] += x["length"]
    assert len(size) > 5 and max(size.values()) < 3 * 8000


@pytest.mark.parametrize("common", [1, 4, 1000])
def test_bm25_by_brute_force(monkeypatch, common):
    """All pieces that share a term, by all terms, best first, however common terms are scored."""
    monkeypatch.setattr(packing, "COMMON", common)
    r = np.random.default_rng(2)
    docs = [r.zipf(1.3, r.integers(5, 90)) % 300 for _ in range(60)] + [np.array([299, 298])] * 2 + [np.array([400])]
    n, df = len(docs), np.zeros(401)
    for d in docs:
        df[np.unique(d)] += 1
    idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32), float(np.mean([len(d) for d in docs]))
    index = packing.Index(docs, idf, mean)
    for i in range(n):
        terms = np.unique(docs[i])
        want = np.array([0 if j == i else sum(idf[t] * (k := int((docs[j] == t).sum())) * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(docs[j]) / mean)) for t in terms) for j in range(n)])
        assert index.scores(i) == pytest.approx(want, rel=1e-4)
        got = index.neighbours(i)
        assert sorted(got) == np.flatnonzero(want).tolist()
        assert all(want[a] >= want[b] - 1e-3 for a, b in zip(got, got[1:]))


def brute_pack(sizes, neighbours, length):
    """Greedy filling as stated: a window takes its seed, then the seed's unused neighbours, best
    first; without one the next unused piece is a new seed.  What a window cuts seeds the next,
    or else the best neighbour that the last seed has left."""
    rest, unused, out, left = sum(sizes), list(range(len(sizes))), [], None
    seq, ranked = 0, None
    while rest:
        room = length if rest >= length else 1 << (rest.bit_length() - 1)
        rest -= room
        offset = 0
        while room:
            if left is None:
                i = next((j for j in ranked or [] if j in unused), None)
                if i is None:
                    i, ranked = unused[0], None
                unused.remove(i)
                left = (i, 0)
            i, begin = left
            if ranked is None or not offset:
                ranked = list(neighbours(i))
            take = min(room, sizes[i] - begin)
            out.append((i, begin, take, seq, offset))
            offset, room = offset + take, room - take
            left = (i, begin + take) if begin + take < sizes[i] else None
        seq += 1
    return out


def test_greedy_filling_by_brute_force():
    r = random.Random(7)
    for _ in range(60):
        sizes = [r.randint(1, 40) for _ in range(r.randint(1, 30))]
        near = {i: [j for j in r.sample(range(len(sizes)), len(sizes)) if j != i][: r.randint(0, 9)] for i in range(len(sizes))}
        got = packing.pack_shard(np.array(sizes), lambda i: np.array(near[i], int), 32)
        assert got == brute_pack(sizes, near.__getitem__, 32)


def test_ids_that_are_texts(spark):
    docs = spark.createDataFrame([("b", "one text"), ("a", "another text"), (None, None)], "doc_id string, text string")
    rows = packing.pack(docs).collect()
    assert {r["doc_id"] for r in rows} == {"a", "b", None} and sum(r["length"] for r in rows if r["doc_id"] is None) == 1


@pytest.mark.parametrize("total", [1, 2047, 2048, 5000])
def test_pack_shard_powers(total):
    out = packing.pack_shard(np.array([total]), lambda i: np.zeros(0, int))
    assert sum(x[2] for x in out) == total
    assert all(n == 2048 or n & (n - 1) == 0 for n in (sum(x[2] for x in out if x[3] == s) for s in {x[3] for x in out}))
