"""Fingerprints and licence scans against plain Python and SQL."""

import hashlib
import re

import duckdb
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import fingerprint as fp
from loomgraph.llm import license as lic

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def brute_hashes(text):
    words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    if len(h) >= 5:
        out = set()
        for i in range(len(h) - 4):
            seed = 42
            for x in h[i : i + 5]:
                seed = xxhash.xxh64_intdigest((x % (1 << 64)).to_bytes(8, "little"), seed)
            out.add(signed(seed))
        return out
    if h:
        return {signed(xxhash.xxh64_intdigest(" ".join(map(str, h)).encode(), 42))}
    return {signed(xxhash.xxh64_intdigest(text.encode(), 42))} if text else set()


LIMIT = -(1 << 63) + (1 << 64) // fp.SCALE


def brute_sketch(text):
    return sorted(x for x in brute_hashes(text) if x < LIMIT)


def brute_near(a, b):
    """Likeness of two texts by their sketches; without a hash, whether the shingles are the same."""
    x, y = set(brute_sketch(a)), set(brute_sketch(b))
    return len(x & y) / len(x | y) if x | y else float(brute_hashes(a) == brute_hashes(b))


@pytest.fixture(scope="module")
def texts():
    import random

    r = random.Random(4)
    out = {i: " ".join(r.choices(WORDS, k=r.randint(0, 400))) for i in range(1, 60)}
    out[60], out[61], out[62], out[63] = out[59], out[59] + " more words", "Ünïcode 𝒳 text", "!!! ---"
    out[64], out[65] = " ".join(r.choices(WORDS, k=9000)), "one"
    return out


@pytest.mark.parametrize("parts", [0, 1, 7, 500])
def test_fingerprints(spark, texts, parts):
    rows = [(i, t) for i, t in texts.items()] + [(66, None), (70, "")]
    got = {r["doc_id"]: r for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), parts=parts).collect()}
    assert len(got) == len(rows)
    ids, text = sorted((i for i, _ in rows), reverse=True), {i: t or "" for i, t in rows}
    for k, i in enumerate(ids):
        a, b = text[i], text[ids[(k + 1) % len(ids)]]
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        r = got[i]
        assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["sketch"]["hashes"] == brute_sketch(a) and r["edited_sketch"]["hashes"] == brute_sketch(edited)
        assert (r["sketch"]["whole"] is None) == (bool(brute_sketch(a)) or not brute_hashes(a))
        assert r["near_edited"] == pytest.approx(brute_near(a, edited))
        assert r["near_next"] == pytest.approx(brute_near(a, b))


def test_sketches_merge_and_contain(spark, texts):
    a, b = texts[64], texts[5] + " " + texts[64]
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    r = df.select(fp.containment(F.col("a"), F.col("b")).alias("ab"), fp.containment(F.col("b"), F.col("a")).alias("ba"), fp.merge(F.col("a"), F.col("b")).alias("m")).first()
    assert r["ab"] == 1.0 and 0.8 < r["ba"] < 1.0
    h = brute_hashes(a) | brute_hashes(b)
    assert r["m"]["hashes"] == sorted(x for x in h if x < LIMIT) and r["m"]["whole"] is None


def test_the_fraction_is_the_same_at_every_length(spark, texts):
    """No text keeps a hash above the limit, and none drops one below it."""
    rows = spark.createDataFrame([(t,) for t in texts.values()], "t string").select("t", fp.sketch(F.col("t"))["hashes"].alias("s")).collect()
    assert all(r["s"] == brute_sketch(r["t"]) for r in rows)
    assert any(0 < len(r["s"]) < 8 for r in rows) and any(not r["s"] for r in rows)


def test_ids_beyond_the_precision_of_doubles(spark):
    rows = [((1 << 62) + 3 * i, f"text {i}") for i in range(700)] + [(-(1 << 63), "least")]
    got = {r["text"]: r["next_text"] for r in fp.following(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", ["text"], 40).collect()}
    order = [t for _, t in sorted(rows, reverse=True)]
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_short_texts_without_a_hash(spark):
    bare = [t for t in (f"word{i} here" for i in range(40)) if not brute_sketch(t)][:2]
    df = spark.createDataFrame([(bare[0], bare[0].upper(), bare[1], "")], "a string, b string, c string, d string")
    s = {c: fp.sketch(F.col(c)) for c in "abcd"}
    r = df.select(*[fp.resemblance(s["a"], s[c]).alias(f"a{c}") for c in "bcd"], fp.resemblance(s["d"], s["d"]).alias("dd"), fp.text_form(s["a"]).alias("fa"), fp.text_form(s["c"]).alias("fc"), fp.containment(s["a"], s["c"]).alias("k")).first()
    assert (r["ab"], r["ac"], r["ad"], r["dd"], r["k"]) == (1.0, 0.0, 0.0, 1.0, 0.0) and r["fa"] != r["fc"]


def test_a_key_of_most_rows_is_cut(spark):
    """Null ids hold most rows: the following row is right and no range holds them all."""
    rows = [(None, f"text {i} of the many") for i in range(400)] + [(i, f"own {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = fp._ranked(docs, "doc_id", ["text"])
    bounds = fp._bounds(keyed, 20)
    assert len(bounds) > 15 and sum(k == fp._NONE for k, _ in bounds) > 12
    order = [t for t, in keyed.orderBy(F.desc("_rank"), F.desc("_hash")).select("text").collect()]
    got = {r["text"]: r["next_text"] for r in fp.following(docs, "doc_id", ["text"], 20).collect()}
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_fingerprint_edges(spark):
    schema = "doc_id long, text string, s string, next_text string, _key int"
    assert fp.fingerprints(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f", "x", "y", 1), (1, "a b c d e f", "x", "y", 1), (1, "other", "x", "y", 1), (None, None, None, None, None)]
    got = fp.fingerprints(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 5, 11, 11]
    one = fp.fingerprints(spark.createDataFrame([(9, "only one document here today", "", "", 0)], schema)).first()
    assert one["near_next"] == 1.0  # the next of a single document is itself


CASES = [
    (1, lic._MIT), (2, "Copyright (c) 2020 Somebody\n\n" + lic._MIT.upper()), (3, "MIT License\n\nCopyright 1999 X\n" + lic._MIT.replace(". ", ".\n").replace("sublicense", "sublicence")),
    (4, "some text\n  Licensed under the Apache Licence, Version 2.0!\nmore"), (5, None), (6, ""), (7, "\n\n"), (8, "Released under the MIT License."), (8, "Released under the MIT License."), (9, lic._MIT + " and more"), (10, "the centre of the programme\nSPDX-License-Identifier: GPL-3.0"),
]


def test_every_known_text_is_found(spark):
    """In capitals, re-wrapped and with a copyright line before it; no two licences share a digest."""
    whole = [(i, k, t) for i, (k, kind, t) in enumerate(lic.KNOWN) if kind == "text"]
    odd = lambda t: "Copyright (c) 2021 Somebody\n" + t.upper().replace(". ", ".\n   ")
    got = lic.license_scan(spark.createDataFrame([(i, odd(t)) for i, _, t in whole], "doc_id long, text string"), lic.known_digests(spark)).where("unit = 'text'").collect()
    assert {r["doc_id"]: r["license"] for r in got} == {i: k for i, k, _ in whole}
    assert len({k for _, k, _ in whole}) >= 9 and {"GPL-3.0", "AGPL-3.0", "LGPL-2.1", "MPL-2.0"} <= {k for k, kind, _ in lic.KNOWN if kind == "notice"}


def test_licenses_in_very_long_texts(spark):
    """A notice as the last of many lines, and a whole licence with so much appended that it is another text."""
    rows = [(1, "line of a long text\n" * 200_000 + "Licensed under the Apache License, Version 2.0"), (2, lic._MIT + " word" * 300_000), (3, "x" * 2_000_000)]
    got = lic.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), lic.known_digests(spark)).collect()
    assert {(r["doc_id"], r["unit"], r["line"]): r["license"] for r in got} == {(1, "text", 0): None, (1, "line", 200_001): "Apache-2.0", (2, "text", 0): None, (3, "text", 0): None}


def test_license_scan(spark):
    known = lic.known_digests(spark)
    docs = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in CASES], "doc_id long, text string, digest string, license string, line int")
    got = lic.license_scan(docs, known).collect()
    found = {(r["doc_id"], r["unit"], r["line"]): r["license"] for r in got if r["license"]}
    assert found == {(1, "text", 0): "MIT", (2, "text", 0): "MIT", (3, "text", 0): "MIT", (4, "line", 2): "Apache-2.0", (8, "text", 0): "MIT", (10, "line", 2): "GPL-3.0"}
    assert sum(r["unit"] == "text" for r in got) == len(CASES)
    documents = pa.table({"doc_id": [i for i, _ in CASES], "text": [t for _, t in CASES]})  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(lic.oracle()).fetchall()
    columns = [c[0] for c in con.description] if con.description else ["doc_id", "unit", "line", "digest", "license"]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in got)
    assert lic.license_scan(docs.limit(0), known).count() == 0
    assert lic.license_scan(docs, known, broadcast_rows=1).count() == len(got)
