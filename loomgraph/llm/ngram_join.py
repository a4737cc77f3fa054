"""N-gram Jaccard join: MinHash banding for candidates, full n-gram sets for verification.

1. Each text becomes its set of word n-grams (hashes), a MinHash signature and band hashes; band
   and row counts are chosen for a target recall at the threshold.
2. Rows with equal sets, whatever their ids, are one node; only nodes go on.
3. Band hashes are shuffled; each bucket links its members to its smallest (a star, no pairs).
   Components of these links are groups of candidates.
4. Each group's sets meet once.  Groups beyond a block's size are cut into blocks and every pair
   of blocks is one task; so no task grows with a group and no pair is skipped or emitted.  A task
   counts links by an inverted index and emits only counts and a spanning forest of its links.
5. Components of the forests are the classes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Memo, checked, column, materialise, slices
from .components import HOT, components

NGRAM, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.9995, 128
#: Texts of a block, and n-grams of its sets in all, at most (a larger single set is a block alone).
BLOCK_TEXTS, BLOCK_GRAMS = 1500, 1_500_000
_WORD = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def bands_for(threshold: float, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands reach the recall within so many hashes."""
    best = None
    for rows in range(1, hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall within so many hashes")
    return best


def _word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def ngrams(text: str | None, n: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of the whole text.

    Words are runs of letters and digits, lower-cased.  A shorter text is one n-gram, a text
    without words is the n-gram of itself, and null and empty texts have none.
    """
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.array([_word_hash("\0" + text)], np.uint64) if text else np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    g = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        g *= _M2
        g += h[i : len(h) - k + 1 + i]
    g ^= g >> np.uint64(29)
    g *= _M1
    return np.unique(g)


def signature(grams: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """MinHash values: for each odd multiplier, the least product modulo 2^64."""
    out = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(grams), 2048):
        part = grams[start : start + 2048]
        np.minimum(out, (part[None, :] * multipliers[:, None]).min(axis=1), out=out)
    return out


def band_hashes(grams: np.ndarray, multipliers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = signature(grams, multipliers).reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64) * _M1
    for i in range(rows):
        h = (h ^ s[:, i]) * _M2
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def describe(docs: DataFrame, n: int, bands: int, rows: int, keep: bool = False) -> DataFrame:
    """Rows of ``docs`` (id, text, …) with the key of the text's set instead of the text, and its
    band hashes, or with ``keep`` the set itself.  Texts without an n-gram have no key.
    Columns of docs must not be called key."""
    multipliers = np.random.default_rng(20240607).integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    others = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        memo = Memo(_word_hash)
        for b in slices(batches, "text", BATCH_BYTES // 2):
            sets = [ngrams(t, n, memo) for t in column(b, "text").to_pylist()]
            raw = [g.tobytes() for g in sets]
            keys = pa.array([hashlib.blake2b(r, digest_size=16).digest() if r else None for r in raw], pa.binary())
            if keep:
                made = pa.array(raw, pa.binary())
            else:
                made = pa.array([band_hashes(g, multipliers, bands, rows).tolist() if len(g) else [] for g in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(column(b, f.name) for f in others), keys, made], names=[*(f.name for f in others), "set_key", "made"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others)
    return docs.mapInArrow(run, f"{schema}, set_key binary, made {'binary' if keep else 'array<long>'}").withColumnsRenamed({"set_key": "key", "made": "grams" if keep else "bands"})


class _Links:
    """Links among the sets of one task: counts for each text and a spanning forest."""

    def __init__(self, ids, weights, sets):
        self.ids, self.weights, self.sets = ids, weights, sets
        self.n = np.array([len(s) for s in sets], np.int64)
        grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(grams, kind="stable")
        self.owner = owner[order]
        _, first, inverse = np.unique(grams[order], return_index=True, return_inverse=True)
        self.start = np.append(first, len(grams))
        code = np.empty(len(grams), np.int64)
        code[order] = inverse
        self.codes = np.split(code, np.cumsum(self.n)[:-1])

    def partners(self, i: int, threshold: float, lo: int, hi: int) -> np.ndarray:
        """The texts from lo on, before hi, whose similarity to text i reaches the threshold."""
        lists = [self.owner[self.start[c] : self.start[c + 1]] for c in self.codes[i]]
        shared = np.bincount(np.concatenate(lists), minlength=len(self.ids))[lo:hi]
        return lo + np.flatnonzero(shared >= threshold * (self.n[i] + self.n[lo:hi] - shared) - 1e-9)


def link_block(ids, weights, sets, side, threshold: float):
    """Counts of links (weighted by copies) and spanning edges among the texts of a block, or,
    with two sides, between the texts of side 0 and those of side 1 (side 0 comes first)."""
    links, count, parent, forest = _Links(ids, weights, sets), np.zeros(len(ids), np.int64), list(range(len(ids))), []
    cut = int(np.sum(side == 0)) if side.any() else 0

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(cut or len(ids)):
        for j in links.partners(i, threshold, cut or i + 1, len(ids)).tolist():
            count[i] += weights[j]
            count[j] += weights[i]
            if (a := root(i)) != (b := root(j)):
                parent[max(a, b)] = min(a, b)
                forest.append((i, j))
    return count, forest


def text_digest(text: str | Column) -> Column:
    """What tells the texts of rows with one id apart (null for a null text)."""
    return F.unhex(F.md5(F.col(text) if isinstance(text, str) else text))


def _with_nodes(rows: DataFrame, of_node: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows with what is known of their set.  Sets of so many copies that they are more than a
    task's share, a task's number of them at most, are broadcast instead of shuffled."""
    total, most = nodes.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    hot = max(HOT, total // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if most <= hot:
        return rows.join(of_node.drop("copies"), "key", "left")
    few = F.broadcast(of_node.where(F.col("copies") > hot).drop("copies"))
    rest = rows.join(F.broadcast(nodes.where(F.col("copies") > hot).select("key")), "key", "left_anti")
    return rest.join(of_node.where(F.col("copies") <= hot).drop("copies"), "key", "left").unionByName(rows.join(few, "key"))


def similarity_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, block_texts: int = BLOCK_TEXTS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """One row for each row of ``docs``: id, digest (of the text), class_id, n_links,
    representative, and head, whether it is the row that stands for its class: that of the
    smallest id (nulls last), then of the smallest digest.  Rows that repeat a head's id and text
    are heads too.  See similarity_classes() for the rest.
    """
    bands, rows = bands_for(threshold, recall, hashes)
    texts = docs.select(F.col(id_col).alias("id"), text_digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    known = materialise(describe(texts, ngram, bands, rows), "sets")
    order = F.struct(F.isnull("id").alias("nameless"), "id", "digest")
    nodes = known.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written, so these stay
    banded = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    buckets = banded.groupBy("band", "h").agg(F.min("node").alias("head"), F.max("node").alias("last")).where(F.col("head") != F.col("last"))
    stars = banded.join(buckets, ["band", "h"]).where(F.col("node") != F.col("head")).select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    groups = components(stars)

    # only the texts of candidates become sets again; sets are dealt to blocks of their group
    chosen = groups.join(nodes, "node").select("node", "component", "copies", F.col("first.id").alias("id"), F.col("first.digest").alias("digest"))
    chosen = materialise(chosen, "groups")
    texts = texts.join(checked(chosen.select("digest")), "digest", "left_semi")  # few enough: before the shuffle
    one = (texts["digest"] == chosen["digest"]) & texts["id"].eqNullSafe(chosen["id"])
    found = describe(texts.join(chosen, one).select("node", "component", "copies", "text"), ngram, bands, rows, keep=True)
    found = materialise(found.select("component", "node", "copies", "grams").dropDuplicates(["node"]), "candidates")
    sizes = found.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.octet_length("grams") / 8).alias("g"))
    sizes = sizes.select("component", F.greatest(F.ceil(F.col("n") / block_texts), F.ceil(F.col("g") / block_grams), F.lit(1)).cast("int").alias("blocks"))
    dealt = found.join(checked(sizes), "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # the pair (i, j), i <= j, of blocks; a text of block k goes to all pairs with k
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block"), "node", "copies", "grams")

    def link(t: pa.Table) -> pa.Table:
        t = t.sort_by([("block", "ascending"), ("node", "ascending")])
        ids, weights, block = (t.column(c).to_numpy() for c in ("node", "copies", "block"))
        i, j, component = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("component")[0].as_py()
        if len(ids) < 2 or i != j and (block == block[0]).all():
            return pa.Table.from_pylist([], schema=schema)
        count, forest = link_block(ids, weights, [np.frombuffer(g, np.uint64) for g in t.column("grams").to_pylist()], (block == j).astype(int) if i != j else np.zeros(len(ids), int), threshold)
        at = np.flatnonzero(count)
        a, b = [ids[x] for x, _ in forest], [ids[y] for _, y in forest]
        return pa.table([pa.array([component] * (len(at) + len(a)), pa.int64()), pa.array(np.concatenate([ids[at], a]).astype(np.int64)), pa.array([None] * len(at) + [int(x) for x in b], pa.int64()), pa.array(np.concatenate([count[at], np.zeros(len(a))]).astype(np.int64))], schema=schema)

    schema = pa.schema([("component", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
    dealt = dealt.repartition("component", "i", "j")  # not by component alone, which one task would hold
    verified = materialise(dealt.groupBy("component", "i", "j").applyInArrow(link, "component long, a long, b long, links long"), "links")
    counts = verified.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    merged = components(verified.where(F.col("b").isNotNull()).select("a", "b")).withColumnsRenamed({"component": "class"})
    linked = nodes.select("key", "node", "first", "copies").join(merged, "node")
    heads = linked.groupBy("class").agg(F.min("first").alias("head"))
    linked = materialise(linked.join(heads, "class").join(counts, "node", "left").select("key", "head", F.coalesce("links", F.lit(0)).alias("links")), "linked")
    # nodes without links to others, the most, need no join but that with their rows
    of_node = nodes.select("key", "first", "copies").join(linked, "key", "left").select("key", "first", "copies", F.coalesce("head", "first").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = _with_nodes(known.select("id", "digest", "key"), of_node, nodes)
    named = lambda c: F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col(c)["id"]).cast(kind)
    is_head = F.col("first").isNull() | (F.col("head.id").eqNullSafe(F.col("id")) & (F.col("head.digest") == F.col("digest")))
    return out.select(F.col("id").alias(id_col), "digest", named("head").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), named("first").alias("representative"), is_head.alias("head"))


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, block_texts: int = BLOCK_TEXTS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """One row for each row of ``docs``: id, class_id, n_links, representative.

    Each row is a document of its own, whatever its id.  Documents are linked where the Jaccard
    similarity of their n-gram sets is at least the threshold; class_id is the smallest id of the
    connected documents and n_links the number of other documents (rows) a document is linked to,
    copies and repeated rows included.  ``representative`` is the smallest id among documents of
    an equal set.  Null ids take part; class_id and representative are null only where all ids
    are.  Ids are of any ordered type.  Texts of any length count whole.  Null and empty texts
    have no n-gram: each such document is a class of its own without links.  Extra columns are
    ignored; an empty table gives an empty one.
    """
    found = similarity_rows(docs, id_col, text_col, ngram, threshold, recall, hashes, block_texts, block_grams)
    return found.select(id_col, "class_id", "n_links", "representative")
