"""Document fingerprints: threshold-scaled sketches of word shingles, in SQL functions only.

A sketch keeps every distinct shingle hash below one fixed share 1/SCALE of the hash range, for
texts of every length, so sketches of very unequal texts stay comparable and sketches of parts
merge by union.  A text none of whose few shingles is below the limit has no hash; its sketch
holds a digest of its shingles instead, which tells equal texts from others and nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a shingle, and the share of the hash range that is kept: one in SCALE.
SHINGLE, SCALE = 5, 4
#: Ranges of ids at most, which bounds the table of bounds that every task holds.
MOST_RANGES = 20_000
#: More than any _hash, less than any _rank, and the numbers up to which a double is one key.
_TOP, _NONE, _EXACT = 1 << 52, -2.0**64, 2.0**53


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, although it is used often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of all runs of ``shingle`` words; a shorter text is one shingle, an empty one none.

    Words are runs of letters and digits, lower-cased.  A text without any is one shingle itself.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of(h: Column) -> Column:
        several = F.transform(F.sequence(F.lit(1), F.size(h) - (shingle - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(shingle)]))
        whole = F.when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " "))))
        return F.when(F.size(h) >= shingle, several).otherwise(F.coalesce(whole, F.when(text != "", F.array(F.xxhash64(text))), F.array().cast("array<bigint>")))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """A struct (hashes, whole): the sorted distinct hashes below the limit, and, only where there
    are none, a digest of all shingles (null for a text without any)."""
    limit = F.lit(-(1 << 63) + (1 << 64) // scale).cast("long")

    def of(h: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(h, lambda x: x < limit)))
        return let(low, lambda k: F.struct(k.alias("hashes"), F.when((F.size(k) == 0) & (F.size(h) > 0), F.xxhash64(F.array_sort(F.array_distinct(h)))).alias("whole")))

    return let(shingle_hashes(F.coalesce(text, F.lit("")), shingle), of)


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' united shingles (without a hash on either side, the greater digest)."""
    united = F.array_sort(F.array_union(a["hashes"], b["hashes"]))
    return let(united, lambda u: F.struct(u.alias("hashes"), F.when(F.size(u) == 0, F.greatest(a["whole"], b["whole"])).alias("whole")))


def _shared(a: Column, b: Column, of) -> Column:
    """``of`` (shared, first's, second's number of hashes); without any hash, whether the digests agree."""
    n = lambda p: of(F.size(F.array_intersect(p["a"]["hashes"], p["b"]["hashes"])).cast("double"), F.size(p["a"]["hashes"]).cast("double"), F.size(p["b"]["hashes"]).cast("double"))
    bare = lambda p: F.size(p["a"]["hashes"]) + F.size(p["b"]["hashes"]) == 0
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.when(bare(p), p["a"]["whole"].eqNullSafe(p["b"]["whole"]).cast("double")).otherwise(n(p)))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity.  Of two sketches without a hash it is 1 if their digests (or
    both texts' lack of shingles) agree and 0 if not; of one without and one with hashes it is 0."""
    return _shared(a, b, lambda n, x, y: n / (x + y - n))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has; 0 where only the second
    has a hash, and as resemblance() where neither has."""
    return _shared(a, b, lambda n, x, y: F.when(x == 0, F.lit(0.0)).otherwise(n / x))


def text_form(s: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash, or = and the digest."""
    digits = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.coalesce(F.concat(F.lit("="), digits(s["whole"])), F.array_join(F.transform(s["hashes"], digits), ""))


def _ranked(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """With _rank, the key as a double (nulls least), and _hash, 52 bits of the columns' hash."""
    rank = F.coalesce(F.col(key).cast("long").cast("double"), F.lit(_NONE))
    return docs.withColumn("_rank", rank).withColumn("_hash", F.shiftrightunsigned(F.xxhash64(*columns), 12))


def _bounds(rows: DataFrame, parts: int) -> list[tuple[float, int]]:
    """At most about 2 ``parts`` pairs (rank, hash) of actual rows, in order, that cut the rows into ranges of
    about equal size.  Keys that many quantiles hit are cut by quantiles of their rows' hashes;
    other bounds take in all rows of their rank."""
    cuts = rows.agg(F.percentile_approx("_rank", [(i + 1) / parts for i in range(parts)], 20 * parts), F.max("_rank")).first()
    if cuts[1] is None:
        return []
    hits: dict[float, int] = {cuts[1]: 0}
    for k in cuts[0]:
        hits[k] = hits.get(k, 0) + 1
    hot = [k for k, n in hits.items() if n >= 2 and (abs(k) <= _EXACT or k == _NONE)]
    bounds = {(k, _TOP) for k in hits.keys() - set(hot)}
    if hot:
        most = max(hits.values())
        found = rows.where(F.col("_rank").isin(hot)).groupBy("_rank").agg(F.percentile_approx("_hash", [(i + 1) / most for i in range(most)], 20 * most).alias("q"), F.max("_hash").alias("top"))
        for r in found.collect():  # a row for each of at most ``parts`` / 2 keys
            n = hits[r["_rank"]]
            bounds |= {(r["_rank"], r["q"][(i + 1) * most // n - 1]) for i in range(n)} | {(r["_rank"], r["top"])}
    return sorted(bounds)


def following(docs: DataFrame, key: str, columns: list[str], parts: int = 0) -> DataFrame:
    """Each row with ``next_<column>`` of the row after it in descending ``key`` (cyclic).

    One shuffle, no global sort in one task: quantiles of the key (actual keys; for a key of many
    rows, of their hashes) cut the rows into ranges; the row that ends a range also goes, as a
    guest, to the range that it follows.  Ties of the key are ordered by the hash of the columns,
    descending; null keys come last.  Rows that are alike in key and columns lie in one range.
    """
    spark = docs.sparkSession
    parts = parts or min(MOST_RANGES, max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    docs = _ranked(docs, key, columns)
    bounds = _bounds(docs, parts)
    if not bounds:
        return docs.drop("_rank", "_hash").select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    n, steps = len(bounds), [1 << i for i in reversed(range(max(1, len(bounds).bit_length())))]
    keys, hashes = F.lit([k for k, _ in bounds]), F.lit([h for _, h in bounds])
    # the number of bounds below the row, by binary search
    at_key = lambda i: F.element_at(keys, F.least(i, F.lit(n)))
    at_hash = lambda i: F.element_at(hashes, F.least(i, F.lit(n)))
    less = lambda i: (at_key(i) < F.col("_rank")) | ((at_key(i) == F.col("_rank")) & (at_hash(i) < F.col("_hash")))
    below = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= n) & less(at + step), at + step).otherwise(at))
    docs = docs.withColumn("_range", below)
    # the rows of a bound (all of its key, or of its key and hash) are the first of their range
    first = (at_key(F.col("_range") + 1) == F.col("_rank")) & ((at_hash(F.col("_range") + 1) == F.col("_hash")) | (at_hash(F.col("_range") + 1) == _TOP))
    own = F.struct(F.col("_range").alias("at"), F.lit(False).alias("guest"))
    rows = docs.withColumn("_to", F.explode(F.when(first, F.array(own, F.struct(((F.col("_range") + 1) % n).alias("at"), F.lit(True).alias("guest")))).otherwise(F.array(own))))
    rows = rows.select(docs.columns + [F.col("_to.at").alias("_at"), F.col("_to.guest").alias("_guest")])
    order = Window.partitionBy("_at").orderBy("_guest", F.desc_nulls_last(key), F.desc("_hash"))
    rows = rows.withColumn("_next", F.lead(F.struct(*columns)).over(order)).where(~F.col("_guest"))
    return rows.select("*", *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns]).drop("_rank", "_hash", "_range", "_at", "_guest", "_next")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 0) -> DataFrame:
    """Per row: sketches of the text, of its edited text and their likeness; see the README.

    The edited text has its last floor(n/2) characters replaced by as many first characters of the
    next document in descending id (after the last: the first).  Ids are integers.  Null texts
    count as empty and have an empty sketch.  Repeated rows and ids give a row each; extra columns are ignored; an
    empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = following(rows, "doc_id", ["text"], parts)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", sketch(F.col("text")).alias("s"), sketch(F.col("next_text")).alias("next_s"), F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("e"))
    return rows.select("doc_id", "n_chars", "edited_sha256", F.col("s").alias("sketch"), F.col("e").alias("edited_sketch"), resemblance(F.col("s"), F.col("e")).alias("near_edited"), resemblance(F.col("s"), F.col("next_s")).alias("near_next"), containment(F.col("s"), F.col("e")).alias("kept_in_edited"))
