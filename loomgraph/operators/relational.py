"""Joins, aggregations, ordered selections and set operations of the snapshot model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in order (upsert, node overwrite, latest event)."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_in(df: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group in order, with their rank."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def assign_modules(files: DataFrame, modules: list[tuple[str, list[str]]], regex) -> DataFrame:
    """The first declared module one of whose globs matches the path, else 'unknown'."""
    out = F.lit("unknown")
    for name, globs in reversed(modules):
        hit = F.lit(False)
        for g in globs:
            hit = hit | F.rlike("path", F.lit(regex(g)))
        out = F.when(hit, name).otherwise(out)
    return files.withColumn("module_id", out)


def drift(disk: DataFrame, lock: DataFrame, digits: int = 64) -> DataFrame:
    """(path, status) of what was added, deleted or modified between two tables (path, hash)."""
    a, b = disk.select("path", F.col("hash").alias("now")), lock.select("path", F.col("hash").alias("then"))
    status = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.left("now", F.lit(digits)) != F.left("then", F.lit(digits)), "modified")
    return a.join(b, "path", "full").select("path", status.alias("status")).where("status IS NOT NULL")


def merkle(files: DataFrame) -> DataFrame:
    """Per module the digest of its file digests in sorted order.

    Digests are fed to the hash one by one in sorted order, so a module of any size takes no more
    memory than a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            done: list[tuple] = []
            for module, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if state is None or module != at:
                    if state is not None:
                        done.append((at, state.hexdigest()))
                    at, state = module, hashlib.sha256()
                state.update((digest or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.string())], names=["module_id", "hash"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([state.hexdigest()])], names=["module_id", "hash"])

    rows = files.select(F.col("module_id").cast("string").alias("module_id"), "hash")
    return rows.repartition("module_id").sortWithinPartitions("module_id", "hash").mapInArrow(run, "module_id string, hash string")


def merkle_root(modules: DataFrame) -> DataFrame:
    """The digest of the module digests in order of the module ids (few rows by definition)."""
    rows = F.array_sort(F.collect_list(F.struct("module_id", "hash")))
    return modules.agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["hash"]), ""), 256).alias("root"))


def first_with_others(df: DataFrame, key: list[str], order: Column, other: str) -> DataFrame:
    """The first row of each key, and the sorted other values of ``other`` of its other rows."""
    w = Window.partitionBy(*key).orderBy(order)
    t = df.withColumn("_n", F.row_number().over(w))
    return t.groupBy(*key).agg(F.max(F.when(F.col("_n") == 1, F.col(other))).alias(other), F.array_join(F.array_sort(F.collect_set(F.when(F.col("_n") > 1, F.col(other)))), ",").alias("also_in"))


def numbered_duplicates(name: str, order: Column) -> Column:
    """The name, with -2, -3 and so on from its second row on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), n.cast("string")))


def within_budget(df: DataFrame, group: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """The longest prefix of each group in order whose cost stays within the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def greedy_pack(df: DataFrame, group: list[str], order: list[str], cost: str, budget: int, most: int = 80) -> DataFrame:
    """Of each group in order, what still fits into the budget; what does not is skipped.

    Groups are one query's candidates.  ``order`` columns sort ascending; the last identifies rows.
    Of the rows of one cost only the first budget / cost, and ``most`` at most, can be taken: once
    one of them does not fit, none after it does.  So only these, a number that the budget bounds,
    are gathered and gone through.
    """
    c = F.col(cost).cast("long")
    same = Window.partitionBy(*group, c).orderBy(*order)
    some = df.where((c <= budget) & (c >= 0)).withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= most).where((c == 0) | (F.col("_n") * c <= budget))
    rows = F.array_sort(F.collect_list(F.struct(*order, c.alias("_c"))))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    empty = f"cast(array() as array<struct<{', '.join(f'{c}:{kinds[c]}' for c in order)}>>)"
    fold = f"""aggregate(_rows, named_struct('used', 0L, 'kept', {empty}), (a, x) ->
      if(a.used + x._c > {budget}L OR size(a.kept) >= {most}, a,
         named_struct('used', a.used + x._c, 'kept', concat(a.kept, array(named_struct({', '.join(f"'{c}', x.{c}" for c in order)}))))), a -> a.kept)"""
    t = some.groupBy(*group).agg(rows.alias("_rows")).select(*group, F.posexplode(F.expr(fold)).alias("place", "k"))
    return t.select(*group, (F.col("place") + 1).alias("place"), *[F.col(f"k.{c}").alias(c) for c in order])


def islands(df: DataFrame, group: list[str], order: Column, same: str, least: int = 3) -> DataFrame:
    """Runs of ``least`` and more consecutive rows with an equal value: value, first row, length."""
    w, v = Window.partitionBy(*group).orderBy(order), Window.partitionBy(*group, same).orderBy(order)
    t = df.withColumn("_r", F.row_number().over(w)).withColumn("_i", F.col("_r") - F.row_number().over(v))
    return t.groupBy(*group, same, "_i").agg(F.min("_r").cast("long").alias("first_row"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_i")


def changed_values(df: DataFrame, key: str, order: list[Column], value: str) -> DataFrame:
    """Rows whose value differs from that of the key's row before; first rows count as changed."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col(value)))


def resolve_calls(calls: DataFrame, imported: DataFrame, functions: DataFrame) -> DataFrame:
    """Call edges (src, dst, confidence) of calls (src, file, name).

    ``imported`` (file, name, target, ord) are the names that a file's imports list; of several
    imports of a name the last by ord counts.  A call whose last part, or whole text, is such a
    name goes to the function of that name in the target (0.8).  Else it goes to a function of
    the same file but the caller itself (1.0; 0.5 if only without its dotted prefix).
    """
    c = calls.withColumn("bare", F.substring_index("name", ".", -1))
    known = functions.groupBy(F.col("file").alias("kfile"), F.col("name").alias("kname")).agg(F.min("id").alias("kid"))
    listed = imported.groupBy(F.col("file").alias("ifile"), F.col("name").alias("iname")).agg(F.max_by("target", F.struct("ord", "target")).alias("target"))
    by_bare = listed.select("ifile", F.col("iname").alias("ibare"), F.col("target").alias("t1"))
    by_name = listed.select(F.col("ifile").alias("jfile"), F.col("iname").alias("jname"), F.col("target").alias("t2"))
    t = c.join(by_bare, (F.col("file") == F.col("ifile")) & (F.col("bare") == F.col("ibare")), "left").join(by_name, (F.col("file") == F.col("jfile")) & (F.col("name") == F.col("jname")), "left")
    t = t.select("src", "file", "name", "bare", F.coalesce("t1", "t2").alias("tfile"), F.when(F.col("t1").isNotNull(), F.col("bare")).otherwise(F.col("name")).alias("tname"))
    there, here = known.toDF("tfile", "tname", "idst"), known.toDF("file", "bare", "hdst")
    t = t.join(there, ["tfile", "tname"], "left").join(here, ["file", "bare"], "left")
    dst = F.coalesce("idst", F.when(F.col("hdst") != F.col("src"), F.col("hdst")))
    conf = F.when(F.col("idst").isNotNull(), 0.8).when(F.col("name") == F.col("bare"), 1.0).otherwise(0.5)
    return t.select("src", dst.alias("dst"), conf.alias("confidence")).where("dst IS NOT NULL")


def normal_path(path: Column) -> Column:
    """A relative path with . and .. resolved by a fold over its segments; leading .. stay."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    step = lambda a, x: F.when((x == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, str]], endings: list[str]) -> DataFrame:
    """Imports (file, source) with their target: alias prefix, then relative path, then the first
    ending that names a file; other sources are external (target '')."""
    src = F.col("source")
    mapped, known = src, F.startswith(src, F.lit(".")) | F.startswith(src, F.lit("/"))
    for prefix, target in reversed(aliases):
        hit = F.startswith(src, F.lit(prefix))
        mapped = F.when(hit, F.concat(F.lit(target), F.substring(src, F.lit(len(prefix) + 1), F.char_length(src)))).otherwise(mapped)
        known = known | hit
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    path = F.when(F.startswith(mapped, F.lit(".")), normal_path(F.concat_ws("/", folder, mapped))).otherwise(mapped)
    done = F.lit(False)
    for e in endings:
        if not e.startswith("/"):
            done = done | F.endswith("_path", F.lit(e))
    # the number of shuffle partitions is kept: these rows are small when compressed and become several each
    n = int(imports.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = imports.select("file", "source").repartition(n, "file", "source").distinct().withColumn("_path", path).withColumn("_known", known).withColumn("_done", done)
    tries = t.select("file", "source", "_path", "_known", "_done", F.posexplode(F.array(*[F.concat("_path", F.lit(e)) for e in endings])).alias("_k", "_try"))
    found = tries.join(files.select(F.col("path").alias("_try")).distinct().withColumn("_hit", F.lit(True)), "_try", "left")
    best = found.groupBy("file", "source", "_path", "_known", "_done").agg(F.min_by("_try", F.when(F.col("_hit"), F.col("_k"))).alias("_best"))
    target = F.when(~F.col("_known"), "").when(F.col("_done"), F.col("_path")).otherwise(F.coalesce("_best", F.concat("_path", F.lit(endings[0]))))
    return best.select("file", "source", target.alias("target"))


def resolve_packages(imports: DataFrame, files: DataFrame, module: str) -> DataFrame:
    """Imports (file, source) of packages below the path ``module`` with their target: the file
    named as the package in its folder, its index file, the file beside the folder, else the
    folder; other packages are external (target '').  Without a module path every package is
    looked for."""
    inside = F.startswith("source", F.lit(module))
    rel = F.regexp_replace(F.substring("source", F.lit(len(module) + 1), F.char_length("source")), "^/", "") if module else F.col("source")
    t = imports.select("file", "source").distinct().withColumn("_in", inside).withColumn("_rel", rel)
    base = F.substring_index("_rel", "/", -1)
    names = F.array(F.concat("_rel", F.lit("/"), base, F.lit(".go")), F.concat("_rel", F.lit("/index.go")), F.concat("_rel", F.lit(".go")))
    tries = t.select("file", "source", "_in", "_rel", F.posexplode(names).alias("_k", "_try"))
    found = tries.join(files.select(F.col("path").alias("_try")).distinct().withColumn("_hit", F.lit(True)), "_try", "left")
    best = found.groupBy("file", "source", "_in", "_rel").agg(F.min_by("_try", F.when(F.col("_hit"), F.col("_k"))).alias("_best"))
    return best.select("file", "source", F.when(F.col("_in"), F.coalesce("_best", "_rel")).otherwise("").alias("target"))


def pivot_counts(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A matrix of sums with zeros where there is nothing."""
    return df.groupBy(row).pivot(column, columns).agg(F.sum(value)).fillna(0)


def merge_siblings(clusters: DataFrame) -> DataFrame:
    """Clusters (id, base, files, confidence) of one base directory as one."""
    return clusters.groupBy("base").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))), ",").alias("files"), F.round(F.avg("confidence"), 6).alias("confidence"))


def most_frequent(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the least."""
    n = df.groupBy(*group, value).agg(F.count("*").alias("_n"))
    return n.groupBy(*group).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def folder_globs(df: DataFrame, group: str, path: str) -> DataFrame:
    """(group, paths): the distinct folders of each group's paths as globs, sorted."""
    folder = F.concat(F.regexp_replace(path, "/[^/]*$", ""), F.lit("/**"))
    return df.groupBy(group).agg(F.array_sort(F.collect_set(folder)).alias("paths"))


def told_apart(name: str, by: str) -> Column:
    """A name, with another column in brackets where several rows have it."""
    n = F.count("*").over(Window.partitionBy(name))
    return F.when(n > 1, F.concat(name, F.lit(" ("), by, F.lit(")"))).otherwise(F.col(name))
