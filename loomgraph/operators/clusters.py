"""Clusters of files by coupling, their names, and the modules that they suggest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.storage import cut

from . import context, graph, search
from . import relational as R
from .components import components

LEAST_SIZE, LEAST_SCORE, ORPHAN = 2, 0.15, 0.3
# Names of files that a program starts from, and languages by extension.
ENTRY_NAMES = ["index", "main", "app", "server", "mod", "lib", "__init__", "manage", "program", "startup"]


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, n): edges of any type that begin or end at the file itself."""
    files = nodes.where("type = 'file'").select(F.col("id").alias("file"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("file"))
    return files.join(ends.groupBy("file").agg(F.count("*").alias("n")), "file", "left").fillna(0, ["n"])


def _grow(rows: pd.DataFrame, least_size: int, least: float) -> Iterator[tuple[str, str, int]]:
    """(seed, file, place in the cluster) of the clusters of one component of coupled files.

    ``rows`` are ties (a, b, score) both ways with a's edges n.  From the most edges on, each free
    file seeds a cluster; a free tie of a member joins where its score reaches ``least`` and its
    mean score to the members is above its best to a free file outside.
    """
    near: dict[str, dict[str, float]] = {}
    rank: dict[str, tuple[int, str]] = {}
    for a, b, s, n in rows.sort_values(["a", "b"])[["a", "b", "score", "n"]].itertuples(index=False):
        near.setdefault(a, {})[b] = s
        rank[a] = (-n, a)
    taken: set[str] = set()

    def fits(file: str, members: list[str]) -> bool:
        ties, inside = near[file], set(members)
        mean = sum(ties.get(m, 0.0) for m in members) / len(members)
        return mean > max((s for g, s in ties.items() if g not in inside and g not in taken), default=0.0)

    for seed in sorted(near, key=rank.__getitem__):
        if seed in taken:
            continue
        members, grown = [seed], True
        while grown:
            grown = False
            for member in list(members):
                for file, score in near[member].items():
                    if file not in taken and file not in members and score >= least and fits(file, members):
                        members.append(file)
                        grown = True
        if len(members) >= least_size:
            taken.update(members)
            yield from ((seed, m, i) for i, m in enumerate(members))


def members(pairs: DataFrame, ranked: DataFrame, least_size: int = LEAST_SIZE, least: float = LEAST_SCORE) -> DataFrame:
    """(seed, file, place, orphan): the clusters of files.

    ``pairs`` (a, b, score) as by graph.coupling(), ``ranked`` (file, n) all files with their
    edges; those with most seed first, then in order of paths.  Components of coupled files do not touch each other, so each is one task's; within
    one, growth is sequential by definition.  Files in no cluster are clusters of their own.
    """
    both = pairs.select("a", "b", "score").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    both = both.join(ranked.withColumnsRenamed({"file": "a"}), "a")
    of = components(pairs.select("a", "b"))
    ties = both.join(of.select(F.col("node").alias("a"), "component"), "a")

    def grow(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_grow(rows, least_size, least)), columns=["seed", "file", "place"])

    grown = cut(ties.groupBy("component").applyInPandas(grow, "seed string, file string, place int"), "grown")
    alone = ranked.join(grown, "file", "left_anti").select(F.col("file").alias("seed"), "file", F.lit(0).alias("place"))
    return grown.withColumn("orphan", F.lit(False)).unionByName(alone.withColumn("orphan", F.lit(least_size > 1)))


def _common(folders: Column) -> Column:
    """The leading parts that all arrays of a group share (those of its least and its greatest)."""
    low, high = F.min(folders), F.max(folders)
    n = F.least(F.size(low), F.size(high))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i > n) | (F.try_element_at(low, i) != F.try_element_at(high, i)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.slice(low, F.lit(1), F.coalesce(F.array_min(differ) - 1, n)))


def _telling(parts: Column) -> Column:
    return F.filter(parts, lambda x: ~x.isin("src", ""))


def cluster_id(common: Column, first: Column) -> Column:
    """A name from up to three telling folders that all files share; without one from the first
    file's folders, else its name."""
    own = _telling(F.slice(F.split(first, "/"), F.lit(1), F.greatest(F.size(F.split(first, "/")) - 1, F.lit(0))))
    base = F.regexp_replace(F.substring_index(first, "/", -1), r"\.[^.]+$", "")
    parts = F.when(F.size(common) > 0, _telling(common)).otherwise(own)
    last = F.when(F.size(common) > 0, F.element_at(common, -1)).otherwise(base)
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, 3), "-")).otherwise(last)


def detect(nodes: DataFrame, edges: DataFrame, least_size: int = LEAST_SIZE, least: float = LEAST_SCORE, domains: DataFrame | None = None) -> DataFrame:
    """(ord, id, name, confidence, files, functions): clusters of a project's files, the surest first.

    Grown clusters that share their first two telling folders become one, whose confidence is
    their mean.  Ids that repeat get -2, -3 and so on; names that repeat get the id in brackets.
    ``domains`` (ord, domain, keyword) name clusters by their words; without a hit, or the table,
    the id in title case is the name.
    """
    files = nodes.where("type = 'file'").select(F.col("id").alias("file"))
    n = cut(degrees(nodes, edges), "degrees")
    ties = graph.coupling(edges.where("type IN ('calls', 'imports')"), nodes, n)
    grown = members(ties, n, least_size, least).join(n.withColumnsRenamed({"file": "seed", "n": "seed_n"}), "seed")
    # orphans come after the grown clusters, in order of their paths
    grown = cut(grown.withColumn("order", F.struct("orphan", F.when(~F.col("orphan"), -F.col("seed_n")).otherwise(0).alias("r"), "seed")), "clusters")
    holds = edges.where("type = 'contains'").select(F.col("src").alias("file"), F.col("dst").alias("id"))
    holds = holds.join(files, "file", "left_semi")
    out = edges.where("type = 'imports'").join(files.withColumnRenamed("file", "src"), "src", "left_semi").select(F.col("src").alias("file"), F.col("dst").alias("to"))
    called = edges.where("type = 'calls'").join(holds.select(F.col("id").alias("src"), "file"), "src").join(nodes.select(F.col("id").alias("dst"), F.col("file").alias("to")), "dst").select("file", "to")
    seed_of = grown.select("file", "seed")
    moded = out.unionByName(called).join(seed_of.withColumnRenamed("seed", "from_module"), "file").join(seed_of.select(F.col("file").alias("to"), F.col("seed").alias("to_module")), "to", "left")
    moded = moded.withColumn("to_module", F.coalesce("to_module", F.lit("")))
    sure = graph.cluster_confidence(moded, grown.select(F.col("seed").alias("module_id"))).withColumnRenamed("module_id", "seed")
    parts = F.split("file", "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    one = grown.groupBy("seed", "order", "orphan").agg(_common(folders).alias("common"), F.min_by("file", "place").alias("first"), F.count("*").alias("size")).join(sure, "seed")
    one = one.withColumn("confidence", F.when(F.col("orphan"), F.lit(ORPHAN)).otherwise(F.col("confidence")))
    fallback = F.coalesce(F.try_element_at(_telling(F.split("first", "/")), F.lit(1)), F.lit("root"))
    base = F.array_join(F.slice(_telling(F.col("common")), 1, 2), "/")
    one = cut(one.withColumn("base", F.when(base != "", base).otherwise(fallback)), "bases")
    merged = one.groupBy("base").agg(F.min("order").alias("order"), F.avg("confidence").alias("confidence"), F.count("*").alias("clusters"), F.min_by("first", "order").alias("first"), F.min_by("common", "order").alias("common"), F.min_by("size", "order").alias("size"))
    file_id = cluster_id(F.array().cast("array<string>"), F.col("first"))
    merged = merged.withColumn("id", F.when((F.col("clusters") > 1) | (F.col("size") == 1), file_id).otherwise(cluster_id(F.col("common"), F.col("first"))))
    all_files = grown.join(one.select("seed", "base"), "seed").groupBy("base").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "place", "file"))), lambda x: x["file"]).alias("files"))
    fns = grown.join(one.select("seed", "base"), "seed").join(holds, "file").groupBy("base").agg(F.array_sort(F.collect_set("id")).alias("functions"))
    t = merged.join(all_files, "base").join(fns, "base", "left").withColumn("functions", F.coalesce("functions", F.array().cast("array<string>")))
    title = S.title_case(F.col("id"))
    if domains is not None:
        bag = F.flatten(F.transform(F.concat(F.flatten(F.transform("files", lambda f: _telling(F.split(F.regexp_replace(f, r"\.[^./]+$", ""), "/")))), F.transform("functions", lambda i: F.substring_index(i, ":", -1))), lambda w: S.words_of(w, keep_dots=False, digits=True, lower=True, least=2)))
        named = search.domain_names(t.select(F.col("base").alias("group"), F.explode(bag).alias("word")), domains)
        t = t.join(named.withColumnRenamed("group", "base"), "base", "left").withColumn("name", F.coalesce("name", title))
    else:
        t = t.withColumn("name", title)
    t = t.withColumn("id", R.numbered_duplicates("id", F.col("order")))
    many = F.count("*").over(Window.partitionBy("name"))
    place = S.title_case(F.array_join(F.filter(F.split("id", "-"), lambda s: ~s.isin("packages", "apps", "src")), " "))
    t = t.withColumn("_many", many).withColumn("name", F.when((F.col("_many") > 1) & (place != "") & (place != F.col("name")), F.concat("name", F.lit(" ("), place, F.lit(")"))).otherwise(F.col("name")))
    return t.select(F.row_number().over(Window.orderBy(F.desc("confidence"), "order")).alias("ord"), "id", "name", F.round("confidence", 6).alias("confidence"), "files", "functions")  # clusters of one project


def entry_files(files: DataFrame) -> DataFrame:
    """Files (path) that a program may start from, by their names."""
    return files.where(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]+$", "").isin(ENTRY_NAMES)).select("path")


def exported_names(clusters: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, names): the exported functions (id, name, file, is_exported) of each cluster's files."""
    files = clusters.select(F.col("id").alias("cluster"), F.explode("files").alias("file"))
    out = functions.where("is_exported").join(files, "file").groupBy(F.col("cluster").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("file", "id", "name"))), lambda x: x["name"]).alias("names"))
    return clusters.select("id").join(out, "id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def declared(clusters: DataFrame, g) -> DataFrame:
    """(ord, id, name, description, intent, paths, entry_functions): modules as a contract declares
    them, from clusters and the graph that they come from."""
    of = clusters.select(F.col("id").alias("module_id"), F.explode("files").alias("file"))
    top = g.edges.where("type = 'contains'").select(F.col("src").alias("file"), F.col("dst").alias("id"))
    fns = g.nodes.where("type = 'function'").join(top.select("id"), "id", "left_semi").join(of, "file")
    told = context.describe_modules(fns.select("module_id", "id", "name", "file", F.coalesce("purpose", F.lit("")).alias("purpose")))
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    paths = of.select("module_id", F.concat(folder, F.lit("/**")).alias("p")).distinct().groupBy("module_id").agg(F.array_sort(F.collect_list("p")).alias("paths"))
    names = exported_names(clusters, fns)
    t = clusters.join(told.withColumnRenamed("module_id", "id"), "id", "left").join(paths.withColumnRenamed("module_id", "id"), "id").join(names, "id")
    return t.select("ord", "id", "name", F.coalesce("description", F.concat(F.size("files").cast("string"), F.lit(" files, 0 functions"))).alias("description"), F.lit("").alias("intent"), "paths", F.col("names").alias("entry_functions"))


def contract(clusters: DataFrame, g, name: str, description: str = "") -> DataFrame:
    """One row: a contract in the shape of snapshot.CONTRACT, to be refined by hand."""
    from loomgraph.sources.snapshot import CONTRACT

    mods = declared(clusters, g)
    m = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "name", "description", "intent", "paths", "entry_functions"))), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["description"].alias("description"), x["intent"].alias("intent"), F.array().cast("array<string>").alias("owners"), x["paths"].alias("paths"), x["entry_functions"].alias("entryFunctions")))
    ext = F.lower(F.substring_index("path", ".", -1))
    lang = g.parsed.groupBy(ext.alias("e")).agg(F.count("*").alias("n")).agg(F.coalesce(F.max_by("e", F.struct("n", "e")), F.lit("ts")).alias("e"))
    row = mods.agg(m.alias("modules")).crossJoin(lang)  # one row each
    none = F.array().cast("array<string>")
    out = row.select(F.lit("1.0.0").alias("version"), F.struct(F.lit(name).alias("name"), F.lit(description).alias("description"), S.language_of_extension(F.col("e")).alias("language"), F.lit(None).cast("string").alias("framework")).alias("project"), F.struct("modules", none.alias("constraints"), none.alias("decisions")).alias("declared"), F.lit("never").alias("mode"))
    out = out.withColumn("overwrite", F.struct("mode", F.lit(True).alias("requireConfirmation"))).drop("mode")
    return out.select(F.from_json(F.to_json(F.struct("*")), CONTRACT).alias("c")).select("c.*")
