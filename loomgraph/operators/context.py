"""Context for a task: seeds, proximity, scores and what fits a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.storage import checked

from . import graph, relational, search


def seeds(functions: DataFrame, modules: DataFrame, task: str, words: list[str], files: list[str] = (), focus: list[str] = ()) -> DataFrame:
    """(id): functions of the focus files and modules; if none, those that keywords match; if
    none, those of modules that the task names."""
    file, low = F.col("file"), task.lower()
    near = F.lit(False)
    for f in files:
        near = near | F.contains(file, F.lit(f)) | F.contains(F.lit(f), file)
    named = modules.where(F.contains(F.lit(low), F.lower("id")) | F.contains(F.lit(low), F.lower("name"))).select(F.col("id").alias("module_id")).distinct().withColumn("named", F.lit(True))
    t = functions.join(checked(named), "module_id", "left")
    tier = F.when(near | F.col("module_id").isin(list(focus)), 0).when(search.keyword_score(F.col("name"), file, words) >= 0.45, 1).when(F.col("named"), 2)
    t = t.select("id", tier.alias("tier")).where("tier IS NOT NULL")
    best = t.agg(F.min("tier").alias("best"))
    return t.crossJoin(F.broadcast(best)).where("tier = best").select("id")  # one row


def scores(functions: DataFrame, calls: DataFrame, start: DataFrame, words: list[str], hops: int = 4) -> DataFrame:
    """Functions with their relevance: proximity to the seeds, keywords, and a bonus for entries."""
    d = graph.bfs(calls, start, most=hops, undirected=True)
    called = calls.select(F.col("dst").alias("id")).distinct().withColumn("called", F.lit(True))
    score = F.coalesce(S.depth_score(F.col("depth")), F.lit(0.0)) + search.keyword_score(F.col("name"), F.col("file"), words) + F.when(F.col("called").isNull(), 0.2).otherwise(0.0)
    return functions.join(d, "id", "left").join(called, "id", "left").withColumn("score", F.round(score, 6))


def snippet(name: Column, file: Column, lines: Column) -> Column:
    """What a function costs in a context: its signature line and an estimate of its body, whose
    lines count less in long, compressed bodies."""
    n = F.greatest(lines, F.lit(0))
    return F.concat(name, F.lit(" "), file, F.repeat(F.lit("x"), (n * F.when(n > 15, 20).otherwise(40)).cast("int")))


def pack(scored: DataFrame, budget: int = 6000, most: int = 80, seeded: bool = True) -> DataFrame:
    """(id, place): the best functions that fit; what does not fit is skipped.

    Best first; with seeds only functions with a positive score are candidates, without all are.
    """
    t = scored.where("score > 0") if seeded else scored
    t = t.select("id", (-F.col("score")).alias("rank"), S.estimate_tokens(snippet(F.col("name"), F.col("file"), F.col("size"))).alias("tokens"), F.lit(1).alias("all"))
    return relational.greedy_pack(t, ["all"], ["rank", "id"], "tokens", budget, most).select("id", "place")


def entry_flow(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(module_id, entry, calls): entry points of each module and what they call first."""
    entries = functions.join(calls.select(F.col("dst").alias("id")), "id", "left_anti")
    names = functions.select(F.col("id").alias("dst"), F.col("name").alias("callee"))
    out = calls.join(names, "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("callee")).alias("calls"))
    return entries.join(out, "id", "left").select("module_id", F.col("name").alias("entry"), "id", F.coalesce("calls", F.array().cast("array<string>")).alias("calls"))


def describe_modules(functions: DataFrame) -> DataFrame:
    """(module_id, description): three distinct purposes, else the most frequent verbs.

    Functions have module_id, name, file and purpose; purposes count in order of their first id.
    """
    first = F.trim(F.element_at(F.split("purpose", "[.!?]"), 1))
    short = F.when(F.char_length(first) > 60, F.concat(F.left(first, F.lit(57)), F.lit("..."))).otherwise(first)
    p = functions.where("purpose <> ''").groupBy("module_id", "purpose").agg(F.min("id").alias("id")).withColumn("short", short)
    p = relational.top_in(p, ["module_id"], [F.col("id")], 3).groupBy("module_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "short"))), lambda x: x["short"]), "; ").alias("purposes"))
    verb = F.lower(F.element_at(F.split(F.regexp_replace("name", "([a-z])([A-Z])", "$1 $2"), r"[\s_-]"), 1))
    v = functions.groupBy("module_id", verb.alias("verb")).agg(F.count("*").alias("n"))
    v = relational.top_in(v, ["module_id"], [F.desc("n"), F.col("verb")], 3).groupBy("module_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "verb"))), lambda x: x["verb"]), ", ").alias("verbs"))
    n = functions.groupBy("module_id").agg(F.count_distinct("file").alias("files"))
    text = F.coalesce("purposes", F.concat(F.lit("primarily "), "verbs", F.lit(" operations across "), F.col("files").cast("string"), F.lit(" files")))
    return n.join(v, "module_id").join(p, "module_id", "left").select("module_id", text.alias("description"))


def collapse_paths(paths: DataFrame, least: float = 0.6) -> DataFrame:
    """(group, prefix): the deepest directory that holds at least that share of a group's paths."""
    dirs = F.regexp_replace("path", r"/\*\*$", "")
    seg = F.split(dirs, "/")
    t = paths.select("group", F.explode(F.transform(F.sequence(F.lit(1), F.size(seg)), lambda n: F.struct(F.array_join(F.slice(seg, F.lit(1), n), "/").alias("prefix"), n.alias("depth")))).alias("x")).select("group", "x.*")
    n = paths.groupBy("group").agg(F.count("*").alias("n"))
    hit = t.groupBy("group", "prefix", "depth").agg(F.count("*").alias("hits")).join(n, "group").where(F.col("hits") >= F.ceil(F.col("n") * least))
    return hit.groupBy("group").agg(F.max_by("prefix", F.struct("depth", "prefix")).alias("prefix"))


def modules_by_selection(selected: DataFrame, most: int | None = None) -> DataFrame:
    """(module_id, selected): modules in order of how many of their functions were selected."""
    out = selected.groupBy("module_id").agg(F.count("*").alias("selected")).orderBy(F.desc("selected"), "module_id")
    return out if most is None else out.limit(most)


def constraints_of(modules: DataFrame, constraints: DataFrame) -> DataFrame:
    """(module_id, ord): the declared constraints (ord, raw) that name a module by its id."""
    return modules.select("module_id").distinct().join(checked(constraints.select("ord", "raw")), F.contains(F.lower("raw"), F.lower("module_id"))).select("module_id", "ord")
