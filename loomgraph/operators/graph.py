"""Graph operators over edges (src, dst): src depends on dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.storage import BROADCAST_ROWS, cut


#: Rounds of a search after which the tables of what was seen become one.
COMPACT = 8


def bfs(edges: DataFrame, seeds: DataFrame, *, most: int | None = None, undirected: bool = False, reverse: bool = True, copy: bool = True) -> DataFrame:
    """(id, depth): nodes reached from the seeds (column id) and their least distance.

    Each round joins the frontier with the edges, drops what was seen and writes the new frontier,
    so lineage does not grow and the seen set is never gathered.  Cycles end where a round finds
    nothing new.  The edges are written once, too; without ``copy`` they are read from where they
    are in each round, which is better for edges that are a table already.
    """
    e = edges.select(F.col("src").alias("to"), F.col("dst").alias("at")) if reverse else edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    if undirected:
        e = e.unionByName(e.select(F.col("to").alias("at"), F.col("at").alias("to")))
    e = cut(e) if copy else e
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier, n, depth = seen, seen.count(), 0
    while n and (most is None or depth < most):
        depth += 1
        at = frontier.select(F.col("id").alias("at"))
        # a counted small frontier goes to the edges, which then are not shuffled
        new = e.join(F.broadcast(at) if n <= BROADCAST_ROWS else at, "at").select(F.col("to").alias("id")).distinct()
        frontier = cut(new.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        n = frontier.count()
        seen = seen.unionByName(frontier)
        if depth % COMPACT == 0:
            seen = cut(seen)
    return seen


def impact(edges: DataFrame, nodes: DataFrame, changed: DataFrame, most: int | None = None, copy: bool = True) -> DataFrame:
    """(id, module_id, depth, risk) of everything that depends on the changed nodes.

    Depth 1 outside the modules of the changed nodes is critical, other depth 1 high, depth 2
    medium, the rest low.
    """
    reached = bfs(edges, changed, most=most, copy=copy).where("depth > 0")
    own = nodes.join(changed.select("id").distinct(), "id", "left_semi").select("module_id").distinct().withColumn("own", F.lit(True))
    cross = F.col("own").isNull()
    risk = F.when((F.col("depth") == 1) & cross, "critical").when(F.col("depth") == 1, "high").when(F.col("depth") == 2, "medium").otherwise("low")
    return reached.join(nodes.select("id", "module_id"), "id").join(own, "module_id", "left").select("id", "module_id", "depth", risk.alias("risk"))


def truncated(hit: DataFrame, most: int = 10) -> DataFrame:
    """(risk, id, rank, truncated): the nearest ``most`` of each risk, and whether there are more."""
    w = Window.partitionBy("risk").orderBy("depth", "id")
    total = hit.groupBy("risk").agg((F.count("*") > most).alias("truncated"))
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).join(total, "risk").select("risk", "id", "rank", "truncated")


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges whose both ends are among the ids."""
    return edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def neighbours(edges: DataFrame, forward: bool = True) -> DataFrame:
    """(id, place, other): the adjacency of a graph as rows, in order of the other end; a hub is
    many rows, not one long one."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    t = edges.select(F.col(a).alias("id"), F.col(b).alias("other"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("other"))).select("id", "place", "other")


def confidence(n: Column, depth: Column) -> Column:
    return F.when((n < 5) & (depth < 3), "high").when((n < 20) & (depth < 6), "medium").otherwise("low")


def impact_summary(hit: DataFrame) -> DataFrame:
    """One row: how many are impacted, at what greatest depth, by risk, and the confidence."""
    n, d = F.count("*"), F.coalesce(F.max("depth"), F.lit(0))
    count = lambda r: F.count_if(F.col("risk") == r).alias(r)
    return hit.agg(n.alias("impacted"), d.cast("int").alias("depth"), *[count(r) for r in ("critical", "high", "medium", "low")], confidence(n, d).alias("confidence"))


def exempt(name: Column, file: Column, exported: Column) -> Column:
    """Whether an entity is never dead: exported, an entry point, a test or a constructor."""
    # Patterns of entry points and tests.
    entry = [r"(?i)^(main|bootstrap|start|init|setup|configure|register|mount)$", r"(?i)^(app|server|index|mod|program)$", "(?i)Handler$", "(?i)Middleware$", "(?i)Controller$", "^use[A-Z]", "^handle[A-Z]", "^on[A-Z]"]
    tests = [r"^(it|describe|test|beforeAll|afterAll|beforeEach|afterEach)$", r"\.test\.", r"\.spec\.", "__test__"]
    out = F.coalesce(exported, F.lit(False)) | name.isin("constructor", "__init__") | F.endswith(name, F.lit(".constructor"))
    for p in entry + tests:
        out = out | F.rlike(name, F.lit(p))
    for p in tests:
        out = out | F.rlike(file, F.lit(p))
    return F.coalesce(out, F.lit(False))


def dead(functions: DataFrame, calls: DataFrame, routes: DataFrame | None = None, noted: DataFrame | None = None) -> DataFrame:
    """Functions (id, name, file, module_id, is_exported) without callers and without exemption.

    Also exempt are handlers of routes and what an exported function of the same file is noted to
    call.  ``noted`` (src, dst) are the callers that a snapshot notes (the calls themselves by
    default); functions with noted callers but without a call edge say how many they are.
    """
    noted = calls if noted is None else noted
    out = functions.join(calls.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").where(~exempt(F.col("name"), F.col("file"), F.col("is_exported")))
    if routes is not None:
        out = out.join(routes.select(F.col("handler").alias("name")).distinct(), "name", "left_anti").select(functions.columns)
    by = noted.join(functions.select(F.col("id").alias("src"), F.col("file").alias("from_file"), F.coalesce("is_exported", F.lit(False)).alias("from_exported")), "src", "left")
    same = by.join(functions.select(F.col("id").alias("dst"), F.col("file").alias("own_file")), "dst")
    n = same.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_noted"), F.max(F.coalesce(F.col("from_exported") & (F.col("from_file") == F.col("own_file")), F.lit(False))).alias("_kept"))
    reason = F.when(F.col("_noted") > 0, F.concat(F.col("_noted").cast("string"), F.lit(" references exist but none resolved to active call edges"))).otherwise("No callers found anywhere in the codebase")
    return out.join(n, "id", "left").where(~F.coalesce("_kept", F.lit(False))).withColumn("reason", reason).select(*functions.columns, "reason")


def dead_classes(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes (id, name, file, module_id, is_exported) that no edge (src, dst, type) calls or
    imports and that are not exported."""
    used = edges.where(F.col("type").isin("calls", "imports")).select(F.col("dst").alias("id")).distinct()
    out = classes.join(used, "id", "left_anti").where(~F.coalesce("is_exported", F.lit(False)))
    return out.withColumn("reason", F.lit("Class has no callers or importers and is not exported"))


def dead_by_module(functions: DataFrame, found: DataFrame) -> DataFrame:
    """Per module: dead, total, and the share in percent with one decimal."""
    d = found.groupBy("module_id").agg(F.count("*").alias("dead"))
    t = functions.groupBy("module_id").agg(F.count("*").alias("total"))
    return t.join(d, "module_id", "left").select("module_id", F.coalesce("dead", F.lit(0)).alias("dead"), "total", (F.round(F.coalesce("dead", F.lit(0)) / F.col("total") * 1000) / 10).alias("percent"))


def fan(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) of every node of an edge."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def with_modules(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes, with the modules of both.

    The second join keeps the number of shuffle partitions: joined to fewer, as adaptive execution
    does while they are small when compressed, a task would sort and tell apart many times as many.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = nodes.select(F.col("id").alias("src"), F.col("module_id").alias("from_module"))
    b = nodes.select(F.col("id").alias("dst"), F.col("module_id").alias("to_module"))
    return edges.join(a, "src").repartition(n, "dst").join(b, "dst").select("src", "dst", "from_module", "to_module")


def cross_calls(moded: DataFrame) -> DataFrame:
    return moded.where("from_module <> to_module").groupBy("from_module", "to_module").agg(F.count("*").alias("calls"))


def module_health(moded: DataFrame, nodes: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Per module: cohesion, coupling, size and 0.6 cohesion + 0.4 min(1, 10 / size), over calls
    and, if given, file imports, both with the modules of their ends."""
    both = moded.select("from_module", "to_module")
    both = both if imports is None else both.unionByName(imports.select("from_module", "to_module"))
    calls = both.groupBy(F.col("from_module").alias("module_id")).agg(F.count_if(F.col("from_module") == F.col("to_module")).alias("internal"), F.count_if(F.col("from_module") != F.col("to_module")).alias("external"))
    size = nodes.groupBy("module_id").agg(F.count("*").alias("functions"))
    t = size.join(calls, "module_id", "left").fillna(0, ["internal", "external"])
    cohesion = F.when(F.col("internal") + F.col("external") == 0, 0.5).otherwise(F.try_divide(F.col("internal").cast("double"), F.col("internal") + F.col("external")))
    t = t.withColumn("cohesion", cohesion)
    return t.select("module_id", "functions", F.col("external").alias("coupling"), F.round("cohesion", 6).alias("cohesion"), F.round(F.col("cohesion") * 0.6 + F.least(F.lit(1.0), 10.0 / F.col("functions")) * 0.4, 6).alias("health"))


def violations(moded: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges that break a rule (ord, kind, from_module, to_modules); of several the first counts.

    Rules are what people declare and go to every task: dealt by module, a task would hold all
    edges of one.
    """
    r = rules.where("kind IS NOT NULL").select("ord", "kind", F.col("from_module").alias("fm"), "to_modules")
    named = [x["fm"] for x in r.select("fm").distinct().collect()]  # as declared
    e = moded.where("from_module <> to_module").where(F.lower("from_module").isin(named))
    broken = (F.col("kind") == "deny") & F.array_contains("to_modules", F.lower("to_module")) | (F.col("kind") == "allow_only") & ~F.array_contains("to_modules", F.lower("to_module")) | (F.col("kind") == "isolated")
    hit = e.join(F.broadcast(r), (F.lower("from_module") == F.col("fm")) & broken)
    first = hit.groupBy("src", "dst", "from_module", "to_module").agg(F.min("ord").alias("rule"))
    kinds = r.select(F.col("ord").alias("rule"), "kind").dropDuplicates(["rule"])
    return first.join(F.broadcast(kinds), "rule").select("src", "dst", "from_module", "to_module", "kind", "rule")


def summary_of(broken: DataFrame) -> DataFrame:
    """One row: how many calls break rules, how many rules are broken, and whether none is."""
    return broken.agg(F.count("*").alias("errors"), F.count_distinct("rule").alias("rules_broken"), (F.count("*") == 0).alias("pass"))


def name_pairs(moded: DataFrame, functions: DataFrame) -> DataFrame:
    """(from_module, to_module, name_pairs): distinct pairs of names that call across modules."""
    n = functions.select("id", "name")
    t = moded.where("from_module <> to_module").join(n.toDF("src", "a"), "src").join(n.toDF("dst", "b"), "dst")
    return t.groupBy("from_module", "to_module").agg(F.count_distinct(F.struct("a", "b")).alias("name_pairs"))


def file_connectivity(edges: DataFrame, nodes: DataFrame, most: int = 25) -> DataFrame:
    """(file, n): the files with most ends of edges in them; nodes (id, file)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.join(nodes.select("id", "file"), "id").groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(most)


def module_dependencies(moded: DataFrame) -> DataFrame:
    """(from_module, to_module): which module depends on which, once."""
    return moded.where("from_module <> to_module").select("from_module", "to_module").distinct()


def public_api(moded: DataFrame) -> DataFrame:
    """Nodes with a caller in another module."""
    return moded.where("from_module <> to_module").select(F.col("dst").alias("id"), F.col("to_module").alias("module_id")).distinct()


def coupling(edges: DataFrame, nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """(a, b, pairs, score) for files a < b: 2 pairs / (degree a + degree b).

    Pairs counts the call and import edges (src, dst) between two files, both ways; nodes (id,
    file) tell the file of an end (a file is its own).  Degrees (file, n) count the edges of the
    file itself, so calls count in pairs only and a score may pass 1; a file without any counts 1.
    """
    of = lambda side, name: nodes.select(F.col("id").alias(side), F.col("file").alias(name))
    e = edges.join(of("src", "fa"), "src").join(of("dst", "fb"), "dst").where("fa <> fb")
    pairs = e.groupBy(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).agg(F.count("*").alias("pairs"))
    n = lambda side: degrees.select(F.col("file").alias(side), F.greatest("n", F.lit(1)).alias(f"n{side}"))
    t = pairs.join(n("a"), "a", "left").join(n("b"), "b", "left").fillna(1, ["na", "nb"])
    return t.select("a", "b", "pairs", F.round(2.0 * F.col("pairs") / (F.col("na") + F.col("nb")), 6).alias("score"))


def cluster_confidence(moded: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per module of the nodes: the share of its outgoing edges that stay inside, 0.5 without any."""
    out = moded.groupBy(F.col("from_module").alias("module_id")).agg((F.count_if(F.col("from_module") == F.col("to_module")) / F.count("*")).alias("c"))
    return nodes.select("module_id").distinct().join(out, "module_id", "left").select("module_id", F.round(F.coalesce("c", F.lit(0.5)), 6).alias("confidence"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(id): nodes from which a cycle can be reached.

    Edges into nodes without an outgoing edge are peeled off; when a round peels none, all that is
    left reaches a cycle.  A node with one outgoing edge shares the fate of its target, so edges
    into it are led on to that target: chains halve in each round instead of losing one link.
    """
    e = cut(edges.select("src", "dst").distinct())
    n = e.count()
    while n:
        left = cut(e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        m = left.count()
        if m == n:
            break
        single = left.groupBy("src").agg(F.count("*").alias("k"), F.min("dst").alias("next")).where("k = 1 AND next <> src")
        led = left.join(single.select(F.col("src").alias("dst"), "next"), "dst", "left")
        e = cut(led.select("src", F.coalesce("next", "dst").alias("dst")).distinct())
        n = e.count()
    return e.select(F.col("src").alias("id")).distinct()


def cycle_of(calls: DataFrame, start: str, most: int = 64) -> list[str] | None:
    """The ids of a cycle that ``start`` reaches, closed by its first id again, or None.

    Only what lies on cycles is walked: from the start to the nearest node on one, and along one
    shortest way back to it; both are breadth-first searches of at most ``most`` steps.
    """
    core = cut(calls.join(on_cycles(calls).select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
    reached = bfs(core, core.sparkSession.createDataFrame([(start,)], "id string"), most=most, reverse=False)
    near = [r["id"] for r in reached.orderBy("depth", "id").limit(2 * most).collect()]
    for at in near:  # a step on from a node, back to it
        to = core.where(F.col("src") == at).select(F.col("dst").alias("id"))
        depths = bfs(core, to, most=most, reverse=False)
        if (end := depths.where(F.col("id") == at).first()) is None:
            continue
        way, node = [at], at
        levels = depths.withColumnRenamed("id", "src")
        for depth in range(end["depth"] - 1, -1, -1):
            node = core.where(F.col("dst") == node).join(levels.where(F.col("depth") == depth), "src").agg(F.min("src")).first()[0]
            way.append(node)
        return [at, *way[:0:-1], at]
    return None


def important(functions: DataFrame, moded: DataFrame, most: int = 40, least: int = 10) -> DataFrame:
    """What a diagram of a module shows: all functions of a module of at most ``most``; of larger
    ones those that are entries, cross modules or are exported, by connections; and where these
    are fewer than ``least``, the most connected others too."""
    f = fan(moded.select("src", "dst"))
    crossing = moded.where("from_module <> to_module").select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("cross", F.lit(True))
    t = functions.join(f, "id", "left").join(crossing, "id", "left").fillna(0, ["fan_in", "fan_out"])
    t = t.withColumn("own", (F.col("fan_in") == 0) | F.col("cross").isNotNull() | F.coalesce("is_exported", F.lit(False))).withColumn("n", F.col("fan_in") + F.col("fan_out"))
    module = Window.partitionBy("module_id")
    t = t.withColumn("place", F.row_number().over(module.orderBy(F.desc("own"), F.desc("n"), "id"))).withColumn("size", F.count("*").over(module)).withColumn("owns", F.sum(F.col("own").cast("int")).over(module))
    few = F.col("owns") < F.least(F.lit(least), F.col("size"))
    t = t.where((F.col("size") <= most) | ((F.col("place") <= most) & (F.col("own") | few)))
    return t.select("module_id", "id", F.col("n").alias("connections"), F.row_number().over(module.orderBy(F.desc("n"), "id")).alias("rank"))


def trace(edges: dict[str, list[str]], start: str, most: int = 5) -> list[tuple[str, str, str]]:
    """Depth-first call flow of one entry point: (kind, caller, callee) on call and return."""
    seen, out = {start}, []

    def walk(at: str, depth: int) -> None:
        for to in edges.get(at, []) if depth < most else []:
            out.append(("call", at, to))
            if to not in seen:
                seen.add(to)
                walk(to, depth + 1)
            out.append(("return", to, at))

    walk(start, 0)
    return out
