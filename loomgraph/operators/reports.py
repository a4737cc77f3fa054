"""Diagrams and text reports built from the analyses; rows are lines of one report in order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S


def lines(df: DataFrame, order: list[Column], line: Column) -> DataFrame:
    """One row with the report: the lines in order.  Reports are capped by their callers."""
    return df.select(F.struct(*order, line.alias("line")).alias("x")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("report"))


def module_diagram(cross: DataFrame) -> DataFrame:
    """A graph of modules; edges carry counts, thick above 10 and dotted up to 3."""
    edge = F.when(F.col("calls") > 10, "==>").when(F.col("calls") > 3, "-->").otherwise("-.->")
    line = F.concat(F.lit("    "), S.identifier(F.col("from_module")), F.lit(" "), edge, F.lit("|"), F.col("calls").cast("string"), F.lit("| "), S.identifier(F.col("to_module")))
    body = lines(cross, [F.col("from_module"), F.col("to_module")], line)
    return body.select(F.concat(F.lit("graph LR\n"), "report").alias("report"))


def health_diagram(health: DataFrame) -> DataFrame:
    """Modules with their health in percent and a class good, fair or poor."""
    mark = F.when(F.col("health") >= 0.7, "good").when(F.col("health") >= 0.4, "fair").otherwise("poor")
    line = F.concat(F.lit("    "), S.identifier(F.col("module_id")), F.lit('["'), "module_id", F.lit(" "), F.round(F.col("health") * 100).cast("int").cast("string"), F.lit('%"]:::'), mark)
    return lines(health, [F.col("module_id")], line).select(F.concat(F.lit("graph TD\n"), "report").alias("report"))


def matrix_table(matrix: DataFrame, row: str) -> DataFrame:
    """A table in Markdown with - on the diagonal; ``matrix`` has columns to_<module>."""
    cols = [c for c in matrix.columns if c != row]
    cells = [F.when(F.col(row) == c.removeprefix("to_"), "-").otherwise(F.col(c).cast("string")) for c in cols]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", row, *cells), F.lit(" |"))
    head = "| module | " + " | ".join(c.removeprefix("to_") for c in cols) + " |\n|" + "---|" * (len(cols) + 1) + "\n"
    return lines(matrix, [F.col(row)], line).select(F.concat(F.lit(head), "report").alias("report"))


def module_summary(functions: DataFrame, entries: DataFrame, keys: DataFrame, budget: int) -> DataFrame:
    """A section for each module (its size, entry points and key functions), largest first, cut
    before the section that would pass the token budget."""
    from .relational import within_budget

    pick = lambda d, n: d.groupBy("module_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ").alias(n))
    t = functions.groupBy("module_id").agg(F.count("*").alias("n")).join(pick(entries, "entries"), "module_id", "left").join(pick(keys, "keys"), "module_id", "left")
    text = F.concat_ws("\n", F.concat(F.lit("## "), "module_id"), F.concat(F.lit("Functions: "), F.col("n").cast("string")), F.concat(F.lit("Entry points: "), "entries"), F.concat(F.lit("Key functions: "), "keys"))
    t = t.withColumn("text", text).withColumn("all", F.lit(1))
    kept = within_budget(t, ["all"], [F.desc("n"), F.col("module_id")], S.estimate_tokens(F.col("text")), budget)
    return lines(kept, [-F.col("n"), F.col("module_id")], F.col("text"))


def _node(c: Column, label: Column, pad: str = "    ") -> Column:
    return F.concat(F.lit(pad), S.identifier(c), F.lit('["'), label, F.lit('"]'))


def _arrow(a: Column, arrow: str, b: Column) -> Column:
    return F.concat(F.lit("    "), a, F.lit(f" {arrow} "), b)


def _stack(parts: list[tuple[int, DataFrame, list[Column], Column]], head: str) -> DataFrame:
    """A report of lines from several tables: in order of the parts, then of their own keys."""
    out = None
    for n, df, order, line in parts:
        key = F.to_json(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])) if order else F.lit("")
        one = df.select(F.lit(n).alias("part"), key.alias("key"), line.alias("line"))
        out = one if out is None else out.unionByName(one)
    return lines(out, [F.col("part"), F.col("key")], F.col("line")).select(F.concat(F.lit(head + "\n"), "report").alias("report"))


def _ends(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls with the names and modules of both ends."""
    f = functions.select("id", "name", "module_id")
    return calls.join(f.toDF("src", "from_name", "from_module"), "src").join(f.toDF("dst", "to_name", "to_module"), "dst")


def module_detail(functions: DataFrame, calls: DataFrame, visible: DataFrame, module: str, name: str | None = None, most_files: int = 15) -> DataFrame:
    """One module's files and functions and their calls.

    ``visible`` (module_id, id) as by graph.important(); functions that it lacks are counted as
    collapsed, and so are files beyond the ``most_files`` with most visible functions.  Calls
    between visible functions are drawn, and calls out of the module to named nodes outside.
    """
    own = functions.where(F.col("module_id") == module)
    seen = own.join(visible.select("id"), "id", "left_semi")
    hidden = own.count() - seen.count()
    entries = calls.select(F.col("dst").alias("id")).distinct().withColumn("called", F.lit(True))
    per = seen.groupBy("file").agg(F.count("*").alias("n"))
    kept = per.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "file"))).where(F.col("place") <= most_files)  # a module's files
    rest = per.join(kept.select("file"), "file", "left_anti").agg(F.count("*").alias("files"), F.sum("n").alias("n")).where("files > 0")
    f = seen.join(kept.select("file", "place"), "file").join(entries, "id", "left")
    icon = F.when(F.col("called").isNull(), "⚡").otherwise("λ")
    files = kept.select("place", F.lit(0).alias("k"), F.lit("").alias("id"), F.concat(F.lit("        subgraph file_"), S.identifier(F.col("file")), F.lit('["📄 '), F.substring_index("file", "/", -1), F.lit('"]')).alias("line"))
    fns = f.select("place", F.lit(1).alias("k"), "id", _node(F.col("id"), F.concat(icon, F.lit(" "), "name"), " " * 12).alias("line"))
    ends = kept.select("place", F.lit(2).alias("k"), F.lit("").alias("id"), F.lit("        end").alias("line"))
    body = files.unionByName(fns).unionByName(ends)
    e = _ends(functions, calls).where(F.col("from_module") == module).join(seen.select(F.col("id").alias("src")), "src", "left_semi")
    inside = e.where(F.col("to_module") == module).join(seen.select(F.col("id").alias("dst")), "dst", "left_semi")
    outside = e.where(F.col("to_module") != module)
    more = f" ({hidden} internal functions collapsed)" if hidden else ""
    head = f'graph TD\n    subgraph mod_{re.sub(r"[^a-zA-Z0-9_]", "_", module)}["📦 Module: {name or module}{more}"]'
    one = functions.sparkSession.range(1)
    return _stack([
        (0, rest, [], F.concat(F.lit('        collapsed_files["📁 +'), F.col("files").cast("string"), F.lit(" more files ("), F.col("n").cast("string"), F.lit(' functions)"]'))),
        (1, body, [F.format_string("%06d", "place"), F.col("k"), F.col("id")], F.col("line")),
        (2, one, [], F.lit("    end")),
        (3, inside, [F.col("src"), F.col("dst")], _arrow(S.identifier(F.col("src")), "-->", S.identifier(F.col("dst")))),
        (4, outside, [F.col("src"), F.col("dst")], F.concat(_arrow(S.identifier(F.col("src")), '-.->|"calls"|', F.concat(F.lit("ext_"), S.identifier(F.col("dst")))), F.lit('["🔗 '), "to_name", F.lit("<br/>("), "to_module", F.lit(')"]'))),
    ], head)


def capsule(functions: DataFrame, calls: DataFrame, module: str, name: str | None = None, most: int = 10) -> DataFrame:
    """What a module offers others: its functions with callers in other modules, these callers,
    and the functions inside (their number beyond ``most``)."""
    own, e = functions.where(F.col("module_id") == module), _ends(functions, calls)
    used = e.where((F.col("to_module") == module) & (F.col("from_module") != module))
    public = own.join(used.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    inner = own.join(public.select("id"), "id", "left_anti")
    n, one = inner.count(), functions.sparkSession.range(1)
    sid = re.sub(r"[^a-zA-Z0-9_]", "_", module)
    few = 0 < n <= most
    return _stack([
        (0, public.limit(1), [], F.lit('        subgraph public["🔓 Public API"]')),
        (1, public, [F.col("id")], _node(F.col("id"), F.col("name"), " " * 12)),
        (2, public.limit(1), [], F.lit("        end")),
        (3, one.where(F.lit(few)), [], F.lit('        subgraph internal["🔒 Internal"]')),
        (4, inner.where(F.lit(few)), [F.col("id")], _node(F.col("id"), F.col("name"), " " * 12)),
        (5, one.where(F.lit(few)), [], F.lit("        end")),
        (6, one.where(F.lit(n > most)), [], F.lit(f'        internal["🔒 {n} internal functions"]')),
        (7, one, [], F.lit("    end")),
        (8, used, [F.col("dst"), F.col("src")], F.concat(F.lit("    ext_"), S.identifier(F.col("src")), F.lit('["'), "from_name", F.lit("<br/>("), "from_module", F.lit(')"] --> '), S.identifier(F.col("dst")))),
        (9, public, [F.col("id")], F.concat(F.lit("    class "), S.identifier(F.col("id")), F.lit(" publicApi"))),
        (10, inner.where(F.lit(few)), [F.col("id")], F.concat(F.lit("    class "), S.identifier(F.col("id")), F.lit(" internalApi"))),
        (11, one.where(F.lit(n > most)), [], F.lit("    class internal internalApi")),
    ], f'graph LR\n    subgraph {sid}["📦 {name or module}"]\n        direction TB')


def impact_diagram(functions: DataFrame, calls: DataFrame, changed: DataFrame, impacted: DataFrame) -> DataFrame:
    """Changed and impacted functions (id) and the calls among them."""
    a, b = changed.select("id").distinct(), impacted.select("id").distinct()
    both = a.unionByName(b).distinct()
    mark = lambda df, icon: functions.join(df, "id", "left_semi").select("id", _node(F.col("id"), F.concat(F.lit(icon + " "), "name", F.lit("<br/>"), "file")).alias("line"))
    among = calls.join(both.withColumnRenamed("id", "src"), "src", "left_semi").join(both.withColumnRenamed("id", "dst"), "dst", "left_semi").distinct()
    cls = lambda df, c: df.select("id", F.concat(F.lit("    class "), S.identifier(F.col("id")), F.lit(f" {c}")).alias("line"))
    i, line = [F.col("id")], F.col("line")
    return _stack([(0, mark(a, "🔴"), i, line), (1, mark(b, "🟠"), i, line), (2, among, [F.col("dst"), F.col("src")], _arrow(S.identifier(F.col("src")), "-->", S.identifier(F.col("dst")))), (3, cls(a, "changed"), i, line), (4, cls(b, "impacted"), i, line)], "graph LR")


def entry_diagram(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions without callers by module, and what they call first."""
    f = functions.join(calls.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    mods = f.select("module_id").distinct()
    rows = mods.select("module_id", F.lit(0).alias("k"), F.lit("").alias("id"), F.concat(F.lit("    subgraph mod_"), S.identifier(F.col("module_id")), F.lit('["📦 '), "module_id", F.lit('"]')).alias("line"))
    rows = rows.unionByName(f.select("module_id", F.lit(1).alias("k"), "id", _node(F.col("id"), F.concat(F.lit("🚀 "), "name", F.lit("<br/>(Entry)")), " " * 8).alias("line")))
    rows = rows.unionByName(mods.select("module_id", F.lit(2).alias("k"), F.lit("").alias("id"), F.lit("    end").alias("line")))
    e = _ends(functions, calls).join(f.select(F.col("id").alias("src")), "src", "left_semi")
    return _stack([(0, rows, [F.col("module_id"), F.col("k"), F.col("id")], F.col("line")), (1, e, [F.col("src"), F.col("dst")], F.concat(_arrow(S.identifier(F.col("src")), "-->", S.identifier(F.col("dst"))), F.lit('["'), "to_name", F.lit('"]')))], "graph TD")


def flow_diagram(functions: DataFrame, calls: DataFrame, start: str, most: int = 5) -> DataFrame:
    """A sequence of calls and returns from one function, depth first, at most ``most`` deep.

    Only what the start reaches within that depth is gathered.
    """
    from .graph import bfs, trace

    spark = functions.sparkSession
    near = bfs(calls, spark.createDataFrame([(start,)], "id string"), most=most, reverse=False)
    f = functions.join(near, "id", "left_semi")
    name = {r["id"]: re.sub(r"[^a-zA-Z0-9_]", "_", f"{r['module_id']}_{r['name']}") for r in f.select("id", "name", "module_id").collect()}
    label = {r["id"]: r["name"] for r in f.select("id", "name").collect()}
    edges: dict[str, list[str]] = {}
    for r in calls.join(f.select(F.col("id").alias("src")), "src", "left_semi").join(f.select(F.col("id").alias("dst")), "dst", "left_semi").orderBy("src", "dst").collect():
        edges.setdefault(r["src"], []).append(r["dst"])
    out = ["sequenceDiagram", ""]
    for kind, a, b in trace(edges, start, most):
        out.append(f"    {name[a]}->>+{name[b]}: {label[a]}() → {label[b]}()" if kind == "call" else f"    {name[a]}-->>-{name[b]}: return")
    if len(out) == 2:
        out.append(f"    Note over {re.sub(r'[^a-zA-Z0-9_]', '_', start)}: No outgoing calls found")
    return spark.createDataFrame([("\n".join(out),)], "report string")


def bodies(functions: DataFrame, files: DataFrame, squeeze: bool = True) -> DataFrame:
    """Functions with their body from files (path, text), long ones (above 15 lines) compressed."""
    from pyspark.sql.functions import pandas_udf

    t = functions.join(files.select(F.col("path").alias("file"), "text"), "file", "left")
    t = t.withColumn("body", S.lines_between_columns(F.col("text"), F.col("start_line"), F.col("end_line"))).drop("text")
    if not squeeze:
        return t
    short = pandas_udf(lambda s: s.map(lambda x: None if x is None else compress_body(x)), "string")
    return t.withColumn("body", F.when(F.col("end_line") - F.col("start_line") + 1 > 15, short("body")).otherwise(F.col("body")))


def compress_body(text: str) -> str:
    """A function body without comments, blank lines and log calls, runs of chained calls
    collapsed and short if-blocks on one line."""
    out: list[str] = []
    for line in re.sub(r"/\*.*?\*/", "", text, flags=re.S).split("\n"):
        s = re.sub(r"(?<!:)//.*$", "", line).rstrip()
        if s.strip() and not re.match(r"\s*console\.\w+\(", s):
            out.append(s)
    i, short = 0, []
    while i < len(out):
        m = re.match(r"^(\s*)if\s*\((.*)\)\s*\{$", out[i])
        if m and i + 2 < len(out) and out[i + 2].strip() == "}":
            short.append(f"{m[1]}if ({m[2]}) {out[i + 1].strip()}")
            i += 3
            continue
        j = i
        while j < len(out) and re.match(r"^\s*\.\w+\(", out[j]):
            j += 1
        if j - i >= 3:
            short.append(re.match(r"\s*", out[i])[0] + "".join(x.strip().split("(")[0] + "(…)" for x in out[i:j]))
            i = j
            continue
        short.append(out[i])
        i += 1
    pad = min((len(s) - len(s.lstrip()) for s in short), default=0)
    return "\n".join(s[pad:] for s in short)
