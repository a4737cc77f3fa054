"""Formats of a task's context for language models: tagged, plain and compact text.

A format is a function (Context) -> DataFrame with one row (report); register() adds others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S

#: Characters of a context file that a format shows.
SHOWN = {"tagged": 2000, "plain": 2000, "compact": 1500}


@dataclass
class Context:
    """What a budget left of a project for a task.

    functions (place, id, name, file, start_line, end_line, module_id, params, return_type,
    is_async, is_exported, purpose, calls, called_by, edge_cases, error_handling, and body where
    bodies are wanted), modules (id, name, description, intent), routes, files (path, type,
    size, priority, text), and texts: project, constraints, decisions and counts.
    """

    functions: DataFrame
    modules: DataFrame
    task: str
    keywords: list[str]
    name: str = ""
    language: str = ""
    description: str = ""
    routes: DataFrame | None = None
    files: DataFrame | None = None
    constraints: list[str] = field(default_factory=list)
    decisions: list[tuple[str, str]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _list(c: str) -> Column:
    return F.coalesce(F.array_join(F.col(c), ", "), F.lit(""))


def _body(df: DataFrame) -> Column:
    return F.col("body") if "body" in df.columns else F.lit(None).cast("string")


def _errors() -> Column:
    return F.coalesce(F.array_join(F.transform("error_handling", lambda e: F.concat(e["type"], F.lit(" at line "), e["line"].cast("string"), F.lit(": "), F.coalesce(e["detail"], F.lit("")))), "; "), F.lit(""))


def _lines(*parts: Column) -> Column:
    """The parts that are not null, one below the other."""
    return F.concat_ws("\n", *parts)


def _sections(c: Context, entry: Column, head: Column, foot: Column | None = None) -> DataFrame:
    """(order, text): a section for each module, those of most functions first, entries by place."""
    own = c.functions.select("module_id", "place", entry.alias("entry")).groupBy("module_id").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"]), "\n").alias("entries"))
    t = own.join(c.modules.select(F.col("id").alias("module_id"), "name", "description", "intent"), "module_id", "left").withColumn("name", F.coalesce("name", "module_id"))
    text = _lines(head, F.col("entries"), *([] if foot is None else [foot]))
    return t.select(F.struct((-F.col("n")).alias("n"), "first").alias("order"), F.concat(text, F.lit("\n")).alias("text"))


def _joined(df: DataFrame, order: Column, text: Column, sep: str = "\n") -> Column:
    """The texts of a small table in order, as a literal."""
    row = df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), sep)).first()  # one row
    return F.lit(row[0] or "")


def _report(c: Context, before: str, sections: DataFrame, after: list[Column | str]) -> DataFrame:
    body = sections.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), "\n").alias("body"))  # what fits a budget
    return body.select(F.concat_ws("\n", F.lit(before), "body", *[F.lit(x) if isinstance(x, str) else x for x in after]).alias("report"))


def _shown(most: int) -> Column:
    return F.when(F.char_length("text") > most, F.concat(F.left("text", F.lit(most)), F.lit("\n... (truncated)"))).otherwise(F.rtrim("text"))


def plain(c: Context) -> DataFrame:
    """Headed sections of plain text: routes, schemas, modules with signatures, constraints."""
    sig = S.signature(F.col("name"), F.col("params"), F.col("return_type"), F.col("is_async"), F.col("is_exported"))
    place = F.concat(F.lit("  "), sig, F.lit("  "), "file", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.when(F.size("calls") > 0, F.concat(F.lit(" → ["), _list("calls"), F.lit("]"))).otherwise(""), F.when(F.size("called_by") > 0, F.concat(F.lit(" ← called by ["), _list("called_by"), F.lit("]"))).otherwise(""))
    body = _body(c.functions)
    entry = _lines(place, F.when(_some(F.col("purpose")), F.concat(F.lit("    purpose: "), "purpose")), F.when(F.size("edge_cases") > 0, F.concat(F.lit("    edge cases: "), F.array_join("edge_cases", "; "))), F.when(F.size("error_handling") > 0, F.concat(F.lit("    error handling: "), _errors())), F.when(_some(body), F.concat(F.lit("    ```\n"), body, F.lit("\n    ```"))))
    head = _lines(F.concat(F.lit("--- Module: "), "name", F.lit(" ("), "module_id", F.lit(") ---")), F.when(_some(F.col("description")), F.col("description")), F.when(_some(F.col("intent")), F.concat(F.lit("Intent: "), "intent")), F.lit(""))
    before = ["=== ARCHITECTURAL CONTEXT ===", f"Project: {c.name} ({c.language})", *([f"Description: {c.description}"] if c.description else []), f"Task: {c.task}", ""]
    parts: list[Column] = []
    if c.routes is not None and not c.routes.isEmpty():
        route = F.concat(F.lit("  "), "method", F.lit(" "), "path", F.lit(" → "), "handler", F.when(F.size("middlewares") > 0, F.concat(F.lit(" ["), _list("middlewares"), F.lit("]"))).otherwise(""), F.lit("  ("), "file", F.lit(":"), F.col("line").cast("string"), F.lit(")"))
        parts += [F.lit("=== HTTP ROUTES ==="), _joined(c.routes, F.struct("file", "line"), route), F.lit("")]
    if c.files is not None and not c.files.isEmpty():
        parts += [F.lit("=== DATA MODELS & SCHEMAS ==="), _joined(c.files, F.struct("priority", "path"), _lines(F.concat(F.lit("--- "), "path", F.lit(" ("), "type", F.lit(") ---")), _shown(SHOWN["plain"]), F.lit("")))]
    after = []
    if c.constraints:
        after += ["=== CONSTRAINTS (MUST follow) ===", *[f"  • {x}" for x in c.constraints], ""]
    if c.decisions:
        after += ["=== ARCHITECTURAL DECISIONS ===", *[f"  • {t}: {r}" for t, r in c.decisions], ""]
    out = _report(c, "", _sections(c, entry, head), after)
    return out.select(F.concat_ws("\n", F.lit("\n".join(before)), *parts, F.substring("report", F.lit(2), F.char_length("report"))).alias("report"))


def compact(c: Context) -> DataFrame:
    """A line for each function, no prose."""
    sig = S.signature(F.col("name"), F.col("params"), F.col("return_type"), F.col("is_async"), None, False)
    body = _body(c.functions)
    line = F.concat(F.lit("  "), sig, F.lit(" ["), "file", F.lit(":"), F.col("start_line").cast("string"), F.lit("]"), F.when(F.size("calls") > 0, F.concat(F.lit(" → "), F.array_join("calls", ","))).otherwise(""))
    entry = _lines(line, F.when(_some(body), F.concat(F.lit("  ```\n"), body, F.lit("\n  ```"))))
    before = f"# {c.name} ({c.language})\nTask keywords: {', '.join(c.keywords)}\n"
    after: list[Column | str] = []
    if c.files is not None and not c.files.isEmpty():
        after += ["## Schemas & Data Models", _joined(c.files, F.struct("priority", "path"), _lines(F.concat(F.lit("### "), "path", F.lit(" ("), "type", F.lit(")")), _shown(SHOWN["compact"]), F.lit("")))]
    if c.routes is not None and not c.routes.isEmpty():
        after += ["## Routes", _joined(c.routes, F.struct("file", "line"), F.concat(F.lit("  "), "method", F.lit(" "), "path", F.lit(" → "), "handler", F.lit(" ("), "file", F.lit(":"), F.col("line").cast("string"), F.lit(")"))), ""]
    if c.constraints:
        after.append("CONSTRAINTS: " + " | ".join(c.constraints))
    return _report(c, before, _sections(c, entry, F.concat(F.lit("## "), "name")), after)


def tagged(c: Context, tag: str = "project_context") -> DataFrame:
    """Elements and attributes, escaped, with counts of what was selected."""
    import html

    esc = lambda x: html.escape(x or "").replace("&#x27;", "'")
    at = lambda n, v: F.when(_some(v), F.concat(F.lit(f' {n}="'), S.xml_escape(v), F.lit('"'))).otherwise("")
    params = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.when(F.coalesce(p["optional"], F.lit(False)), "?").otherwise(""), F.lit(": "), F.coalesce(p["type"], F.lit("any")))), ", ")
    body = _body(c.functions)
    open_ = F.concat(F.lit('    <fn name="'), S.xml_escape(F.col("name")), F.lit('" file="'), S.xml_escape(F.col("file")), F.lit('" lines="'), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit('"'), F.when(F.coalesce("is_async", F.lit(False)), ' async="true"').otherwise(""), F.when(F.coalesce("is_exported", F.lit(False)), ' exported="true"').otherwise(""), at("params", params), at("returns", F.col("return_type")), at("calls", F.array_join("calls", ",")), at("calledBy", F.array_join("called_by", ",")), F.lit(">"))
    inner = lambda n, v: F.when(_some(v), F.concat(F.lit(f"      <{n}>"), S.xml_escape(v), F.lit(f"</{n}>")))
    entry = _lines(open_, inner("purpose", F.col("purpose")), inner("edge_cases", F.array_join("edge_cases", "; ")), inner("error_handling", _errors()), inner("body", body), F.lit("    </fn>"))
    head = _lines(F.concat(F.lit('<module id="'), S.xml_escape(F.col("module_id")), F.lit('" name="'), S.xml_escape(F.col("name")), F.lit('">')), F.concat(F.lit("  <description>"), S.xml_escape(F.coalesce("description", F.lit(""))), F.lit("</description>")), F.when(_some(F.col("intent")), F.concat(F.lit("  <intent>"), S.xml_escape(F.col("intent")), F.lit("</intent>"))), F.lit("  <functions>"))
    n = c.counts
    before = [f"<{tag}>", f'<project name="{esc(c.name)}" language="{esc(c.language)}">', f"  <description>{esc(c.description)}</description>", f'  <stats modules="{n.get("modules", 0)}" functions="{n.get("functions", 0)}"/>', "</project>", "", "<context_meta>", f"  <task>{esc(', '.join(c.keywords))}</task>", f"  <seeds_found>{n.get('seeds', 0)}</seeds_found>", f"  <functions_selected>{n.get('selected', 0)} of {n.get('functions', 0)}</functions_selected>", f"  <estimated_tokens>{n.get('tokens', 0)}</estimated_tokens>", "</context_meta>", ""]
    after: list[Column | str] = []
    if c.files is not None and not c.files.isEmpty():
        after += ["<context_files>", _joined(c.files, F.struct("priority", "path"), _lines(F.concat(F.lit('  <file path="'), S.xml_escape(F.col("path")), F.lit('" type="'), "type", F.lit('">')), S.xml_escape(_shown(SHOWN["tagged"])), F.lit("  </file>"))), "</context_files>", ""]
    if c.routes is not None and not c.routes.isEmpty():
        route = F.concat(F.lit('  <route method="'), "method", F.lit('" path="'), S.xml_escape(F.col("path")), F.lit('" handler="'), S.xml_escape(F.col("handler")), F.lit('" file="'), S.xml_escape(F.col("file")), F.lit('" line="'), F.col("line").cast("string"), F.lit('"'), at("middlewares", F.array_join("middlewares", ",")), F.lit("/>"))
        after += ["<routes>", _joined(c.routes, F.struct("file", "line"), route), "</routes>", ""]
    if c.constraints:
        after += ["<constraints>", *[f"  <constraint>{esc(x)}</constraint>" for x in c.constraints], "</constraints>", ""]
    if c.decisions:
        after += ["<architectural_decisions>", *[f'  <decision title="{esc(t)}">{esc(r)}</decision>' for t, r in c.decisions], "</architectural_decisions>"]
    return _report(c, "\n".join(before), _sections(c, entry, head, F.lit("  </functions>\n</module>")), [*after, f"</{tag}>"])


#: Formats by name, with the tokens that their readers take at most.
FORMATS: dict[str, tuple[Callable[[Context], DataFrame], int]] = {"tagged": (tagged, 200_000), "plain": (plain, 128_000), "compact": (compact, 16_000)}


def register(name: str, form: Callable[[Context], DataFrame], tokens: int) -> None:
    FORMATS[name.lower()] = form, tokens


def render(context: Context, name: str = "plain") -> DataFrame:
    """One row (report); unknown names are plain."""
    return FORMATS.get(name.lower(), FORMATS["plain"])[0](context)
