"""Scalar functions over identifiers, paths, rules and texts, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the prompt keywords, of the context keywords, of conflicts and of the intents.
PROMPT_STOP = """the a an in on at to for of and or is it fix add update change modify make create bug issue error problem feature function file code new old all this that from with move remove delete refactor should can will must need want""".split()
CONTEXT_STOP = """a an the and or for in on of to how does do is are add new create make update fix get set this that with from what where when why should can will need want like just also some all any my your""".split()
CONFLICT_STOP = """the a an in on at to for of and or is are was be not no from with all must should can cannot will this that""".split()
INTENT_STOP = """the a an in on at to for of and or is are was be not no from with add create modify change update delete remove fix move refactor new old all this that should can will must need want please function method class module file package endpoint route handler component service""".split()


def words_of(name: Column, keep_dots: bool = True, digits: bool = False, lower: bool = False, least: int = 1) -> Column:
    """Words of a camel-case, snake-case or dashed identifier; empty ones are dropped."""
    low = "a-z0-9" if digits else "a-z"
    s = F.regexp_replace(name, f"([{low}])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    w = F.split(s, r"[\s_-]+" if keep_dots else r"[\s_.-]+")
    if lower:
        w = F.transform(w, F.lower)
    return F.filter(w, lambda x: F.char_length(x) >= least)


def keywords(text: Column, stop: list[str] = PROMPT_STOP, marks: str = "") -> Column:
    """Words of three characters and more that are no stop words; ``marks`` are kept in words."""
    w = F.split(F.regexp_replace(F.lower(text), rf"[^a-z0-9\s{marks}]", " "), r"\s+")
    return F.filter(w, lambda x: (F.char_length(x) > 2) & ~F.array_contains(F.lit(stop), x))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 4).cast("long")


def glob_regex(pattern: str, compatible: bool = False) -> str:
    """The regular expression of a path glob: ** for any depth, * within a segment.

    ``compatible`` reproduces a known quirk: there a trailing ** matches one segment only, and
    other characters than the dot act as in a regular expression.
    """
    if compatible:
        s = pattern.replace("\\", "/").replace(".", "\\.").replace("**/", "(?:.+/)?").replace("**", ".*")
        return "^" + s.replace("*", "[^/]*") + "$"
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*)", pattern.replace("\\", "/")):
        out += {"**/": "(?:.+/)?", "**": ".*", "*": "[^/]*"}.get(part, re.escape(part) if part else "")
    return f"^{out}$"


def capitalise(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.char_length(s)))


# Leading verbs of names and how a purpose is phrased from them; result types of
# components; parameters that tell nothing.
HOOKS, HANDLERS, GETTERS, SETTERS, CHECKERS = ["use"], ["handle", "on"], ["get", "fetch", "load", "find", "query", "read", "retrieve"], ["set", "update", "save", "write", "put", "store"], ["is", "has", "can", "should", "check", "validate"]
COMPONENT_TYPES = ["jsx.element", "react.reactnode", "reactnode", "react.jsx.element", "react.fc", "reactelement"]
PLAIN_PARAMS = ["e", "event", "ctx", "props", "args", "_"]


def purpose(name: Column, params: Column | None = None, return_type: Column | None = None) -> Column:
    """A readable purpose from a name: component, hook, handler, getter, setter, checker or plain
    words, the last five with up to three telling parameters (structs with a name) in brackets."""
    w = words_of(name, digits=True, lower=True)
    first, rest = F.try_element_at(w, F.lit(1)), F.array_join(F.slice(w, 2, 1000), " ")
    among = lambda xs: F.array_contains(F.lit(xs), first)
    base = (
        F.when(among(HANDLERS), F.concat(F.lit("Handle "), rest))
        .when(among(GETTERS) | among(SETTERS), F.concat(capitalise(first), F.lit(" "), rest))
        .when(among(CHECKERS), F.regexp_replace(F.concat(F.lit("Check "), F.when(first.isin("is", "has", "can"), "if").otherwise(""), F.lit(" "), rest), "  +", " "))
        .otherwise(capitalise(F.array_join(w, " ")))
    )
    if params is not None:
        told = F.filter(F.transform(params, lambda p: p["name"]), lambda n: ~n.isin(PLAIN_PARAMS))
        base = F.concat(base, F.when(F.size(params).between(1, 3) & (F.size(told) > 0), F.concat(F.lit(" ("), F.array_join(told, ", "), F.lit(")"))).otherwise(""))
    out = F.when(among(HOOKS) & (F.size(w) > 1), F.concat(F.lit("Hook for "), rest)).otherwise(base)
    if return_type is not None:
        component = F.rlike(name, F.lit("^[A-Z]")) & F.coalesce(F.lower(return_type).isin(COMPONENT_TYPES), F.lit(False))
        out = F.when(component, F.concat(capitalise(F.array_join(w, " ")), F.lit(" component"))).otherwise(out)
    return F.trim(out)


# Languages by file extension.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "cs": "csharp", "swift": "swift", "dart": "dart", "ex": "elixir", "exs": "elixir"}


def language_of_extension(ext: Column) -> Column:
    """The language of a file extension; an unknown extension is its own."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, ext), ext)


# The phrases that tell the class of a constraint, below, in order.
def constraint_class(text: Column) -> Column:
    """The class of a free-text constraint; the first that fits."""
    low = F.lower(text)
    has = lambda *xs: _any([F.contains(low, F.lit(x)) for x in xs])
    return (
        F.when(has("no direct", "cannot import", "must not import"), "no-import")
        .when(has("must go through", "must use", "required"), "must-use")
        .when(has("never call", "do not call"), "no-call")
        .when(has("cannot import from", "layer"), "layer")
        .when(has("must be") & has("case", "named"), "naming")
        .otherwise("complex")
    )


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


# The grammar of boundary rules.
DENY, ALLOW, ISOLATED = r"^module:(\S+)\s+cannot\s+import\s+(.+)$", r"^module:(\S+)\s+can\s+only\s+import\s+(.+)$", r"^module:(\S+)\s+(has\s+no\s+imports|is\s+isolated)$"


def rule_kind(raw: Column) -> Column:
    """deny, allow_only, isolated, or null for text outside the rule grammar."""
    c = F.lower(F.trim(raw))
    return F.when(F.rlike(c, F.lit(DENY)), "deny").when(F.rlike(c, F.lit(ALLOW)), "allow_only").when(F.rlike(c, F.lit(ISOLATED)), "isolated")


def rule_from(raw: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(raw)), r"^module:(\S+)\s", 1)


def rule_to(raw: Column) -> Column:
    """The modules that a rule names on its right side."""
    c = F.lower(F.trim(raw))
    listed = F.when(F.rlike(c, F.lit(DENY)), F.regexp_extract(c, DENY, 2)).when(F.rlike(c, F.lit(ALLOW)), F.regexp_extract(c, ALLOW, 2)).otherwise("")
    return F.filter(F.transform(F.split(listed, ","), lambda x: F.regexp_replace(F.trim(x), "module:", "")), lambda x: x != "")


# How a path tells the category of a context file; the first that fits.
CONTEXT_KINDS = [
    (["prisma/schema", "drizzle/", ".schema."], [".prisma", ".graphql", ".gql", ".avsc", ".thrift", "db/schema.rb", "schema.rs"], [], "schema"),
    (["openapi", "swagger"], [".proto"], [], "api-spec"),
    (["db/migrate/", "alembic/"], [], [("migration", ".sql")], "migration"),
    ([], [".sql"], [], "schema"),
    (["/models/", "/model/", "/entity/", "/dto/", "/entities/"], [".model.ts", ".model.js", ".model.go", "models.py", "serializers.py", "schemas.py", "_model.go", "models.rs"], [], "model"),
    (["/types/", "/interfaces/"], ["/types.ts", "/types.js"], [], "types"),
    (["/routes/", "router."], [], [], "routes"),
    (["docker"], [], [], "docker"),
]


def context_kind(path: Column) -> Column:
    low, out = F.lower(path), None
    for inside, ends, both, kind in CONTEXT_KINDS:
        tests = [F.contains(low, F.lit(x)) for x in inside] + [F.endswith(low, F.lit(x)) for x in ends] + [F.contains(low, F.lit(a)) & F.endswith(low, F.lit(b)) for a, b in both]
        if kind == "types":
            tests += [F.startswith(low, F.lit(x)) for x in ("types/", "interfaces/")]
        out = F.when(_any(tests), kind) if out is None else out.when(_any(tests), kind)
    return out.otherwise("config")


def intent_actions(prompt: Column) -> Column:
    """Actions that a prompt asks for, by substring; modify where none is found."""
    low = F.lower(prompt)
    # Verbs of each action.
    verbs = [("create", "add create new implement"), ("modify", "modify change update fix edit patch"), ("delete", "delete remove drop"), ("refactor", "refactor|restructure|clean up|reorganize"), ("move", "move migrate relocate")]
    found = [F.when(_any([F.contains(low, F.lit(v)) for v in (vs.split("|") if "|" in vs else vs.split())]), F.lit(a)) for a, vs in verbs]
    got = F.array_compact(F.array(*found))
    return F.when(F.size(got) > 0, got).otherwise(F.array(F.lit("modify")))


def target_type(prompt: Column) -> Column:
    low = F.lower(prompt)
    has = lambda *xs: _any([F.contains(low, F.lit(x)) for x in xs])
    return F.when(has("function", "method"), "function").when(has("class"), "class").when(has("module", "package"), "module").otherwise("file")


def camel_case(s: Column) -> Column:
    """Words joined in camel case."""
    w = F.filter(F.split(F.lower(s), r"[^a-z0-9]+"), lambda x: x != "")
    return F.concat(F.coalesce(F.try_element_at(w, F.lit(1)), F.lit("")), F.array_join(F.transform(F.slice(w, 2, 1000), capitalise), ""))


def identifier(s: Column) -> Column:
    """Characters other than letters, digits and _ become _."""
    return F.regexp_replace(s, "[^a-zA-Z0-9_]", "_")


def xml_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def one_line(s: Column) -> Column:
    """Runs of white space become one blank; used for type annotations as well."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def dir_segments(path: Column, most: int = 3) -> Column:
    """The first directories of a path, without src, joined by dashes."""
    parts = F.split(path, "/")
    dirs = F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: (x != "") & (x != "src"))
    return F.array_join(F.slice(dirs, 1, most), "-")


def entity_key(key: Column) -> Column:
    """(kind, file, name) of an id kind:file:name; the name follows the last colon."""
    kind = F.substring_index(key, ":", 1)
    name = F.substring_index(key, ":", -1)
    body = F.substring(key, F.char_length(kind) + 2, F.char_length(key))
    file = F.when(F.contains(body, F.lit(":")), F.substring(body, F.lit(1), F.char_length(body) - F.char_length(name) - 1)).otherwise("")
    return F.struct(kind.alias("kind"), file.alias("file"), name.alias("name"))


def depth_score(depth: Column) -> Column:
    """Relevance by distance from the focus."""
    return F.when(depth <= 1, 1.0).when(depth == 2, 0.6).when(depth == 3, 0.35).when(depth.isNotNull(), 0.15)


def dedent(text: Column) -> Column:
    """The text without the indentation that all its non-blank lines share."""
    lines = F.split(text, "\n")
    full = F.filter(lines, lambda x: F.trim(x) != "")
    n = F.coalesce(F.array_min(F.transform(full, lambda x: F.char_length(x) - F.char_length(F.ltrim(x)))), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.when(F.trim(x) == "", "").otherwise(F.substring(x, n + 1, F.char_length(x)))), "\n")


def lines_between(text: Column, first: int, last: int) -> Column:
    """Lines first..last, counted from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


def lines_between_columns(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last of a text, counted from 1, by columns; null where any is null."""
    return F.when((first >= 1) & (last >= first), F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n"))


def title_case(s: Column) -> Column:
    return F.initcap(F.regexp_replace(s, "[-_]", " "))


def quick_hash(content: Column) -> Column:
    """The first 16 digits of the digest of the first 8 KiB (bytes) of a content."""
    return F.left(F.sha2(F.substring(content.cast("binary"), 1, 8192), 256), F.lit(16))


def signature(name: Column, params: Column, return_type: Column, is_async: Column, is_exported: Column | None = None, optional: bool = True) -> Column:
    """async name(a: T, b?: U): R of a function."""
    one = lambda p: F.concat(p["name"], F.when(F.coalesce(p["optional"], F.lit(False)), "?").otherwise("") if optional else F.lit(""), F.lit(": "), F.coalesce(p["type"], F.lit("any")))
    ret = F.when(F.coalesce(return_type, F.lit("")) != "", F.concat(F.lit(": "), return_type)).otherwise("")
    head = F.when(F.coalesce(is_async, F.lit(False)), "async ").otherwise("")
    if is_exported is not None:
        head = F.concat(F.when(F.coalesce(is_exported, F.lit(False)), "export ").otherwise(""), head)
    return F.concat(head, name, F.lit("("), F.coalesce(F.array_join(F.transform(params, one), ", "), F.lit("")), F.lit(")"), ret)
