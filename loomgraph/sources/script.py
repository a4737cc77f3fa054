"""TypeScript and JavaScript: functions, classes, declarations, imports, exports and routes.

A reader of masked text, not a compiler: it covers top-level declarations, class members, both
module systems and router calls.  Nested functions belong to the one around them.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

from .masking import KINDS, Source, split_top

_KEYWORDS = frozenset("if for while switch catch function return typeof await async new throw else do import super constructor require".split())
_CALL = re.compile(r"(?<![\w$.])(new\s+)?([A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$][\w$]*)*)\s*(?:<[\w\s,.\[\]|]*>)?\(")
_FUNCTION = re.compile(r"(?P<lead>(?:export\s+)?(?:default\s+)?)(?P<async>async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*(?P<types><[^(]*>)?\s*(?=\()")
_CONST = re.compile(r"(?P<lead>(?:export\s+)?)(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=]+?)?=\s*(?P<async>async\s+)?(?P<kind>function\b[^(]*|(?P<types><[^(]*>)?(?=\()|(?P<bare>[\w$]+)\s*(?==>))")
_ASSIGNED = re.compile(r"(?:module\.)?exports\.(?P<name>[\w$]+)\s*=\s*(?P<async>async\s+)?(?P<kind>function\b[^(]*|(?=\()|(?P<bare>[\w$]+)\s*(?==>))")
_DEFAULT = re.compile(r"module\.exports\s*=\s*(?P<async>async\s+)?(?P<kind>function\b\s*(?P<name>[\w$]*)\s*|(?=\([^)]*\)\s*=>))")
_CLASS = re.compile(r"(?P<lead>(?:export\s+)?(?:default\s+)?)(?:abstract\s+)?class\s+(?P<name>[\w$]+)\s*(?P<types><[^{]*?>)?[^{]*(?={)")
_METHOD = re.compile(r"(?P<mods>(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*)\*?(?P<name>[\w$]+)\s*(?P<types><[^(]*>)?\s*(?=\()")
_GENERIC = re.compile(r"(?P<lead>(?:export\s+)?(?:default\s+)?(?:declare\s+)?)(?P<kind>interface|type|enum|const|let|var)\s+(?P<name>[\w$]+)\s*(?P<types><[^={]*>)?")
# What counts as a route.
ROUTE_VERBS = ["get", "post", "put", "delete", "patch", "head", "options", "all", "use"]
ROUTE_RECEIVERS = ["app", "router", "server", "route", "api", "express"]
# What a text has to hold for a pattern to be looked for at all, and patterns that go on from a place.
_NEEDED = {_FUNCTION: ["function"], _CONST: ["const", "let", "var"], _ASSIGNED: ["exports"], _DEFAULT: ["exports"], _CLASS: ["class"], _GENERIC: ["interface", "type", "enum", "const", "let", "var"]}
_RESULT = re.compile(r"\s*(?::(?P<ret>(?:[^={;]|=(?!>)|\{[^}]*\})*?))?\s*(?:=>\s*|(?=\{))")
_ARROW = re.compile(r"\s*(?::[^=;{]*(?:\{[^}]*\})?[^=;{]*)?=>")
_OPENS = re.compile(r"\s*(?::[^{;]*(?:\{[^}]*\}[^{;]*)?)?\{")
_GIVEN, _BLOCK, _END = re.compile(r"\s*(?::[^=]*)?="), re.compile(r"\s*\{"), re.compile(r"[;\n]")
_CALLED = re.compile(r"\s*(async\s+)?(function|\()")
_SPACE, _CAMEL, _PREFIX = re.compile(r"\s+"), re.compile(r"([a-z0-9])([A-Z])"), re.compile(r"^(?:@\w+(?:\([^)]*\))?\s*|public\s+|private\s+|protected\s+|readonly\s+)*")
_IF, _LEAVES, _TRY, _THROW = re.compile(r"\bif\s*\("), re.compile(r"\s*\{?\s*(return|throw)\b"), re.compile(r"\btry\s*\{"), re.compile(r"\bthrow\s+")
_BLOCKS, _DECORATOR = re.compile(r"\b(if|for|while|switch|try)\b\s*(?=[({])"), re.compile(r"@(\w+)[^\n]*\n\s*(?=@|$)")
_IMPORT = re.compile(r"^[ \t]*import\s+(?P<type>type\s+)?(?P<what>[^'\"();]*?)\s*(?:from\s*)?['\"](?P<from>[^'\"]+)['\"]", re.M)
_NAMED, _STAR, _WORD = re.compile(r"\{([^}]*)\}"), re.compile(r"\*\s+as\s+([\w$]+)"), re.compile(r"([\w$]+)")
_DYNAMIC = re.compile(r"(?<![\w$.])import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")
_REQUIRE = re.compile(r"(?:(?:const|let|var)\s+(?P<what>\{[^}]*\}|[\w$]+)\s*=\s*)?(?<![\w$.])require\s*\(\s*['\"](?P<from>[^'\"]+)['\"]\s*\)")
_EXPORT = re.compile(r"\bexport\s+(?P<default>default\s+)?(?:declare\s+|abstract\s+|async\s+)*(?P<kind>function\s*\*?|class|interface|type|enum|const|let|var)\s+(?P<name>[\w$]+)")
_EXPORT_DEFAULT = re.compile(r"\bexport\s+default\s+(?!function|class|async|abstract|interface)([\w$]*)")
_EXPORT_LIST = re.compile(r"\bexport\s+(?:type\s+)?\{([^}]*)\}")
_ROUTE = re.compile(rf"(?<![\w$.])(?P<on>{'|'.join(ROUTE_RECEIVERS)})(?:\.[\w$]+)?\.(?P<verb>{'|'.join(ROUTE_VERBS)})\s*(?=\()", re.I)


def _found(pattern: re.Pattern, mask: str) -> Iterator[re.Match]:
    """The places of a pattern, looked for only where one of the words that it needs is there."""
    return pattern.finditer(mask) if any(w in mask for w in _NEEDED[pattern]) else iter(())


def params_of(inner: str) -> list[dict]:
    out = []
    for p in split_top(inner):
        p = _PREFIX.sub("", p)
        left, _, default = _cut(p, "=")
        name, colon, kind = _cut(left, ":")
        out.append({"name": name.rstrip("? ").strip(), "type": _SPACE.sub(" ", kind).strip() if colon else "any", "optional": name.rstrip().endswith("?") or bool(default), "default_value": default.strip() or None})
    return out


def _cut(s: str, mark: str) -> tuple[str, str, str]:
    depth = 0
    for i, c in enumerate(s):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and s[i - 1 : i] != "=":
            depth -= 1
        elif c == mark and depth == 0 and s[i + 1 : i + 2] != ">":
            return s[:i].strip(), mark, s[i + 1 :].strip()
    return s.strip(), "", ""


def calls_in(body: str) -> list[str]:
    found = [m[2].replace("?.", ".") for m in _CALL.finditer(body) if m[2].split(".")[0] not in _KEYWORDS or "." in m[2]]
    return list(dict.fromkeys(found))


def _function(src: Source, name: str, start: int, at: int, exported: bool, is_async: bool, bare: str | None = None, types: str | None = None) -> dict:
    """A function whose parameters open at ``at`` (or are the one bare name)."""
    if bare:
        params, after = [{"name": bare, "type": "any", "optional": False, "default_value": None}], at
    else:
        stop = src.close(at)
        params, after = params_of(src.text[at + 1 : stop]), stop + 1
    arrow = _RESULT.match(src.mask, after)
    ret = src.text[arrow.start("ret") : arrow.end("ret")].strip() if arrow and arrow["ret"] else ("Promise<void>" if is_async else "void")
    body_at = arrow.end() if arrow else after
    if src.mask[body_at : body_at + 1] == "{":
        end = src.close(body_at)
        body = (body_at, end)
    else:  # an expression body ends with its statement
        m = _END.search(src.mask, body_at)
        end = m.start() if m else len(src.mask) - 1
        body = (body_at, end)
    return {
        "id": f"fn:{src.path}:{name}", "name": name, "file": src.path, "start_line": src.line(start), "end_line": src.line(end), "params": params, "return_type": _SPACE.sub(" ", ret), "is_exported": exported, "is_async": is_async,
        "calls": calls_in(src.mask[body[0] : body[1] + 1]), "purpose": src.comment_before(start) or readable(name), "edge_cases": edge_cases(src, *body), "error_handling": errors(src, *body), "blocks": blocks(src, *body), "type_parameters": [x.split()[0] for x in split_top((types or "").strip("<> "))], "end": end,
    }


def readable(name: str) -> str:
    words = _CAMEL.sub(r"\1 \2", name.rsplit(".", 1)[-1]).replace("_", " ").lower().strip()
    return words[:1].upper() + words[1:]


def edge_cases(src: Source, a: int, b: int) -> list[str]:
    """Conditions whose branch returns or throws at once."""
    out = []
    for m in _IF.finditer(src.mask[a:b]):
        at = a + m.end() - 1
        stop = src.close(at)
        if _LEAVES.match(src.mask[stop + 1 : stop + 200]):
            out.append(_SPACE.sub(" ", src.text[at + 1 : stop]).strip())
    return out


def errors(src: Source, a: int, b: int) -> list[dict]:
    out = [{"line": src.line(a + m.start()), "type": "try-catch", "detail": "try-catch block"} for m in _TRY.finditer(src.mask[a:b])]
    for m in _THROW.finditer(src.mask[a:b]):
        stop = _END.search(src.mask, a + m.end())
        out.append({"line": src.line(a + m.start()), "type": "throw", "detail": src.text[a + m.end() : stop.start() if stop else b].strip()})
    return sorted(out, key=lambda x: x["line"])


def blocks(src: Source, a: int, b: int) -> list[dict]:
    out = []
    for m in _BLOCKS.finditer(src.mask[a:b]):
        at = a + m.end()
        stop = src.close(at)
        if src.mask[at] == "(" and (n := _BLOCK.match(src.mask, stop + 1)):
            stop = src.close(n.end() - 1)
        out.append({"start_line": src.line(a + m.start()), "end_line": src.line(stop), "block": m[1]})
    return out


def functions(src: Source) -> list[dict]:
    found = []
    for pattern in (_FUNCTION, _CONST, _ASSIGNED, _DEFAULT):
        for m in _found(pattern, src.mask):
            if src.depth[m.start()] > 0:
                continue
            at, bare = m.end(), m.groupdict().get("bare")
            if not bare and src.mask[at : at + 1] != "(":
                continue
            if pattern is _CONST and not bare and not (m["kind"] or "").startswith("function"):
                if not _ARROW.match(src.mask, src.close(at) + 1):
                    continue
            name = m["name"] or "default"
            lead = m.groupdict().get("lead") or ""
            found.append(_function(src, name, m.start(), at, "export" in lead or pattern in (_ASSIGNED, _DEFAULT), bool(m["async"]), bare, m.groupdict().get("types")))
    first: dict[str, dict] = {}
    for f in sorted(found, key=lambda f: f["start_line"]):
        first.setdefault(f["name"], f)
    return list(first.values())


def classes(src: Source) -> list[dict]:
    out = []
    for m in _found(_CLASS, src.mask):
        if src.depth[m.start()] > 0:
            continue
        at = src.mask.index("{", m.end() - 1) if src.mask[m.end() - 1] == "{" else m.end()
        stop, name, methods, i = src.close(at), m["name"], [], at + 1
        while i < stop:
            k = _METHOD.search(src.mask, i, stop)
            if not k:
                break
            if src.depth[k.start("name")] != src.depth[at] + 1 or k["name"] in _KEYWORDS - {"constructor"}:
                i = k.end()
                continue
            close = src.close(k.end())
            if not _OPENS.match(src.mask, close + 1):
                i = close + 1
                continue
            f = _function(src, f"{name}.{k['name']}", k.start(), k.end(), "export" in m["lead"], "async" in k["mods"])
            methods.append(f)
            i = f["end"] + 1
        above = src.text[max(0, m.start() - 300) : m.start()]
        out.append({"id": f"class:{src.path}:{name}", "name": name, "file": src.path, "start_line": src.line(m.start()), "end_line": src.line(stop), "methods": methods, "is_exported": "export" in m["lead"], "purpose": src.comment_before(m.start()) or readable(name), "decorators": _DECORATOR.findall(above + "\n") if "@" in above else [], "type_parameters": [x.split()[0] for x in split_top((m["types"] or "").strip("<> "))]})
    return out


def generics(src: Source, taken: set[str]) -> list[dict]:
    out = []
    for m in _found(_GENERIC, src.mask):
        kind = "const" if m["kind"] in ("const", "let", "var") else m["kind"]
        if src.depth[m.start()] > 0 or m["name"] in taken or kind == "const" and not _GIVEN.match(src.mask, m.end()) or m.start() and src.mask[m.start() - 1] not in " \n;}":
            continue
        prefix = {"interface": "intf", "type": "type", "enum": "type", "const": "const"}[kind]
        out.append({"id": f"{prefix}:{src.path}:{m['name']}", "name": m["name"], "file": src.path, "kind": kind, "is_exported": "export" in m["lead"], "start_line": src.line(m.start())})
    return out


def imports(src: Source) -> list[dict]:
    """Static (not type-only), dynamic and CommonJS imports; the first of a source counts."""
    t, found = src.text, []
    if "import" not in t and "require" not in t:
        return []

    def live(m: re.Match) -> bool:
        return src.mask[m.start() : m.start() + 6].strip() != ""

    for m in _IMPORT.finditer(t):
        if m["type"] or not live(m):
            continue
        named = _NAMED.search(m["what"])
        star = _STAR.search(m["what"])
        default = _WORD.match(m["what"])
        names = [default[1]] if default else []
        names += [star[1]] if star else []
        names += [x.split(" as ")[-1].strip() for x in named[1].split(",") if x.strip() and not x.strip().startswith("type ")] if named else []
        found.append((m.start(), m["from"], names, bool(default), False))
    for m in _DYNAMIC.finditer(t):
        if live(m):
            found.append((m.start(), m[1], [], False, True))
    for m in _REQUIRE.finditer(t) if "require" in t else ():
        if live(m):
            w = m["what"] or ""
            names = [x.split(":")[-1].split("=")[0].strip() for x in w.strip("{} ").split(",") if x.strip()]
            found.append((m.start(), m["from"], names, bool(w) and not w.startswith("{"), False))
    first: dict[str, dict] = {}
    for _, source, names, default, dynamic in sorted(found, key=lambda x: x[0]):
        first.setdefault(source, {"file": src.path, "source": source, "resolved_path": "", "names": names, "is_default": default, "is_dynamic": dynamic})
    return list(first.values())


def exports(src: Source) -> list[dict]:
    found = []
    if "export" not in src.mask:
        return []
    kinds = {"function": "function", "class": "class", "interface": "interface", "type": "type", "enum": "type", "const": "const", "let": "const", "var": "const"}
    for m in _EXPORT.finditer(src.mask):
        found.append((m.start(), m["name"], "default" if m["default"] else kinds[m["kind"].split()[0].rstrip("*")]))
    for m in _EXPORT_DEFAULT.finditer(src.mask):
        found.append((m.start(), m[1] or "default", "default"))
    for m in _EXPORT_LIST.finditer(src.mask):
        found += [(m.start(), x.split(" as ")[-1].strip(), "const") for x in m[1].split(",") if x.strip()]
    if "exports" in src.mask:
        for m in re.finditer(r"module\.exports\s*=\s*\{([^}]*)\}", src.mask):
            found += [(m.start(), x.split(":")[0].split("(")[0].strip(), "const") for x in split_top(m[1]) if re.match(r"[\w$]", x)]
        for m in re.finditer(r"module\.exports\s*=\s*(?!\{)(?:async\s+)?(?:function\s*)?([\w$]*)", src.mask):
            found.append((m.start(), m[1] if m[1] not in ("", "require") else "default", "default"))
        for m in re.finditer(r"(?:module\.)?\bexports\.([\w$]+)\s*=(?!=)", src.mask):
            found.append((m.start(), m[1], "function" if _CALLED.match(src.mask, m.end()) else "const"))
    first: dict[str, dict] = {}
    for _, name, kind in sorted(found, key=lambda x: x[0]):
        first.setdefault(name, {"name": name, "kind": kind, "file": src.path})
    return list(first.values())


def routes(src: Source) -> list[dict]:
    out, low = [], src.mask.casefold()
    if not any(f"{x}." in low for x in ROUTE_RECEIVERS):
        return []
    for m in _ROUTE.finditer(src.mask):
        stop = src.close(m.end())
        path, middle, handler, args = "", [], "anonymous", split_top(src.text[m.end() + 1 : stop])
        for i, a in enumerate(args):
            if a[0] in "'\"" and not path:
                path = a[1:-1]
            elif re.fullmatch(r"[\w$]+", a):
                if i == len(args) - 1:
                    handler = a
                else:
                    middle.append(a)
            elif (c := re.match(r"([\w$.]+)\(", a)) and "=>" not in a and not a.startswith(("async", "function")):
                middle.append(c[1])
        out.append({"method": m["verb"].upper(), "path": path or "*", "handler": handler, "middlewares": middle, "file": src.path, "line": src.line(m.start())})
    return out


def parse(path: str, text: str, kinds: Collection[str] = KINDS) -> dict:
    """The entities of a file, of all kinds or of some; names in export lists flip is_exported of
    what they name."""
    src, out, named = Source(path, text), {}, {"functions", "classes", "generics"}.intersection(kinds)
    if named or "exports" in kinds:
        out["exports"] = exports(src)
    if named:
        if {"functions", "generics"} & named:
            out["functions"] = functions(src)
        if {"classes", "generics"} & named:
            out["classes"] = classes(src)
        if "generics" in named:
            out["generics"] = generics(src, {x["name"] for x in [*out["functions"], *out["classes"]]})
        names = {e["name"] for e in out["exports"]}
        for x in (x for k in named for x in out[k]):
            x["is_exported"] = x["is_exported"] or x["name"] in names
    if "imports" in kinds:
        out["imports"] = imports(src)
    if "routes" in kinds:
        out["routes"] = routes(src)
    return {k: out[k] for k in KINDS if k in kinds}
