"""Source text with comments and strings blanked, and what can be read from that."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

#: What parsers read from a file.
KINDS = ("functions", "classes", "generics", "imports", "exports", "routes")
_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S)
_PAIR = {"(": ")", "[": "]", "{": "}"}
_INSIDE = re.compile(r"[^\n]")
_MARKS, _RULE = re.compile(r"^/{2,}\s?|^/\*+\s?|^\*+/?\s?|\s*\*+/$"), re.compile(r"[-=*─\s]{3,}")
_BRACKET, _BRACE = re.compile(r"[()\[\]{}]"), re.compile(r"[{}]")


def masked(text: str) -> str:
    """The text, as long as before, with comments and the insides of strings as blanks."""

    def blank(m: re.Match) -> str:
        s = m[0]
        body = _INSIDE.sub(" ", s)
        return body if s[0] == "/" else s[0] + body[1:-1] + (s[-1] if len(s) > 1 else "")

    return _TOKEN.sub(blank, text)


class Depth:
    """The brace depth at a place: opening and closing braces stand at the depth around them."""

    def __init__(self, mask: str):
        self.places, self.after = [], [0]
        for m in _BRACE.finditer(mask):
            self.places.append(m.start())
            self.after.append(self.after[-1] + (1 if m[0] == "{" else -1))

    def __getitem__(self, at: int) -> int:
        k = bisect_left(self.places, at)
        closes = k < len(self.places) and self.places[k] == at and self.after[k + 1] < self.after[k]
        return self.after[k] - closes


@dataclass
class Source:
    """A file: its text, masked text, starts of lines and brace depth."""

    path: str
    text: str

    def __post_init__(self):
        self.mask = masked(self.text)
        self.lines = self.text.split("\n")
        self.starts = [0, *accumulate(len(x) + 1 for x in self.lines[:-1])]
        self.depth = Depth(self.mask)

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def close(self, at: int) -> int:
        """The place of the bracket that closes the one at ``at``, else the end."""
        stack = []
        for m in _BRACKET.finditer(self.mask, at):
            c = m[0]
            if c in _PAIR:
                stack.append(_PAIR[c])
            elif stack and c == stack[-1]:
                stack.pop()
                if not stack:
                    return m.start()
        return len(self.mask) - 1

    def comment_before(self, at: int) -> str:
        """The first telling line of the comment that ends right above a place."""
        n, found = self.line(at) - 2, []
        while n >= 0 and (s := self.lines[n].strip()) and (s.startswith(("//", "*", "/*", "@")) or s.endswith("*/")):
            if not s.startswith("@"):
                found.insert(0, _MARKS.sub("", s).strip())
            n -= 1
        return next((s for s in found if s and not _RULE.fullmatch(s) and not s.startswith("@")), "")


def split_top(s: str, sep: str = ",") -> list[str]:
    """Splits at a mark outside brackets; empty parts are dropped."""
    out, depth, start = [], 0, 0
    m = masked(s)
    for i, c in enumerate(m):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and m[i - 1 : i] != "=":
            depth -= 1
        elif c == sep and depth <= 0:
            out.append(s[start:i])
            start = i + 1
    return [x.strip() for x in [*out, s[start:]] if x.strip()]
