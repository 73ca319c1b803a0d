"""Path specifications, compiled on the driver to expressions over a path column."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

#: The magic words and their one-letter signs.
MAGIC = {"top", "glob", "literal", "icase", "exclude"}
SIGNS = {"/": "top", "!": "exclude", "^": "exclude"}


def parse(spec: str) -> tuple[set[str], str]:
    """The magic words of a specification and its pattern."""
    if spec.startswith(":("):
        words, found, pattern = spec[2:].partition(")")
        magic = {w for w in words.split(",") if w}
        if not found or magic - MAGIC:
            raise ValueError(f"bad path specification: {spec}")
    elif spec.startswith(":"):
        rest = spec[1:].lstrip("".join(SIGNS))
        magic, pattern = {SIGNS[s] for s in spec[1 : len(spec) - len(rest)]}, rest.removeprefix(":")
    else:
        magic, pattern = set(), spec
    if {"glob", "literal"} <= magic:
        raise ValueError(f"glob and literal together: {spec}")
    return magic, pattern.removeprefix("./").strip("/")


def glob_regex(pattern: str, slashes: bool, classes: bool = True) -> str:
    """A regular expression of a wildcard pattern; without ``slashes``, * and ? stop at a slash and ** crosses them; brackets are ``classes`` or plain."""
    one = "." if slashes else "[^/]"
    forms = {"**/": ".*" if slashes else "(?:.*/)?", "**": ".*", "*": f"{one}*", "?": one}
    brackets = r"\[[!^]?\]?[^\]]*\]|" if classes else ""
    parts = re.findall(rf"\*\*/|\*\*|\*|\?|{brackets}\\.|.", pattern, re.S)
    out = []
    for part in parts:
        if part in forms:
            out.append(forms[part])
        elif classes and len(part) > 2 and part[0] == "[":
            negated = part[1] in "!^"
            body = part[1 + negated : -1].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' * negated}{body}]")
        else:
            out.append("\\Q" + part[-1] + "\\E")
    return "".join(out)


def one(path: Column, magic: set[str], pattern: str) -> Column:
    """Whether one specification has the path: blank has all; a plain one also what lies under it."""
    if not pattern or pattern == ".":
        return F.lit(True)
    flags = "(?si)" if "icase" in magic else "(?s)"
    if "literal" in magic or not re.search(r"[*?\[]", pattern):
        body = "\\Q" + pattern + "\\E"
    else:
        body = glob_regex(pattern, "glob" not in magic)
        if "/" not in pattern and "glob" not in magic:
            body = "(?:.*/)?" + body
    return path.rlike(f"{flags}\\A(?:{body})(?:/.*)?\\z")


def matches(path: Column, specs: list[str]) -> Column:
    """Any including specification has the path (all do if none includes) and no excluding one has it."""
    parsed = [parse(s) for s in specs]
    wanted = [one(path, m, p) for m, p in parsed if "exclude" not in m]
    barred = [one(path, m, p) for m, p in parsed if "exclude" in m]
    found = reduce(or_, wanted) if wanted else F.lit(True)
    return found & ~reduce(or_, barred) if barred else found
