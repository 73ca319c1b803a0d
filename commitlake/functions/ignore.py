"""Ignore rules: parsed on the driver, applied as one expression over a path column."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, functions as F

from .pathspec import glob_regex


class Rule(NamedTuple):
    regex: str
    negated: bool


def parse_line(line: str, base: str = "") -> Rule | None:
    """The rule of a line of the ignore file in directory ``base``; None for blank lines and comments.

    Spaces at the end go unless escaped; brackets are plain characters; a
    slash at the end is read but does not restrict the rule to directories.
    """
    line = re.sub(r"(?<!\\) +\Z", "", line.removesuffix("\r"))
    if not line.strip() or line.startswith("#"):
        return None
    negated = line.startswith("!")
    pattern = (line[1:] if negated or line[:2] in ("\\#", "\\!") else line).rstrip("/")
    local = pattern.lstrip("/")
    anywhere = "" if "/" in pattern else "(?:.*/)?"
    where = glob_regex(base, False, classes=False) + "/" if base else ""
    return Rule(f"(?s)\\A{where}{anywhere}{glob_regex(local, False, classes=False)}(?:/.*)?\\z", negated)


def rules(files: dict[str, str]) -> list[Rule]:
    """The rules of all ignore files (path to text), those nearer to the root first, then by path and line."""
    found = []
    for path in sorted(files, key=lambda p: (p.count("/"), p)):
        base = path.rpartition("/")[0]
        found += [r for line in files[path].split("\n") if (r := parse_line(line, base))]
    return found


def ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether the last rule that has the path ignores it; without one it is not ignored."""
    verdicts = [F.when(path.rlike(r.regex), F.lit(not r.negated)) for r in reversed(rules)]
    return F.coalesce(*verdicts, F.lit(False))


def last_rule(path: Column, rules: list[Rule]) -> Column:
    """The number, from 1, of the last rule that has the path; null without one."""
    return F.coalesce(*[F.when(path.rlike(r.regex), F.lit(n)) for n, r in reversed(list(enumerate(rules, 1)))], F.lit(None).cast("int"))
