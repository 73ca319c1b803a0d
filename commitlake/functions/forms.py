"""Top-level forms of s-expression source: their text, kind, name and the symbols they call."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F, types as T

#: Extensions of such sources.
EXTENSIONS = ("clj", "cljc", "cljs", "bb", "edn")
_TOKEN = re.compile(
    r"""(?P<blank>(?:[\s,]|;[^\n]*)+)|(?P<string>\#?"(?:[^"\\]|\\.)*")|(?P<char>\\(?:[A-Za-z0-9]+|.))|(?P<open>\#?\{|\#?\(|\[|\#\?@?\()|(?P<close>[)\]}])
    |(?P<skip>\#_)|(?P<prefix>\#'|~@|\#\^|['`~@^])|(?P<atom>[^\s,;"()\[\]{}'`~@^\\][^\s,;"()\[\]{}`~@^\\]*)""",
    re.X | re.S,
)
_PAIR = {")": "(", "]": "[", "}": "{"}
_NUMBER = re.compile(r"[+-]?\d")
FORMS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("line", T.LongType()), T.StructField("text", T.StringType()), T.StructField("calls", T.ArrayType(T.StringType()))]))


def _symbol(token: str | None) -> bool:
    return bool(token) and token[0] not in ':#"' and not _NUMBER.match(token) and token not in ("nil", "true", "false")


def split_forms(text: str) -> list[dict]:
    """The top-level forms up to the first unreadable one; a form's text are the whole lines it reaches, from the line after the last form's."""
    lines, out, at, first = text.split("\n"), [], 0, 1
    stack: list[tuple[str, bool]] = []
    words: list[str] = []  # the first two tokens of the form
    calls: set[str] = set()
    fresh = discard = False  # just behind an opening parenthesis; behind #_
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            break
        at, kind, token = m.end(), m.lastgroup, m[0]
        done = False
        if kind == "blank" or kind == "prefix":
            continue
        if kind == "skip":
            discard = discard or not stack
            continue
        if kind == "open":
            if len(stack) == 1 and len(words) < 2:
                words.append("")
            stack.append((token[-1], token == "("))
            fresh = token == "("
            continue
        if kind == "close":
            if not stack or stack[-1][0] != _PAIR[token]:
                break
            stack.pop()
            done, fresh = not stack, False
        else:
            if fresh and kind == "atom" and _symbol(token):
                calls.add(token.rpartition("/")[2] if token != "/" else token)
            if len(stack) == 1 and stack[0][1] and len(words) < 2:
                words.append(token if kind == "atom" else "")
            fresh = False
            done = not stack
        if done:
            last = text.count("\n", 0, at) + 1
            body = "\n".join(lines[first - 1 : last])
            if body.strip() and not discard:
                head = words[0] if words and _symbol(words[0]) else None
                name = words[1] if head and len(words) > 1 and _symbol(words[1]) else None
                out.append({"kind": head and (head.rpartition("/")[2] or head), "name": name, "line": first, "text": body, "calls": sorted(calls)})
            first, words, calls, discard = last + 1, [], set(), False
    return out


@F.pandas_udf(FORMS)
def forms(text: pd.Series) -> pd.Series:
    return pd.Series([split_forms(t or "") for t in text])
