"""Secret scan through a trigram inverted index, in DataFrame functions only.

Every rule's regular expression is parsed into a Boolean trigram query, an OR
of ANDs that any match must satisfy (letters are compared in lower case).  The
index has a posting (trigram, document) for every trigram some query asks for.
A query's AND is the intersection of its postings: documents that have all of
its trigrams.  Only those are verified with the expression itself.  Rules
without mandatory trigrams are matched against every text.

Positions come from the pieces between the matches and the matches themselves,
in code points, end exclusive; matches are leftmost and do not overlap, and
those whose secret part is too short are dropped after they were consumed.

Edge cases: a null text is empty and has no spans; repeated rows get the same
spans each; a null ``doc_id`` is a value like any other; an empty table gives an
empty result; extra columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from re import _parser as parser

from pyspark.sql import Column, DataFrame, functions as F

from .literals import ascii_lower, literal_table
from .storage import materialize


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters; the span is the whole match."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: Fixed values of the base kinds.  ``hex`` needs 24 characters in its expression: runs are maximal, so nothing else changes.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Formats of public services' keys.
MORE = [
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("bearer", r"(?i:bearer) [A-Za-z0-9_.=-]{20,}"),
    Rule("url", r"[a-z]{2,10}://[A-Za-z0-9_.-]{1,64}:([^\s:@/]{3,64})@", 1, 3),
]

Query = list[frozenset[str]]
ANY: Query = [frozenset()]
#: Sets of exact strings and alternatives of a query are widened beyond this.
LIMIT = 64


def _smallest(query: Query) -> Query:
    """Without alternatives that another one implies."""
    out: Query = []
    for q in sorted(set(query), key=lambda q: (len(q), sorted(q))):
        if not any(o <= q for o in out):
            out.append(q)
    return out


def _both(a: Query, b: Query) -> Query:
    out = _smallest([x | y for x in a for y in b])
    return out if len(out) <= LIMIT else min(a, b, key=lambda q: -min(map(len, q)))


def _of(strings: set[str]) -> Query:
    return _smallest([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _node(op, arg) -> tuple[set[str] | None, Query]:
    """All strings that a node matches, if they are few, and what any match needs."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, ANY
    if name == "IN":
        chars: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                chars.update(chr(c).lower() for c in range(value[0], value[1] + 1))
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 8 else (None, ANY)
    if name == "SUBPATTERN":
        return _sequence(arg[3])
    if name == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= LIMIT:
            return set().union(*(e for e, _ in parts)), ANY
        return None, _smallest([c for e, q in parts for c in (_both(_of(e), q) if e is not None else q)])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, body = arg
        exact, query = _sequence(body)
        if least == 0:
            return (exact | {""}, ANY) if exact is not None and most == 1 else (None, ANY)
        if exact is None:
            return None, query
        strings = {""}
        for _ in range(least):
            if len(strings) * len(exact) > LIMIT:
                return None, _of(strings)
            strings = {a + b for a in strings for b in exact}
        return (strings, ANY) if most == least else (None, _of(strings))
    if name == "AT":
        return {""}, ANY
    return None, ANY


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    current, need, exact = {""}, ANY, True
    for op, arg in nodes:
        strings, query = _node(op, arg)
        if strings is not None and len(current) * len(strings) <= LIMIT:
            current = {a + b for a in current for b in strings}
        else:
            need, exact = _both(need, _of(current)), False
            current = strings if strings is not None else {""}
        need = _both(need, query)
    return (current, need) if exact else (None, _both(need, _of(current)))


def trigram_query(regex: str) -> Query:
    """OR of ANDs of lower-case trigrams; ``[frozenset()]`` if none are mandatory."""
    exact, need = _sequence(parser.parse(regex))
    return _both(need, _of(exact)) if exact is not None else need


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with equal key have equal id and text, so they share their result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))


def build_index(rows: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram, doc_id, hash) of the given trigrams, one for each text that has it."""
    asked = F.array(*[F.lit(g) for g in grams])
    # The lower-cased text is bound by a lambda, so that it is made once and not again for every trigram.
    found = F.transform(F.array(ascii_lower(F.col("text"))), lambda low: F.filter(asked, lambda g: F.contains(low, g)))
    found = rows.select("doc_id", "hash", found[0].alias("grams"))
    return found.select(F.explode("grams").alias("gram"), "doc_id", "hash")


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, hash, kinds): the rules whose trigram query each document satisfies."""
    asked = [
        {"gram": g, "kind": r.kind, "clause": i, "size": len(c)}
        for r in rules
        for i, c in enumerate(trigram_query(r.regex))
        for g in sorted(c)
    ]
    table = literal_table(index.sparkSession, asked, "gram string, kind string, clause int, size int")
    met = (
        index.join(F.broadcast(table), "gram")  # one row for each trigram of a rule
        .groupBy("doc_id", "hash", "kind", "clause", "size")
        .agg(F.count_distinct("gram").alias("n"))
        .filter("n = size")
    )
    return met.groupBy("doc_id", "hash").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches in ``text``."""
    regex = F.lit(rule.regex)
    pieces, matches = F.split(text, rule.regex, -1), F.regexp_extract_all(text, regex, F.lit(0))
    kept = matches if rule.group == 0 else F.regexp_extract_all(text, regex, F.lit(rule.group))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        end = begin + F.length(x["match"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["kept"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("piece"), matches.alias("match"), kept.alias("kept"))
    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def _labelled(rank: int, kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def _ranked(rank: int) -> Callable[[Column], Column]:
    return lambda s: s["rank"] == rank


def scan(docs: DataFrame, base: list[Rule] = BASE, more: list[Rule] = MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ``n_<kind>`` of the base kinds, base_sha256, spans, and the text with ``secrets`` as structs."""
    rules = [*base, *more]
    indexed = [r for r in rules if all(trigram_query(r.regex))]
    grams = sorted({g for r in indexed for c in trigram_query(r.regex) for g in c})
    rows = _keyed(docs, id_col, text_col)
    found = materialize(candidates(build_index(rows, grams), indexed), "secret-candidates")
    found = found.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "kinds")
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    kind_spans = []
    for rank, rule in enumerate(rules):
        # The plain test first: what it rejects is not cut into pieces.
        may = F.col("text").rlike(rule.regex)
        if rule in indexed:
            may = F.array_contains("kinds", rule.kind) & may
        at = F.when(may, spans(F.col("text"), rule)).otherwise(none)
        kind_spans.append(F.transform(at, _labelled(rank, rule.kind)))
    rows = rows.withColumn("secrets", F.array_sort(F.concat(*kind_spans)))

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    ours = F.filter("secrets", lambda s: s["rank"] < len(base))
    counts = {f"n_{r.kind}": F.size(F.filter("secrets", _ranked(i))).cast("long") for i, r in enumerate(base)}
    return rows.withColumns({**counts, "base_sha256": F.sha2(joined(ours).cast("binary"), 256), "spans": joined(F.col("secrets"))})
