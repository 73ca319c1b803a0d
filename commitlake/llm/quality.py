"""Quality rules learned as a decision list over text statistics.

``features`` computes statistics of whole texts; ``learn`` fits an ordered list
of rules by sequential covering: each rule is grown on two thirds of the rows
left, one threshold at a time by information gain, pruned on the other third,
and kept while it is precise enough there; the rows it covers leave.  ``verdict``
emits the list as one conditional expression of Spark.

Fitting reads at most ``MAX_LABELS`` labelled documents, those of the smallest
hash of their id; statistics and verdicts cover every row.

Edge cases: null and empty texts have no words and fail the base rule;
documents without a label, labels without a document and null labels take no
part in fitting; repeated labels count as often as they come; with fewer than
``2 * LEAST_COVER`` bad labels, or an empty table, no rule is learned and only
the base rule applies.  Columns other than id and text pass through
``with_features``; one with the name of a statistic is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

WINDOW = 8
MAX_LABELS = 20_000
MAX_RULES, MAX_CONDITIONS, LEAST_COVER, PRECISION, THRESHOLDS = 12, 4, 8, 0.9, 40
#: The symbols that the base statistics count.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
UPPER, DIGITS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_bytes", "n_distinct")
BASE = COUNTS[:5]


def _repeated(words: list[bytes], size: int = WINDOW) -> tuple[int, int]:
    """Words inside windows found twice or more, and number of distinct words.

    Windows of 2, 4 and 8 words get exact numbers by pairing those of half
    their size.  ``size`` is a power of two.
    """
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(words) <= size or len(number) == len(words):
        return 0, len(number)
    step, counts = 1, None
    while step < size:
        codes = codes[:-step] * (int(codes.max()) + 1) + codes[step:]
        _, codes, counts = np.unique(codes, return_inverse=True, return_counts=True)
        if len(counts) == len(codes):
            return 0, len(number)
        step *= 2
    marks = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[codes] > 1)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + size, -1)
    return int((np.cumsum(marks) > 0).sum()), len(number)


def statistics(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()

    def count(chars: bytes) -> int:
        return len(data) - len(data.translate(None, chars))

    seen: set[bytes] = set()
    lines = copies = 0
    for line in data.split(b"\n"):
        if line.strip(SPACE):
            lines += 1
            copies += line in seen
            seen.add(line)
    repeated, distinct = _repeated(words)
    return (len(words), len(text) - count(SPACE), count(SYMBOLS), copies, repeated, lines, count(UPPER), count(DIGITS), count(MARKS), len(data), distinct)


def with_features(docs: DataFrame, text_col: str = "text", carry: bool = True, id_col: str = "doc_id") -> DataFrame:
    """``docs`` (or its id alone, without ``carry``) and the statistics of each text."""
    kept = [f for f in docs.schema.fields if (f.name not in COUNTS if carry else f.name == id_col)]
    names = [f.name for f in kept]
    source = docs.select(*names, F.col(text_col).alias("_text")) if text_col not in names else docs.select(*names)
    at = source.columns.index("_text" if text_col not in names else text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(at)]
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + columns, [*names, *COUNTS])

    return source.mapInArrow(run, T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in COUNTS]]))


def ratios() -> dict[str, Column]:
    """What rules put thresholds on."""
    words, size, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_bytes", "n_lines"))
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeat_words": F.col("n_repeat_words") / words,
        "upper": F.col("n_upper") / size,
        "digits": F.col("n_digits") / size,
        "marks": F.col("n_marks") / words,
        "line_words": F.col("n_words") / lines,
        "distinct": F.col("n_distinct") / words,
    }


@dataclass(frozen=True)
class Rule:
    """All conditions (name, above, threshold) must hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, names: list[str], x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, limit in self.conditions:
            column = x[:, names.index(name)]
            out &= column > limit if above else column <= limit
        return out

    def expression(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, limit in self.conditions:
            out = out & ((columns[name] > limit) if above else (columns[name] <= limit))
        return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _grow(names: list[str], x: np.ndarray, bad: np.ndarray) -> Rule:
    conditions: list[tuple[str, bool, float]] = []
    inside = np.ones(len(x), bool)
    while len(conditions) < MAX_CONDITIONS:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not n0 or not p0:
            break
        best = (1e-9, None, None)
        for k, name in enumerate(names):
            values = np.unique(x[inside, k])
            if len(values) < 2:
                continue
            cuts = (values[:-1] + values[1:]) / 2
            if len(cuts) > THRESHOLDS:
                cuts = np.unique(np.concatenate((np.quantile(x[inside & bad, k], np.linspace(0, 1, THRESHOLDS)), cuts[:: max(1, len(cuts) // THRESHOLDS)])))
            for cut in cuts.tolist():
                for above in (True, False):
                    hit = inside & ((x[:, k] > cut) if above else (x[:, k] <= cut))
                    gain = _gain(int((hit & bad).sum()), int((hit & ~bad).sum()), p0, n0)
                    if gain > best[0]:
                        best = (gain, (name, above, float(cut)), hit)
        if best[1] is None:
            break
        conditions.append(best[1])
        inside = best[2]
    return Rule(tuple(conditions))


def learn_rules(names: list[str], x: np.ndarray, bad: np.ndarray, precision: float = PRECISION) -> list[Rule]:
    """Sequential covering; rows are taken in the given order."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    for _ in range(MAX_RULES):
        if (left & bad).sum() < 2 * LEAST_COVER:
            break
        rows = np.flatnonzero(left)
        check = rows[rows % 3 == 2]
        grown = _grow(names, x[np.setdiff1d(rows, check)], bad[np.setdiff1d(rows, check)])
        worth, rule = (-1.0, 0), None
        for size in range(len(grown.conditions), 0, -1):
            short = Rule(grown.conditions[:size])
            hit = short.covers(names, x[check])
            p, n = int((hit & bad[check]).sum()), int((hit & ~bad[check]).sum())
            value = ((p - n) / (p + n) if p + n else -1.0, p)
            if value > worth:
                worth, rule = value, short
        if rule is None:
            break
        hit = rule.covers(names, x) & left
        p = int((hit & bad).sum())
        if p < LEAST_COVER or p / int(hit.sum()) < precision or worth[0] < 2 * precision - 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learn(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, text_col: str = "text") -> list[Rule]:
    """Rules that reject documents like those labelled ``quality`` 0."""
    given = labels.select(F.col("doc_id").alias("_labelled"), F.col("quality").alias("_quality")).dropna()
    sample = given.orderBy(F.xxhash64("_labelled"), "_labelled", "_quality").limit(max_labels)
    rows = docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_labelled"))  # at most max_labels rows
    rows = with_features(rows.select("doc_id", "text", "_quality")).select("doc_id", "_quality", *[c.alias(n) for n, c in ratios().items()])
    found = sorted((tuple(r) for r in rows.collect()), key=lambda r: (hash((r[0] * 2654435761) % 4294967296), r[0]))
    if not found:
        return []
    table = np.array([r[2:] for r in found], float)
    return learn_rules(list(ratios()), table, np.array([r[1] == 0 for r in found]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The decision list: the first rule that covers a row rejects it, what no rule covers is kept."""
    columns, out = ratios(), F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(rule.expression(columns), F.lit(False))
    return out.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame, carry: bool = True, max_labels: int = MAX_LABELS, text_col: str = "text") -> DataFrame:
    """``docs`` with statistics, ``base_failed`` and ``kept``."""
    rules = learn(docs, labels, max_labels, text_col)
    return with_features(docs, text_col, carry).withColumns({"base_failed": base_failed(), "kept": verdict(rules)})


def keep_good(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the list keeps, same columns."""
    return judged(docs, labels, True, max_labels, text_col).filter("kept").select(*docs.columns)
