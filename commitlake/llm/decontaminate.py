"""Benchmark decontamination with a broadcast set of normalised n-grams.

Texts are lower-cased (A-Z only) and cut into words, runs of letters and digits
of ASCII and of all other characters above it.  A window is ``width``
consecutive words of a benchmark item; an item of fewer words, but not none, is
one window.  Documents are scanned once: their words become ids of the
benchmark's vocabulary, stretches that leave the vocabulary are skipped, and
every window that remains is looked up as its whole id sequence, so a hit is
exact and needs no second check.

The index is broadcast only up to ``max_words`` benchmark words.  A larger
benchmark is cut into blocks of that many words (by a hash of the item), and
the documents are scanned once for each block, with what was hit so far carried
along in a table; results are the same.

Edge cases: null and empty texts have no words and are never hit; an empty or
null benchmark item has no window; repeated items and rows count as they come;
item ids are compared as strings (null as ""); an empty benchmark hits nothing;
an empty table gives an empty result.  A document's other columns pass through;
one with the name of an added column (``n_words n_hit n_items items_sha256
contaminated hit_starts hit_ends hit_items``) is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .storage import materialize

#: Bytes of UTF-8 to lower case, with a space for every byte outside words.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
MAX_WORDS = 1_000_000
ADDED = ("n_words", "hit_starts", "hit_ends", "hit_items")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WindowIndex:
    """Windows of the benchmark items as sequences of word ids."""

    def __init__(self, items: list[tuple[str, str | None]], width: int) -> None:
        self.ids: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, list[str]]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.int32)
            size = min(width, len(words))
            held = self.windows.setdefault(size, {})
            for i in range(len(words) - size + 1):
                has = held.setdefault(ids[i : i + size].tobytes(), [])
                if not has or has[-1] != item:
                    has.append(item)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit spans of words (sorted, apart), and items with an occurring window."""
        words = words_of(text)
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.int32, len(words))
        outside = np.concatenate(([0], np.cumsum(ids == 0)))
        found, items = [], set()
        for size, held in self.windows.items():
            if len(words) < size:
                continue
            for i in np.flatnonzero(outside[size:] == outside[:-size]).tolist():
                if has := held.get(ids[i : i + size].tobytes()):
                    found.append((i, i + size))
                    items.update(has)
        return len(words), merged(found), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pass(docs: DataFrame, index: WindowIndex, text_col: str, carried: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    plain = [f for f in docs.schema.fields if f.name not in ADDED]
    names = [f.name for f in plain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts, rows = batch.column(names.index(text_col)), []
            for i in range(batch.num_rows):
                count, spans, items = index.scan(texts[i].as_py())
                if carried:
                    old = [batch.column(c)[i].as_py() for c in ADDED[1:]]
                    spans, items = merged(spans + list(zip(old[0], old[1]))), items | set(old[2])
                rows.append((count, [a for a, _ in spans], [b for _, b in spans], sorted(items)))
            added = [
                pa.array([r[0] for r in rows], pa.int64()),
                *[pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (1, 2)],
                pa.array([r[3] for r in rows], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + added, [*names, *ADDED])

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*plain, T.StructField("n_words", T.LongType()), T.StructField("hit_starts", longs), T.StructField("hit_ends", longs), T.StructField("hit_items", T.ArrayType(T.StringType()))])
    return docs.select(*names, *(ADDED if carried else ())).mapInArrow(run, schema)


def annotate(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id",
             item_text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with ``n_words n_hit n_items items_sha256 contaminated`` and the hit word spans and items."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    size = F.size(F.split(F.coalesce("text", F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(1, -(-total // max_words))
    out = docs.drop(*ADDED)
    for k in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        out = _pass(out, WindowIndex([tuple(r) for r in block.collect()], width), text_col, carried=k > 0)  # bounded above
        if k < blocks - 1:
            out = materialize(out, "decontaminate")
    hit = F.aggregate(F.zip_with("hit_ends", "hit_starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumns({
        "n_hit": hit,
        "n_items": F.size("hit_items").cast("long"),
        "items_sha256": F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256),
        "contaminated": F.size("hit_items") > 0,
    })


def without_spans(text: str, starts: list[int], ends: list[int]) -> str:
    """``text`` without the hit words and what stands between them."""
    places, out, at = [m.span() for m in _WORD.finditer(text)], [], 0
    for a, b in zip(starts, ends):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", width: int = 10, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents (``documents``) or without the hit passages (``spans``), same columns."""
    found = annotate(docs, benchmark, width, text_col, **options)
    if mode == "documents":
        return found.filter(~F.col("contaminated")).select(*docs.columns)
    if mode != "spans":
        raise ValueError("mode is 'documents' or 'spans'")

    @F.pandas_udf("string")
    def cut(text, starts, ends):
        return pd.Series([without_spans(t, a, b) if len(a) else t for t, a, b in zip(text, starts, ends)], dtype=object)

    whole = F.when(F.col("contaminated"), cut(text_col, "hit_starts", "hit_ends")).otherwise(F.col(text_col))
    return found.withColumn(text_col, whole).select(*docs.columns)
