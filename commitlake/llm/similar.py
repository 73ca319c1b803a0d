"""Near-duplicate stage of operator 8: similarity of word-shingle sets, through a byte-position inverted index.

A document is cut into words as in ``simhash``; its set holds the XXH64 values
of its ``width``-word shingles.  Documents with equal sets are one node.  Nodes
of Jaccard similarity ``>= least`` are linked, and linked nodes form components.

Fingerprints.  Three SimHash bits cannot hold a similarity of 0.8: most such
pairs differ in more.  So a node's fingerprint has ``BYTES`` positions, each the
low byte of the set's minimum under a multiplier of its own: two nodes share a
byte with the probability of their similarity.  As in ``simhash`` the postings
are conjunctive, ``BANDS`` keys of ``ROWS`` positions each; the shared positional
bytes of pairs that meet are tallied, pairs below the minimum that similarity
``least`` guarantees (but for ``MISS``) are dropped, and the others are verified
on the whole sets.  No link is wrong.  Of the pairs at 0.8, the lowest that link,
1.5 in 100,000 never meet, of those above fewer: that is the method's gap.

Every list first gives the pairs of its members with its smallest and its
largest one.  Lists that the links so found do not join whole are then compared
in blocks of whole sets, but for blocks inside one component, which a link would
not change: each row carries two blocks, whose pairs are verified there at once,
by a product of incidence matrices; only the names of linked components leave it.

Edge cases: null and empty texts have the empty set and are one node; a text
of fewer words than a shingle is one shingle; rows of one (doc_id, text) are
exact repeats and collapse; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .storage import materialize

SEED, BANDS, ROWS = 42, 28, 5
BYTES = BANDS * ROWS
#: Share of the pairs at ``least`` that the tally may drop.
MISS = 1e-9
#: Nodes of a list, and values of their sets, that make a block; columns of an incidence matrix.
PAIR_LIST, BLOCK_HASHES, COLUMNS = 64, 16_384, 32_768
_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(1 << 63, size=BYTES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(1 << 63, size=BYTES, dtype=np.uint64)


@cache
def guaranteed(least: float, positions: int = BYTES, miss: float = MISS) -> int:
    """Positional bytes that a pair of similarity ``least`` shares, but for a share of ``miss`` of such pairs."""
    below = 0.0
    for n in range(positions + 1):
        below += comb(positions, n) * least**n * (1 - least) ** (positions - n)
        if below > miss:
            return n
    return positions


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    last = max(len(words) - width, 0)
    digest = xxhash.xxh64_intdigest
    hashed = {digest(b" ".join(words[i : i + width]), SEED) for i in range(last + 1)} if words else set()
    return np.sort(np.fromiter(hashed, np.uint64, len(hashed)))


def fingerprint(hashes: np.ndarray) -> bytes:
    """The low bytes of a set's minima."""
    least = np.full(BYTES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[at : at + 4096, None] * _FACTORS + _SHIFTS
        least = np.minimum(least, mixed.min(axis=0))
    return (least & np.uint64(255)).astype(np.uint8).tobytes()


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart; rows of one key are exact repeats."""
    return F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"))


def nodes_of(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, node, size, bytes) for every row of ``docs``; ``node`` stands for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(t.as_py(), width) for t in batch.column(2))
            found = [(xxhash.xxh3_64_intdigest(s.tobytes(), SEED), len(s), fingerprint(s)) for s in sets]
            nodes = np.array([f[0] for f in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary())],
                ["doc_id", "text_hash", "node", "size", "bytes"],
            )

    rows = docs.select(row_key(id_col, text_col).alias("r"), F.col(text_col).alias("text")).select("r.*", "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, node long, size int, bytes binary")


def sets_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, hashes) of the ``wanted`` nodes, each from the text of one of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = pa.array([shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), hashes], ["node", "hashes"])

    chosen = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    texts = docs.select(row_key(id_col, text_col).alias("r"), F.col(text_col).alias("text"))
    found = chosen.join(texts, F.col("row").eqNullSafe(F.col("r"))).groupBy("node").agg(F.first("text").alias("text"))
    return found.mapInArrow(run, "node long, hashes binary")


def _tallied(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` that share the guaranteed number of positional bytes."""
    minimum = guaranteed(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BYTES) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= minimum))

    for n in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("bytes").alias(f"bytes_{n}")), n)
    pairs = pairs.filter(F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-6)
    return pairs.select("a", "b", "bytes_a", "bytes_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets have similarity >= ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both / (len(x) + len(y) - both) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first, second = (sets.select(F.col("node").alias(n), F.col("hashes").alias(f"hashes_{n}")) for n in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(run, "a long, b long")


def _blocks(crowded: DataFrame, nodes: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """(key, home, id, labels, hashes): the members of each list, ``block`` of them or ``BLOCK_HASHES`` at a time on average.

    A component with more members than a block has blocks of its own, whose
    ``home`` is its label; the members of all others share blocks without a home.
    """
    sized = crowded.join(nodes.select("node", "size"), "node")
    counts = sized.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"))
    counts = counts.withColumn("home", F.when((F.col("n") > block) | (F.col("hashes") > BLOCK_HASHES), F.col("label")))
    parts = counts.groupBy("key", "home").agg(F.ceil(F.greatest(F.sum("n") / block, F.sum("hashes") / BLOCK_HASHES)).alias("parts"))
    same = [F.col("key") == F.col("_key"), F.col("home").eqNullSafe(F.col("_home"))]
    homes = counts.join(parts.select(F.col("key").alias("_key"), F.col("home").alias("_home"), "parts"), same).select("key", "label", "home", "parts")
    members = crowded.join(homes, ["key", "label"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts")).join(sets, "node")
    held = members.groupBy("key", "home", "part").agg(F.collect_list(F.struct("label", "hashes")).alias("m"))
    return held.select("key", "home", F.xxhash64("home", "part").alias("id"), F.col("m.label").alias("labels"), F.col("m.hashes").alias("hashes"))


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Numbers of values that each set of ``x`` shares with each of ``y``, as a product of incidence matrices."""
    sizes = np.array([len(s) for s in (*x, *y)])
    kinds = np.unique(np.concatenate((*x, *y)), return_inverse=True)[1]
    of = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(x), len(y)))
    for at in range(0, int(kinds.max(initial=-1)) + 1, COLUMNS):
        here = (kinds >= at) & (kinds < at + COLUMNS)
        table = np.zeros((len(sizes), COLUMNS), np.float32)
        table[of[here], kinds[here] - at] = 1
        out += table[: len(x)] @ table[len(x) :].T
    return out


def _block_links(blocks: DataFrame, least: float) -> DataFrame:
    """(a, b) of components, by their labels, of which two members in one list are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for i in range(batch.num_rows):
                names = [np.array(batch.column(k)[i].as_py()) for k in (0, 2)]
                x, y = ([np.frombuffer(h, np.uint64) for h in batch.column(k)[i].as_py()] for k in (1, 3))
                both = _shared(x, y)
                either = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y]) - both
                rows, columns = np.nonzero((both / either >= least) & (names[0][:, None] != names[1]))
                found.update(zip(names[0][rows].tolist(), names[1][columns].tolist()))
            ends = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["a", "b"])

    left, right = (blocks.select("key", *[F.col(n).alias(f"{n}_{side}") for n in ("home", "id", "labels", "hashes")]) for side in "ab")
    met = left.join(right, "key").filter("id_a <= id_b and (home_a is null or home_b is null or home_a <> home_b)")
    return met.select("labels_a", "hashes_a", "labels_b", "hashes_b").mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, rows: DataFrame, width: int = 5, least: float = 0.8, pair_list: int = PAIR_LIST) -> DataFrame:
    """(node, label) for every node of ``nodes_of`` that is linked to another one."""
    nodes = rows.filter("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("bytes").alias("bytes"))
    nodes = materialize(nodes, "similar-nodes")
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("bytes", k * ROWS + 1, ROWS)) for k in range(BANDS)])
    posted = nodes.select("node", F.explode(keys).alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).filter("n > 1")
    posted = materialize(posted.join(lists, "key"), "similar-postings")
    sets = materialize(sets_of(docs, rows, posted.select("node").distinct(), width), "similar-sets")

    pairs = posted.select("node", F.explode(F.array("low", "high")).alias("other")).filter("node <> other")
    pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    edges = materialize(_verified(_tallied(pairs, nodes, least), sets, least), "similar-edges")
    labels = materialize(connected_components(edges, "a", "b"), "similar-labels")

    # Lists of up to three members have had all their pairs.
    named = posted.filter("n > 3").select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    crowded = materialize(named.join(apart, "key", "left_semi").select("key", "node", "label"), "similar-crowded")
    blocks = materialize(_blocks(crowded, nodes, sets, max(1, pair_list)), "similar-blocks")
    more = materialize(_block_links(blocks, least).distinct(), "similar-more")
    if more.isEmpty():
        return labels
    joined = materialize(connected_components(more, "a", "b"), "similar-joined").withColumnRenamed("label", "final")
    old = labels.select("node", "label").unionByName(joined.select("node", F.col("node").alias("label"))).distinct()
    return old.join(joined.select(F.col("node").alias("label"), "final"), "label", "left").select("node", F.coalesce("final", "label").alias("label"))


def similar_dedup(docs: DataFrame, width: int = 5, least: float = 0.8, pair_list: int = PAIR_LIST) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id, a null one last, then of the smallest text hash."""
    rows = materialize(nodes_of(docs, width), "similar-rows")
    labels = similar_components(docs, rows, width, least, pair_list)
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    named = rows.join(labels, "node", "left").select(F.coalesce("label", "node").alias("label"), row.alias("row"))
    best = named.groupBy("label").agg(F.min("row").alias("row"))
    keep = materialize(best.select("row.doc_id", "row.text_hash").distinct(), "similar-kept")
    kept = docs.withColumn("_row", row_key()).join(keep.select(F.struct("doc_id", "text_hash").alias("_kept")), F.col("_row").eqNullSafe(F.col("_kept")), "left_semi")
    repeats = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    repeated = keep.join(repeats.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), same, "left_semi")
    # Only rows that come more than once need another shuffle of the texts.
    return (kept if repeated.isEmpty() else kept.dropDuplicates(["_row"])).drop("_row")
