"""SimHash near-duplicate detection over a byte-position inverted index.

A document is lower-cased (A-Z only), cut into words at ASCII white space and
into word shingles, repeats included.  Bit ``i`` of its 64-bit fingerprint is 1
when bit ``i`` is 1 in more than half of the shingles' XXH64 values.  Two
fingerprints are linked when they differ in at most ``max_bits`` (0 to 3) bits,
and linked documents form components.

Finding the links.  Three differing bits touch at most three of the eight
bytes, so linked fingerprints share at least ``8 - 3 = 5`` positional bytes.
Posting every (position, byte) singly and tallying pairs would emit N*N/256
pairs, so the postings are conjunctive: they are keyed by the bytes at four
positions, for the 14 position sets of the Steiner system S(3, 4, 8).  Every
set of five positions contains exactly one of those 14, so a pair that shares
the guaranteed five bytes meets in at least one posting list, and lists stay
short because a key has 32 bits.  Pairs that meet are tallied over all eight
positions, kept at the guaranteed minimum, and verified by Hamming distance.

Long posting lists (many different fingerprints of one family) are not paired:
there each fingerprint is posted once more under all its variants at distance
<= 1 and <= 2 inside the four free bytes.  Two members are within three bits
exactly when a <=1 variant of one equals a <=2 variant of the other, so members
are linked to the variant's smallest member and no list emits all its pairs.

Edge cases: null and empty texts have no shingles and fingerprint zero, which
links like any other; a text of fewer words than a shingle is one shingle;
repeated rows and ties share a fingerprint; a null ``doc_id`` keeps its row and
its component is the smallest non-null id reachable, or null if there is none;
an empty table gives an empty result.  Other columns are never read, so extra
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .storage import materialize

SEED = 42
#: Position sets of S(3, 4, 8): four of the eight byte positions whose XOR is 0.
BLOCKS = [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
#: Lists longer than this are linked through variants instead of pairs.
PAIR_LIST = 48


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint of one text, as a signed integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        count = len(words) - width + 1
        digest = xxhash.xxh64_digest
        digests = b"".join(
            [digest(joined[a:b], SEED) for a, b in zip(starts[:count].tolist(), ends[width - 1 :].tolist())]
        )
    count = len(digests) // 8
    ones = np.zeros(64, np.int64)
    hashed = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    for at in range(0, count, 65_536):
        ones += np.unpackbits(hashed[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _mask(positions: tuple[int, ...]) -> int:
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def links(nodes: DataFrame, max_bits: int = 3, pair_list: int = PAIR_LIST) -> DataFrame:
    """(a, b) edges over distinct fingerprints ``nodes(fp)``.

    The edges connect exactly the fingerprints that are reachable through steps
    of at most ``max_bits`` bits; short lists give the verified pairs, long
    lists give stars around shared variants.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the byte-position guarantee covers 0 to 3 differing bits")
    posting = F.array(
        *[
            F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("bytes"))
            for k, s in enumerate(BLOCKS)
        ]
    )
    posted = nodes.select("fp", F.explode(posting).alias("p")).select("fp", "p.block", "p.bytes")
    lists = posted.groupBy("block", "bytes").agg(F.count("*").alias("n")).filter("n > 1")
    posted = materialize(posted.join(lists, ["block", "bytes"]), "postings")

    short = posted.filter(F.col("n") <= pair_list).drop("n")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum(
        (F.when(differ.bitwiseAND(F.lit(_mask((p,)))) == 0, 1).otherwise(0) for p in range(8)), start=F.lit(0)
    )
    pairs = (
        short.withColumnRenamed("fp", "a")
        .join(short.withColumnRenamed("fp", "b"), ["block", "bytes"])
        .filter("a < b")
        .filter(shared >= 8 - max_bits)
        .filter(F.bit_count(differ) <= max_bits)
        .select("a", "b")
    )
    return pairs.unionByName(_variant_links(posted.filter(F.col("n") > pair_list), max_bits))


def _variant_links(crowded: DataFrame, max_bits: int) -> DataFrame:
    """Star edges for posting lists that are too long to pair.

    With ``near = max_bits // 2`` and ``far = max_bits - near``, members ``a``
    and ``b`` of a list are within ``max_bits`` exactly when a variant of ``a``
    at distance <= near equals one of ``b`` at distance <= far.  Two far
    variants alone may be four bits apart, so the far postings of a variant
    link only to its smallest near posting.  Near postings share a variant at
    distance <= 1 each, hence are within 2 bits and link to one another.
    """
    near, far = max_bits // 2, max_bits - max_bits // 2
    flips = {}
    for k, s in enumerate(BLOCKS):
        bits = [8 * p + i for p in range(8) if p not in s for i in range(8)]
        for size in range(far + 1):
            for chosen in combinations(bits, size):
                value = sum(1 << b for b in chosen)
                flips.setdefault(k, []).append((size, value - (1 << 64) if value >> 63 else value))
    spark = crowded.sparkSession
    table = spark.createDataFrame(
        [(k, size, value) for k, rows in flips.items() for size, value in rows], "block int, size int, flip long"
    )
    variants = crowded.join(F.broadcast(table), "block").select(  # 14 x 529 fixed rows
        "block", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "fp", "size"
    )
    hubs = variants.filter(F.col("size") <= near).groupBy("block", "variant").agg(F.min("fp").alias("hub"))
    return (
        variants.join(hubs, ["block", "variant"])
        .filter("fp <> hub")
        .select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))
    )


def simhash_components(docs: DataFrame, width: int = 3, max_bits: int = 3, pair_list: int = PAIR_LIST,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    rows = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    edges = links(nodes.select("fp"), max_bits, pair_list)
    labels = materialize(connected_components(edges, "a", "b").withColumnRenamed("node", "fp"), "labels")
    # Labels are fingerprints; the component's name is the smallest id below its label.
    named = nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    component = named.select("fp", "label").join(smallest, "label").select("fp", "component_id")
    return rows.join(component, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: F.Column) -> F.Column:
    """16 lower-case hex digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(docs: DataFrame, width: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: of the smallest id, a null one last, then of the smallest text hash.

    Rows of one id and different texts are different documents; only rows equal
    in id and text collapse.
    """
    key = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"))
    keyed = docs.select(key.alias("row"), F.col(text_col).alias("text"))
    numbered = materialize(keyed.dropDuplicates(["row"]).select("row", "text", F.monotonically_increasing_id().alias("number")), "dedup-rows")
    marks = materialize(simhash_components(numbered, width, max_bits, id_col="number"), "dedup-components")
    named = numbered.select("row", F.col("number").alias("doc_id")).join(marks, "doc_id")
    order = F.struct(F.col("row.doc_id").isNull().alias("unnamed"), "row")
    keep = named.groupBy("component_id").agg(F.min(order).alias("best")).select(F.col("best.row").alias("_kept"))
    return docs.withColumn("_row", key).join(keep, F.col("_row").eqNullSafe(F.col("_kept")), "left_semi").dropDuplicates(["_row"]).drop("_row")
