"""Object codecs on known ids, deltas and packs; configuration, ranges and picked commits."""

from __future__ import annotations

import hashlib
import struct
import zlib

import pytest

from commitlake.operators import graph, state
from commitlake.sources import objects


def test_known_ids(spark):
    assert objects.object_id("blob", b"") == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    blob = objects.object_id("blob", b"hello world\n")
    rows = [(1, "100644", "a.b", blob), (1, "40000", "a", blob), (1, "100644", "a-", blob), (2, "100644", "\u00fc", blob)]
    trees = objects.encode_trees(spark.createDataFrame(rows, "t int, mode string, name string, oid string"), ["t"]).cache()
    for r in trees.collect():
        assert r["oid"] == objects.object_id("tree", bytes(r["payload"]))
    assert [e[1] for e in objects.parse_tree(bytes(trees.filter("t = 1").first()["payload"]))] == ["a-", "a.b", "a"]
    assert sorted(tuple(r) for r in objects.tree_entries(trees, ["t"]).collect()) == sorted(rows)
    assert objects.object_id("tree", b"") == "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
    with pytest.raises(ValueError):
        objects.parse_tree(b"100644 a\0short")


def test_projected_directories(spark):
    """Directories of any depth, against the aggregation of one directory, and back to files; nothing is written or dealt twice."""
    from pyspark.sql import functions as F

    from commitlake import registry
    from commitlake.operators import contents

    blob = [objects.object_id("blob", bytes([i])) for i in range(9)]
    paths = ["a", "d.x", "d/a.b", "d/a/b", "d/a/c/e/f", "d/a/c/e/g", "d-", "/lead", "\u00fc/x", "b//y"]
    files = [(k, path, "100755" if i % 3 else "100644", blob[(i + k) % 9]) for k in (1, 2, 5) for i, path in enumerate(paths[: 2 * k])] + [(9, "only/null", "100644", None)]
    made = contents.project(spark.createDataFrame(files, "commit_id long, path string, mode string, oid string").repartition(3), "commit_id")
    assert sorted(tuple(r) for r in contents.tree_files(made, "commit_id").collect()) == sorted(f for f in files if f[3])
    rows = made.collect()
    inside = {(k, path.rpartition("/")[0] if "/" in path else None, mode, path.rpartition("/")[2], oid) for k, path, mode, oid in files if oid}
    inside |= {(r["commit_id"], r["dir"].rpartition("/")[0] if "/" in r["dir"] else None, "40000", r["dir"].rpartition("/")[2], r["oid"]) for r in rows if r["dir"] is not None}
    want = objects.encode_trees(spark.createDataFrame(list(inside), "commit_id long, dir string, mode string, name string, oid string"), ["commit_id", "dir"])
    got = {(r["commit_id"], r["dir"], r["oid"]) for r in rows}
    assert {(r["commit_id"], r["dir"], r["oid"]) for r in want.collect()} == got - {(9, "only", objects.object_id("tree", b""))}
    assert {r["commit_id"] for r in rows if r["dir"] is None} == {1, 2, 5, 9}
    with pytest.raises(Exception, match="do not end in a root"):
        contents.tree_files(made.filter(F.col("dir").isNotNull()), "commit_id").collect()
    plan = registry.queries()["o06_tree_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1


BASE = b"hello world\n"
DELTA = bytes([12, 18, 0x90, 6, 6]) + b"brave " + bytes([0x91, 6, 6])


def test_delta():
    assert objects.apply_delta(BASE, DELTA) == b"hello brave world\n"
    for base, delta in [(BASE + b"x", DELTA), (BASE, DELTA[:-3]), (BASE, bytes([12, 1, 0])), (BASE, bytes([12, 99, 0x91, 9, 9]))]:
        with pytest.raises(ValueError):
            objects.apply_delta(base, delta)


def test_packs(spark):
    contents = [b"", BASE, b"x" * 100_000, bytes(range(256)) * 300, BASE]
    found = objects.scan_pack(objects.encode_pack([("blob", c) for c in contents] + [("commit", b"tree")]))
    assert {(k, p) for _, k, p in found} == {("blob", c) for c in contents} | {("commit", b"tree")} and len(found) == 5

    def head(number, size):
        return bytes([number << 4 | size])

    body = b"PACK" + struct.pack(">II", 2, 3)
    by_ref = head(objects.REF_DELTA, 14)[:1] + bytes.fromhex(objects.object_id("blob", BASE)) + zlib.compress(DELTA)
    assert len(DELTA) == 14
    whole = head(3, len(BASE)) + zlib.compress(BASE)
    by_place = head(objects.OFS_DELTA, 14) + bytes([len(whole)]) + zlib.compress(DELTA)
    body += by_ref + whole + by_place
    got = [p for _, _, p in objects.scan_pack(body + hashlib.sha1(body).digest())]
    assert got == [b"hello brave world\n", BASE, b"hello brave world\n"]
    for bad in (body + b"0" * 20, b"", b"PACK" + body):
        with pytest.raises(ValueError):
            objects.scan_pack(bad)
    table = spark.createDataFrame([(c,) for c in [*map(bytearray, contents), None]], "payload binary")
    back = objects.read_packs(objects.write_packs(table, pack_bytes=1000)).collect()
    assert {bytes(r["payload"]) for r in back} == set(contents) and {r["oid"] for r in back} == {objects.object_id("blob", c) for c in contents}
    assert objects.read_packs(objects.write_packs(table.limit(0))).count() == 0


def test_config(spark):
    config = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "key string, value string")
    updates = spark.createDataFrame([("a", None), ("b", "3"), ("d", "4")], "key string, value string")
    assert {tuple(r) for r in state.set_config(config, updates).collect()} == {("b", "3"), ("c", None), ("d", "4")}
    assert {tuple(r) for r in state.effective_config(updates, config).collect()} == {("a", None, "local"), ("b", "3", "local"), ("c", None, "global"), ("d", "4", "local")}


def test_ranges_and_picks(spark):
    edges = spark.createDataFrame([("l", "root", 0), ("r", "root", 0), ("r2", "r", 0)], "commit_id string, parent_id string, ord int")
    ranges = spark.createDataFrame([("l", "r", 2), ("l", "r", 3), ("l", "none", 3)], "left string, right string, dots int")
    assert {tuple(x) for x in graph.range_pairs(edges, ranges).collect()} == {("l", "r", 2, "l", "r"), ("l", "r", 3, "root", "r"), ("l", "none", 3, None, "none")}
    rows = [("root", "a", 1), ("root", "b", 1), ("l", "a", 1), ("l", "b", 2), ("r", "a", 5), ("r", "b", 1), ("r2", "a", 5), ("r2", "c", 7)]
    tree = spark.createDataFrame([(*x, 1, 33188) for x in rows], "commit_id string, path string, content_id long, size long, mode int")
    commits = spark.createDataFrame([(c,) for c in ("root", "l", "r", "r2")], "commit_id string")
    verdicts, trees = state.cherry_pick(tree, commits, edges, spark.createDataFrame([("r", "l"), ("r2", "l"), ("r2", "root")], "commit_id string, onto string"))
    assert {tuple(x) for x in verdicts.collect()} == {("r", "l", 1, True), ("r2", "l", 2, False), ("r2", "root", 2, True)}
    got = {tuple(x)[:4] for x in trees.collect()}
    assert got == {("r", "l", "a", 5), ("r", "l", "b", 2), ("r2", "root", "a", 1), ("r2", "root", "c", 7)}
