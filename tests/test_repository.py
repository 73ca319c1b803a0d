"""Repository operators on small fixtures: graph, trees, diffs, scalars."""

from __future__ import annotations

from itertools import product

import pytest

from commitlake.functions import ignore, pathspec, scalars as S
from commitlake.operators import graph, state, textdiff, trees
from pyspark.sql import functions as F

DIAMOND = [("left", "root", 0), ("right", "root", 0), ("tip", "left", 0), ("tip", "right", 1)]
CROSS = [("m1", "a1", 0), ("m1", "a2", 1), ("m2", "a2", 0), ("m2", "a1", 1), ("ours", "m1", 0), ("theirs", "m2", 0)]


def edge_table(spark, rows):
    return spark.createDataFrame(rows, "commit_id string, parent_id string, ord int")


def test_distances_and_bases(spark):
    edges = edge_table(spark, DIAMOND)
    got = graph.distances(edges, spark.createDataFrame([("tip",)], "root string")).collect()
    assert {(r["commit_id"], r["distance"]) for r in got} == {("tip", 0), ("left", 1), ("right", 1), ("root", 2)}
    pairs = spark.createDataFrame([("left", "right"), ("left", "tip"), ("root", "none")], "left string, right string")
    assert {tuple(r) for r in graph.merge_bases(edges, pairs).collect()} == {("left", "right", "root", 2), ("left", "tip", "left", 1), ("root", "none", None, None)}
    assert {tuple(r) for r in graph.is_ancestor(edges, pairs).collect()} == {("left", "right", False), ("left", "tip", True), ("root", "none", False)}
    cross = edge_table(spark, CROSS)
    two = spark.createDataFrame([("ours", "theirs")], "left string, right string")
    assert [tuple(r)[2:] for r in graph.merge_bases(cross, two).collect()] == [("a1", 4)]
    assert {r["commit_id"] for r in graph.lowest_common_ancestors(cross, two).collect()} == {"a1", "a2"}
    assert {r["commit_id"] for r in graph.reachable_not(cross, two).collect()} == {"theirs", "m2"}
    stop = spark.createDataFrame([("tip", "left")], "root string, commit_id string")
    part = graph.distances(edges, spark.createDataFrame([("tip",)], "root string"), stop=stop).collect()
    assert {r["commit_id"] for r in part} == {"tip", "right", "root"}


def tree(spark, **files):
    return spark.createDataFrame([(p, c, 1, 33188) for p, c in files.items()] or [], "path string, content_id long, size long, mode int")


def test_trees(spark):
    a, b = tree(spark, x=1, y=2, z=3), tree(spark, x=1, y=5, w=3)
    changed = trees.changes(a, b)
    assert {(r["path"], r["kind"]) for r in changed.collect()} == {("y", "modified"), ("z", "deleted"), ("w", "added")}
    assert {(r["path"], r["kind"]) for r in trees.reverse(changed).collect()} == {("y", "modified"), ("z", "added"), ("w", "deleted")}
    assert sorted(map(tuple, trees.apply_changes(a, changed).collect())) == sorted(map(tuple, b.collect()))
    assert trees.applicable(changed, a).first()[0] and not trees.applicable(changed, tree(spark, y=9)).first()[0]
    renamed = trees.exact_renames(changed.withColumn("d", F.lit(1)), ["d"]).collect()
    assert [(r["old_path"], r["new_path"]) for r in renamed] == [("z", "w")]
    merged = trees.merge_trees(tree(spark, same=1, o=1, t=1, c=1, gone=1), tree(spark, same=1, o=2, t=1, c=2), tree(spark, same=1, o=1, t=3, c=3, gone=1))
    got = {r["path"]: (r["resolved"]["content_id"] if r["resolved"] else None, r["conflict"]) for r in merged.collect()}
    assert got == {"same": (1, False), "o": (2, False), "t": (3, False), "c": (None, True), "gone": (None, False)}
    status = trees.status(tree(spark, a=1, b=1), tree(spark, a=2, c=1), tree(spark, a=2, c=2, n=1))
    assert {tuple(r) for r in status.collect()} == {("a", "modified", None), ("b", "deleted", None), ("c", "added", "modified"), ("n", None, "untracked")}
    paths = spark.createDataFrame([("a/b/c.txt",), ("top",)], "path string")
    assert {r["path"] for r in trees.directories(paths).collect()} == {"a", "a/b"}


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shortest_edits():
    words = ["".join(w) for n in range(5) for w in product("ab", repeat=n)]
    for a, b in product(words, words):
        script = textdiff.edits(list(a), list(b))
        out, at = [], 0
        for op, i, n, j, m in script:
            assert i == at and j == len(out)
            out += list(b[j : j + m]) if op != "delete" else []
            at += n
        assert "".join(out) == b and at == len(a)
        assert sum(n + m for op, _, n, _, m in script if op != "equal") == len(a) + len(b) - 2 * lcs(a, b)
        assert all(a[i : i + n] == b[j : j + m] for op, i, n, j, m in script if op == "equal")
    assert textdiff.edits(list("abc"), list("aBcd")) == [("equal", 0, 1, 0, 1), ("delete", 1, 1, 1, 0), ("insert", 2, 0, 1, 1), ("equal", 2, 1, 2, 1), ("insert", 3, 0, 3, 1)]
    assert [e[0] for e in textdiff.edits([f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)], budget=1)] == ["delete", "insert"]


def test_unified():
    assert textdiff.unified("a\nb\nc\n", "a\nB\nc") == "--- a\n+++ b\n@@ -1,3 +1,3 @@\n a\n-b\n-c\n+B\n+c\n\\ No newline at end of file\n"
    assert textdiff.unified("x\n", "x\n") == "" and textdiff.unified("", "n\n") == "--- a\n+++ b\n@@ -0,0 +1 @@\n+n\n"


@pytest.mark.parametrize(("text", "lines"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("a\r\n", ["a\r"])])
def test_lines(spark, text, lines):
    assert textdiff.split_lines(text)[0] == lines
    assert spark.range(1).select(textdiff.lines_of(F.lit(text))).first()[0] == lines


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(S.object_id("blob", F.lit("").cast("binary"))) == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    assert get(S.object_id("blob", F.lit("hello\n").cast("binary"))) == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert get(S.normalize_path(F.lit("/a/./b\\c"))) == "a/b/c" and get(S.octal_mode(F.lit(33188))) == "100644"
    assert get(S.extension(F.lit("x/y.CLJ"))) == "clj" and get(S.extension(F.lit("x/y"))) is None
    assert get(S.is_binary(F.unhex(F.lit("6100")))) and not get(S.strict_utf8(F.unhex(F.lit("ff"))))
    with pytest.raises(Exception, match="bad path"):
        get(S.normalize_path(F.lit("a/../b")))


def test_log_and_sides(spark):
    edges = edge_table(spark, DIAMOND)
    tips = spark.createDataFrame([("tip",)], "root string")
    order = {r["place"]: r["commit_id"] for r in graph.log(edges, tips).collect()}
    assert [order[k] for k in range(4)] == ["tip", "left", "right", "root"]
    assert {r["commit_id"] for r in graph.log(edges, tips, 2).collect()} == {"tip", "left"}
    tags = spark.createDataFrame([("root", "a"), ("right", "z"), ("right", "y")], "commit_id string, tag string")
    assert [tuple(r) for r in graph.describe(graph.log(edges, tips), tags).collect()] == [("tip", "y", 2)]
    pairs = spark.createDataFrame([("left", "right"), ("left", "tip"), ("tip", "left"), ("tip", "tip")], "left string, right string")
    assert {tuple(r) for r in graph.ahead_behind(edges, pairs).collect()} == {("left", "right", 1, 1), ("left", "tip", 0, 2), ("tip", "left", 2, 0), ("tip", "tip", 0, 0)}
    assert {r["policy"] for r in graph.pull_policy(edges, pairs).collect()} == {"diverged", "fast-forward", "local-ahead", "up-to-date"}
    three = graph.symmetric_range(edges, pairs.filter("right = 'right'")).collect()
    assert {r["commit_id"] for r in three} == {"left", "right"}


@pytest.mark.parametrize(("specs", "found"), [
    ([], {"a.txt", "d/a.txt", "d/e/b.TXT", "x*y"}), (["*.txt"], {"a.txt", "d/a.txt"}), ([":(glob)*.txt"], {"a.txt"}), ([":(glob)**/*.txt"], {"a.txt", "d/a.txt"}),
    ([":(glob,icase)d/**/*.txt"], {"d/a.txt", "d/e/b.TXT"}), (["d"], {"d/a.txt", "d/e/b.TXT"}), (["d/*", ":!d/e"], {"d/a.txt"}), ([":(literal)x*y"], {"x*y"}), ([":/d/e"], {"d/e/b.TXT"}), (["[ab].txt"], {"a.txt", "d/a.txt"}),
])
def test_pathspec(spark, specs, found):
    paths = spark.createDataFrame([("a.txt",), ("d/a.txt",), ("d/e/b.TXT",), ("x*y",)], "path string")
    assert {r["path"] for r in paths.filter(pathspec.matches(F.col("path"), specs)).collect()} == found


def test_state(spark):
    index, work = tree(spark, a=1, b=2), tree(spark, a=9, n=3)
    staged = {r["path"]: (r["content_id"], r["state"]) for r in state.stage(index, work, F.lit(True)).collect()}
    assert staged == {"a": (9, "present"), "b": (None, "deleted"), "n": (3, "present")}
    assert {r["path"] for r in state.index_tree(state.stage(index, work, F.col("path") == "b")).collect()} == {"a"}
    assert {tuple(r)[:2] for r in state.reset_hard(index, work, tree(spark, a=5)).collect()} == {("a", 5), ("n", 3)}
    blocked = state.checkout_blocked(trees.status(tree(spark, a=1), tree(spark, a=2), tree(spark, a=2, n=1)), tree(spark, n=7))
    assert {tuple(r) for r in blocked.collect()} == {("a", "staged"), ("n", "untracked")}
    refs = state.set_ref(spark.createDataFrame([("x", 1), ("y", 2)], "name string, commit_id long"), "x", 3)
    assert {tuple(r) for r in state.set_ref(refs, "y", None).collect()} == {("x", 3)}
    with pytest.raises(ValueError):
        state.rename(index, "d", "d/e")


def test_ignore(spark):
    found = ignore.rules({"src/.gitignore": "generated/**\n!generated/keep.clj\n", ".gitignore": "# note\n\n*.log  \r\ntarget/\n!important.log\n/build\n\\#x\n[a]\n"})
    wanted = {
        "debug.log": True, "nested/debug.log": True, "important.log": False, "target/classes/a.class": True, "build/output.js": True, "nested/build/output.js": False,
        "src/generated/a.clj": True, "src/generated/keep.clj": False, "#x": True, "a": False, "d/[a]": True,
    }
    paths = spark.createDataFrame([(p,) for p in wanted], "path string")
    assert {r[0]: r[1] for r in paths.select("path", ignore.ignored(F.col("path"), found)).collect()} == wanted
