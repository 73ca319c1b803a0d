"""Queries over all commits against their SQL."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from commitlake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["m02_plan_all_trees", "g13_contains_roots"])
def test_all_commits(spark, name):
    db = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = catalog.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = db.execute(f"SELECT {columns} FROM ({catalog.ORACLES[name]})").fetchall()
    assert want and Counter(tuple(r) for r in got.collect()) == Counter(want)
    if name.startswith("m02"):
        assert len({r[0] for r in want}) > 100


def test_checkouts_meet_their_trees_once(spark):
    """Blocked by staged, unstaged and untracked files, or switched; and the tree is put together once, for status and merges too."""
    from pyspark.sql import functions as F

    from commitlake import registry
    from commitlake.operators import state, trees

    def side(*rows):
        return spark.createDataFrame([(c, p, i, 0, 0) for c, p, i in rows], "commit_id long, path string, content_id long, size long, mode int")

    base = [(c, "a", 1) for c in (1, 2, 3, 4)]
    head, index = side(*base, (5, None, 1)), side(*base[1:], (1, "a", 2), (5, None, 1))
    work, target = side(base[0], (2, "a", 3), *base[2:], (3, "n", 1), (4, "n", 1), (4, "m", 1)), side(*base[:3], (3, "n", 2), (4, "b", 5), (4, "m", 6), (4, "a", 9))
    keys = ["commit_id", "path"]
    sides = trees.met(trees.tagged([head, index, work, target], keys), ["head", "index", "work", "target"], keys)
    assert {tuple(r) for r in state.blocking(sides, keys).collect()} == {(1, "a", "staged"), (2, "a", "unstaged"), (3, "n", "untracked"), (4, "m", "untracked"), (5, None, "staged")}
    free = sides.filter("commit_id <> 4 or path <> 'm'")
    assert {tuple(r)[:3] for r in state.checkout(free, keys, ["commit_id"]).collect()} == {(4, "a", 9), (4, "b", 5), (4, "n", 1)}
    assert {tuple(r)[:3] for r in state.checkout(free, keys, ["commit_id"], force=True).filter("commit_id = 3").collect()} == {(3, "a", 1), (3, "n", 2)}
    assert not state.checkout(sides, keys).take(1) and state.checkout(free.filter("commit_id = 4"), keys).count() == 3
    alone = sides.filter("path is null")  # null paths meet nothing, as in a join
    assert alone.count() == 2 and not alone.filter(F.col("head").isNotNull() & F.col("index").isNotNull()).take(1)
    for name in ("k13_checkout", "k13_checkout_blocked", "t03_status_of_all", "m02_plan_all_trees"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert sum("FileScan" in line and "l_partkey" in line for line in plan.splitlines()) == 1


def test_closure_of_all_commits(spark):
    """Every commit is a root, in the query and in its SQL; the SQL of queries about some roots keeps them."""
    from commitlake import registry

    roots = registry.queries()["g02_transitive_closure"](spark, SF).select("root").distinct().collect()
    assert {r[0] for r in roots} == {r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()}
    assert catalog.ROOTS not in registry.oracle_sql()["g02_transitive_closure"] and catalog.ROOTS in registry.oracle_sql()["g01_distances"]
    test_all_commits(spark, "g02_transitive_closure")
