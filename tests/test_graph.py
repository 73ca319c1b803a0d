"""Traversals by component and by level, and a long history."""

from __future__ import annotations

import random
import time
from collections import deque

import pyarrow as pa
import pytest

from commitlake.operators import components, graph


def brute(edges, root):
    parents = {}
    for c, p, o in sorted(edges, key=lambda e: e[2]):
        parents.setdefault(c, []).append(p)
    seen, queue, out = {root}, deque([(root, 0)]), []
    while queue:
        node, d = queue.popleft()
        out.append((root, node, d))
        for p in parents.get(node, []):
            if p not in seen:
                seen.add(p)
                queue.append((p, d + 1))
    return out


@pytest.mark.parametrize("rows", [0, 60, 2_000_000])
def test_random_histories(spark, monkeypatch, rows):
    """The same result whether components are walked by a task or by levels."""
    monkeypatch.setattr(graph, "COMPONENT_ROWS", rows)
    rng, edges = random.Random(3), []
    for base, size in ((0, 60), (100, 8), (200, 2)):
        for i in range(1, size):
            edges += [(base + i, base + p, k) for k, p in enumerate(rng.sample(range(i), min(i, rng.choice([1, 1, 2]))))]
    table = spark.createDataFrame(edges, "commit_id long, parent_id long, ord int")
    starts = [59, 30, 107, 201, 999]
    roots = spark.createDataFrame([(r,) for r in starts], "root long")
    want = [x for r in starts for x in brute(edges, r)]
    assert sorted(map(tuple, graph.distances(table, roots).collect())) == sorted(want)
    order = sorted((r["root"], r["place"], r["commit_id"]) for r in graph.log(table, roots, 20).collect())
    assert order == sorted((r, i, x[1]) for r in starts for i, x in enumerate(brute(edges, r)[:20]))
    back = graph.distances(table, spark.createDataFrame([(0,)], "root long"), forward=False)
    assert {r["commit_id"] for r in back.collect()} == set(range(60))


def test_long_chain(spark):
    edges = spark.range(1, 3500).selectExpr("id AS commit_id", "id - 1 AS parent_id", "0 AS ord")
    began = time.time()
    rows = graph.distances(edges, spark.createDataFrame([(3499,)], "root long")).agg({"distance": "max", "commit_id": "count"}).first()
    assert sorted(rows) == [3499, 3500] and time.time() - began < 120
    print(time.time() - began)


def smallest(edges):
    """The smallest node of its component, for each node."""
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            least = min(label[u], label[v])
            if (label[u], label[v]) != (least, least):
                label[u] = label[v] = least
                changed = True
    return label


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_components_over_partitions(spark, coalesced):
    """A chain, a ring, a tree and random edges; edges in one partition and spread over all."""
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 20) for i in range(20)] + [(200 + i // 2, 200 + i) for i in range(1, 40)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    rng.shuffle(edges)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        got = components.connected_components(spark.createDataFrame(edges + edges[:9], "a long, b long"), "a", "b").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["label"] for r in got} == smallest(edges)


@pytest.mark.parametrize("held", [2, 10, 1000])
def test_joined_edges_keep_components(monkeypatch, held):
    """Stars join the same nodes, however few nodes a task holds at once."""
    monkeypatch.setattr(components, "HELD", held)
    rng = random.Random(held)
    edges = [e for e in ((rng.randrange(80), rng.randrange(80)) for _ in range(70)) if e[0] != e[1]]
    batches = [pa.RecordBatch.from_pydict({"u": [max(e) for e in edges[i:i + 7]], "v": [min(e) for e in edges[i:i + 7]]}) for i in range(0, len(edges), 7)]
    stars = [(r["u"], r["v"]) for b in components._joined(iter(batches)) for r in b.to_pylist()]
    assert all(u > v for u, v in stars) and smallest(stars) == smallest(edges)


def test_components_in_a_row_stay_whole(monkeypatch):
    """A task that holds few nodes leaves none of the components that it reads one after another in two stars."""
    monkeypatch.setattr(components, "HELD", 40)
    edges = [(10 * k + i + 1, 10 * k + i) for k in range(40) for i in range(5)]
    batches = [pa.RecordBatch.from_pydict({"u": [e[0] for e in edges[i:i + 3]], "v": [e[1] for e in edges[i:i + 3]]}) for i in range(0, len(edges), 3)]
    stars = [(r["u"], r["v"]) for b in components._joined(iter(batches)) for r in b.to_pylist()]
    assert sorted(stars) == sorted((10 * k + i, 10 * k) for k in range(40) for i in range(1, 6))


def test_one_call_walks_many_components():
    """Components come to a task in a row, over the ends of batches; each is walked by itself."""
    rows = [(c, k, a, b, 0) for c in (0, 100, 200) for k, a, b in ((graph.ROOT, c + 2, c + 2), (graph.EDGE, c + 2, c + 1), (graph.EDGE, c + 1, c))]
    names = ("component", "kind", "a", "b", "ord")
    batches = [pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows[i:i + 2]))))) for i in range(0, len(rows), 2)]
    found = [tuple(r.values()) for b in graph._walk_components(None, None)(iter(batches)) for r in b.to_pylist()]
    assert sorted(found) == sorted((c + 2, c + 2 - d, d, d) for c in (0, 100, 200) for d in range(3))


def test_rebases_ask_only_for_their_trees(spark):
    """The trees of replayed commits, their first parents and left, of a history with others."""
    from commitlake.operators import workflow

    edges = spark.createDataFrame([(2, 1, 0), (3, 2, 0), (4, 1, 0), (5, 4, 0), (8, 9, 0), (9, 3, 0)], "commit_id long, parent_id long, ord int")
    rows = [(1, "a", 1), (2, "a", 2), (3, "a", 2), (4, "a", 1), (4, "b", 1), (5, "a", 7), (5, "b", 1), (8, "a", 9), (9, "a", 9)]
    tree = spark.createDataFrame([(c, p, i, 0, 0) for c, p, i in rows], "commit_id long, path string, content_id long, size long, mode int")
    asked = set()

    def trees_of(commits):
        asked.update(r[0] for r in commits.collect())
        return tree.join(commits.distinct(), "commit_id", "left_semi")

    pairs, commits = spark.createDataFrame([(3, 5)], "left long, right long"), tree.select("commit_id").distinct()
    assert [tuple(r) for r in workflow.rebase_plans(edges, pairs, commits, trees_of).collect()] == [(3, 5, 2, 2)] and asked == {1, 3, 4, 5}


def test_merges_ask_only_for_their_trees(spark):
    """The trees of the pairs and their bases, of a history with others."""
    from commitlake.operators import workflow

    edges = spark.createDataFrame([(2, 1, 0), (3, 2, 0), (4, 1, 0), (8, 9, 0), (9, 3, 0)], "commit_id long, parent_id long, ord int")
    rows = [(1, "a", 1), (1, "b", 1), (2, "a", 2), (3, "a", 2), (3, "b", 1), (4, "a", 3), (4, "b", 5), (8, "a", 9), (9, "a", 9)]
    tree = spark.createDataFrame([(c, p, i, 0, 0) for c, p, i in rows], "commit_id long, path string, content_id long, size long, mode int")
    asked = set()

    def trees_of(commits):
        asked.update(r[0] for r in commits.collect())
        return tree.join(commits.distinct(), "commit_id", "left_semi")

    plans, _ = workflow.merge_plans(edges, spark.createDataFrame([(3, 4), (4, 77)], "left long, right long"), trees_of)
    assert {tuple(r) for r in plans.collect()} == {(3, 4, 1, "conflict", 2, 1), (4, 77, None, "unrelated", 2, 0)} and asked == {1, 3, 4, 77}


def test_only_components_with_roots_are_walked(spark, monkeypatch):
    """Edges of other components are not written; a root on a loop and one without an edge reach themselves."""
    from commitlake.operators import graph

    written, write = {}, graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    edges = spark.createDataFrame([(2, 1, 0), (3, 2, 0), (12, 11, 0), (7, 7, 0)], "commit_id long, parent_id long, ord int")
    got = graph.distances(edges, spark.createDataFrame([(3,), (7,), (20,)], "root long"))
    assert {tuple(r) for r in got.collect()} == {(3, 3, 0), (3, 2, 1), (3, 1, 2), (7, 7, 0), (20, 20, 0)}
    assert written["walk-rows"].count() == 5


def test_roots_of_long_components_are_dealt(spark, monkeypatch):
    """All roots of a long component are not one task's; distances, logs and stops stay the same."""
    monkeypatch.setattr(graph, "COMPONENT_STEPS", 500)
    rng = random.Random(12)
    edges = [(base + i, base + p, k) for base, size in ((0, 90), (1000, 5), (2000, 40)) for i in range(1, size) for k, p in enumerate(rng.sample(range(i), min(i, rng.choice([1, 2]))))]
    table = spark.createDataFrame(edges, "commit_id long, parent_id long, ord int")
    starts = [*range(90), *range(1000, 1005), 2039, 7777]
    roots = spark.createDataFrame([(r,) for r in starts], "root long")
    got = graph.distances(table, roots)
    assert sorted(map(tuple, got.collect())) == sorted(x for r in starts for x in brute(edges, r))
    keys = {k for part in got.rdd.glom().collect() for k in [frozenset(r["root"] for r in part if r["root"] < 90)] if k}
    assert len(keys) > 1 and sum(map(len, keys)) == 90
    order = sorted((r["root"], r["place"], r["commit_id"]) for r in graph.log(table, roots, 20).collect())
    assert order == sorted((r, i, x[1]) for r in starts for i, x in enumerate(brute(edges, r)[:20]))
    stop = spark.createDataFrame([(80, 0), (80, 1), (2039, 2000)], "root long, commit_id long")
    kept = {(r["root"], r["commit_id"]) for r in graph.distances(table, roots, stop=stop).collect()}
    assert {c for r, c in kept if r == 79} == {x[1] for x in brute(edges, 79)} and not kept & {(80, 0), (80, 1), (2039, 2000)} and {r for r, _ in kept} == set(starts)
