"""Reachability over the commit graph.

Traversals are breadth-first and for many roots at once.  The graph is cut into
its connected components; a component of up to ``COMPONENT_ROWS`` edges and roots
is walked whole by one task, root by root, so its depth costs no jobs (the roots
of a component that has long walks from many of them are dealt to several tasks,
each with all its edges).  A task reads its components one after another and holds one of them at a time.  Only
larger components are walked level by level: one join of the frontier with the
edges and one aggregation for each level, the levels written to the shared folder.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..plans.cut import materialize
from .components import connected_components

#: Edges, roots and stops of a component that one task may hold.
COMPONENT_ROWS = 2_000_000
#: Rows times roots of a component beyond which its roots are dealt to several tasks, and how many these may be, as each gets all its edges.
COMPONENT_STEPS, PARTS = 20_000_000, 64
_OUT = 20_000  # rows of a batch
EDGE, ROOT, STOP = 0, 1, 2


def _walk_components(limit: int | None, most: int | None):
    """Walks the (component, kind, a, b, ord) of components one after another: every root's commits in first-in-first-out order."""

    def walked(steps: dict, roots: set, stops: dict) -> Iterator[tuple]:
        steps = {a: list(dict.fromkeys(b for _, b in sorted(found))) for a, found in steps.items()}
        for root in roots:
            stopped = stops.get(root, ())
            seen, queue = {root}, deque([(root, 0)] if root not in stopped else [])
            place = 0
            while queue and (most is None or place < most):
                node, distance = queue.popleft()
                yield root, node, distance, place
                place += 1
                if limit is None or distance < limit:
                    for far in steps.get(node, ()):
                        if far not in seen and far not in stopped:
                            seen.add(far)
                            queue.append((far, distance + 1))

    def rows(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[tuple]:
        steps, roots, stops, now = defaultdict(list), set(), defaultdict(set), None
        for batch in batches:
            kinds[:] = [batch.schema.field("a").type]
            for component, kind, a, b, ord in zip(*(batch.column(c).to_pylist() for c in ("component", "kind", "a", "b", "ord"))):
                if component != now:
                    yield from walked(steps, roots, stops)
                    steps, roots, stops, now = defaultdict(list), set(), defaultdict(set), component
                if kind == EDGE:
                    steps[a].append((ord, b))
                elif kind == ROOT:
                    roots.add(a)
                else:
                    stops[a].add(b)
        yield from walked(steps, roots, stops)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = []
        found = rows(batches, kinds)
        while held := list(islice(found, _OUT)):
            yield _rows(held, kinds[0])

    return run


def _rows(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = (kind, kind, pa.int64(), pa.int64())
    columns = zip(*held) if held else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["root", "commit_id", "distance", "place"])


def _walked(edges: DataFrame, roots: DataFrame, limit: int | None, forward: bool, stop: DataFrame | None, most: int | None,
            labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(root, commit_id, distance, place) in components that a task may hold, and the edges and roots of the others, if any."""
    near, far = ("commit_id", "parent_id") if forward else ("parent_id", "commit_id")
    ids = edges.schema["commit_id"].dataType
    turn = F.col("ord").cast("long") if "ord" in edges.columns else F.lit(0).cast("long")
    nothing = F.lit(0).cast("long")
    starts = roots.select(F.col("root").cast(ids).alias("root")).dropna().distinct()
    ends = starts.select(F.lit(ROOT).alias("kind"), F.col("root").alias("a"), F.col("root").alias("b"), nothing.alias("ord"))
    if stop is not None:
        ends = ends.unionByName(stop.select(F.lit(STOP).alias("kind"), F.col("root").cast(ids).alias("a"), F.col("commit_id").cast(ids).alias("b"), nothing.alias("ord")).distinct())
    labels = (connected_components(edges, "commit_id", "parent_id") if labels is None else labels).withColumnRenamed("node", "a")
    ends = materialize(ends.join(labels, "a", "left").withColumn("component", F.coalesce("label", "a")).drop("label"), "walk-ends")
    # Edges of components without a root are not looked at; a node without a label has no edge but loops, which lead nowhere.
    rooted = labels.withColumnRenamed("label", "component").join(ends.filter(F.col("kind") == ROOT).select("component").distinct(), "component", "left_semi")
    steps = edges.select(F.lit(EDGE).alias("kind"), F.col(near).alias("a"), F.col(far).alias("b"), turn.alias("ord")).dropna()
    rows = materialize(steps.join(rooted, "a").unionByName(ends), "walk-rows")
    sizes = rows.groupBy("component").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == ROOT).alias("roots")).filter("roots > 0")
    long = (F.col("n") if most is None else F.least("n", F.lit(most))) * F.col("roots")
    parts = F.least(F.col("roots"), F.lit(PARTS), F.ceil(long / COMPONENT_STEPS)).cast("int")
    sizes = materialize(sizes.withColumn("parts", parts), "walk-components")
    held, large = sizes.filter(F.col("n") <= COMPONENT_ROWS), sizes.filter(F.col("n") > COMPONENT_ROWS)
    some = sizes.agg(F.max("n"), F.max(F.when(F.col("n") <= COMPONENT_ROWS, F.col("parts")))).first()
    # The semi join leaves few of the rows, so these are dealt again; the sort reads whole components in a row.
    small, tasks = rows.join(held, "component", "left_semi"), []
    if (some[1] or 0) > 1:
        # Few rows make long walks: a given number of tasks is not brought down.
        tasks = [int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))]
        part = F.when(F.col("kind") == EDGE, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")))
        small = small.join(held.select("component", "parts"), "component").withColumn("part", F.explode(part)).withColumn("component", F.concat_ws(":", "component", "part"))
    small = small.repartition(*tasks, "component").sortWithinPartitions("component")
    schema = T.StructType([T.StructField("root", ids), T.StructField("commit_id", ids), T.StructField("distance", T.LongType()), T.StructField("place", T.LongType())])
    done = small.select("component", "kind", "a", "b", "ord").mapInArrow(_walk_components(limit, most), schema)
    if (some[0] or 0) <= COMPONENT_ROWS:
        return done, None, None
    rest = rows.join(large, "component", "left_semi")
    ends = rest.filter(F.col("kind") == EDGE).select(F.col("a").alias(near), F.col("b").alias(far), "ord")
    return done, ends, rest.filter(F.col("kind") == ROOT).select(F.col("a").alias("root"))


def distances(edges: DataFrame, roots: DataFrame, limit: int | None = None, forward: bool = True, stop: DataFrame | None = None,
              labels: DataFrame | None = None) -> DataFrame:
    """(root, commit_id, distance) of every commit reachable from ``roots(root)``, the root itself at 0.

    ``forward`` follows parents, otherwise children.  Commits in
    ``stop(root, commit_id)`` are neither kept nor passed.  ``labels`` are the
    edges' ``connected_components``, where the caller has them.
    """
    done, ends, others = _walked(edges, roots, limit, forward, stop, None, labels)
    done = done.select("root", "commit_id", "distance")
    return done if ends is None else done.unionByName(_by_levels(ends, others, limit, forward, stop))


def _by_levels(edges: DataFrame, roots: DataFrame, limit: int | None, forward: bool, stop: DataFrame | None) -> DataFrame:
    """``distances`` by one join and one written table a level."""
    near, far = ("commit_id", "parent_id") if forward else ("parent_id", "commit_id")
    step = edges.select(F.col(near).alias("near"), F.col(far).alias("far")).distinct()
    step = materialize(step, "edges")
    start = roots.select("root", F.col("root").alias("commit_id"), F.lit(0).cast("long").alias("distance")).distinct()
    if stop is not None:
        start = start.join(stop, ["root", "commit_id"], "left_anti")
    frontier = materialize(start, "level")
    seen, level = frontier, 0
    while frontier.take(1) and (limit is None or level < limit):
        level += 1
        reached = frontier.join(step, F.col("commit_id") == F.col("near")).select("root", F.col("far").alias("commit_id")).distinct()
        fresh = reached.join(seen, ["root", "commit_id"], "left_anti")
        if stop is not None:
            fresh = fresh.join(stop, ["root", "commit_id"], "left_anti")
        frontier = materialize(fresh.withColumn("distance", F.lit(level).cast("long")), "level")
        seen = seen.unionByName(frontier)
    return seen


def merge_bases(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right, base, cost) for ``pairs(left, right)``: least summed distance, ties to the smallest id; null without one."""
    return _bases(pairs, _far(edges, pairs))


def _bases(pairs: DataFrame, far: DataFrame) -> DataFrame:
    a = far.select(F.col("root").alias("left"), "commit_id", F.col("distance").alias("d1"))
    b = far.select(F.col("root").alias("right"), "commit_id", F.col("distance").alias("d2"))
    common = pairs.distinct().join(a, "left").join(b, ["right", "commit_id"])
    cost = F.col("d1") + F.col("d2")
    best = common.groupBy("left", "right").agg(F.min_by("commit_id", F.struct(cost, F.col("commit_id").cast("string"))).alias("base"), F.min(cost).alias("cost"))
    return pairs.distinct().join(best, ["left", "right"], "left")


def is_ancestor(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right, is_ancestor): whether left is reachable from right."""
    far = distances(edges, pairs.select(F.col("right").alias("root"))).select(F.col("root").alias("right"), F.col("commit_id").alias("left"), F.lit(True).alias("found"))
    return pairs.distinct().join(far, ["left", "right"], "left").select("left", "right", F.coalesce("found", F.lit(False)).alias("is_ancestor"))


def lowest_common_ancestors(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right, commit_id): common ancestors that are no proper ancestor of another common one."""
    far = _far(edges, pairs)
    a, b = far.select(F.col("root").alias("left"), "commit_id"), far.select(F.col("root").alias("right"), "commit_id")
    common = materialize(pairs.distinct().join(a, "left").join(b, ["right", "commit_id"]), "common")
    # Ancestors of a common ancestor are common too, so a parent of a common one is never lowest, and only parents need to be looked at.
    parents = common.join(edges, "commit_id").select("left", "right", F.col("parent_id").alias("commit_id"))
    return common.join(parents, ["left", "right", "commit_id"], "left_anti").select("left", "right", "commit_id")


def reachable_not(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``A..B`` for ``pairs(left, right)``: (left, right, commit_id) reachable from right and not from left."""
    far = _far(edges, pairs)
    inside = pairs.distinct().join(far.select(F.col("root").alias("right"), "commit_id"), "right")
    return inside.join(far.select(F.col("root").alias("left"), "commit_id"), ["left", "commit_id"], "left_anti").select("left", "right", "commit_id")


def roots(commits: DataFrame, edges: DataFrame) -> DataFrame:
    return commits.select("commit_id").join(edges, "commit_id", "left_anti")


def merges(edges: DataFrame) -> DataFrame:
    """Commits with two or more different parents."""
    return edges.groupBy("commit_id").agg(F.count_distinct("parent_id").alias("parents")).filter("parents >= 2")


def nth_ancestor(edges: DataFrame, starts: DataFrame, count: int) -> DataFrame:
    """``~count``: (root, commit_id) along first parents."""
    first = edges.filter("ord = 0").select("commit_id", "parent_id")
    out = starts.select("root", F.col("root").alias("commit_id"))
    for _ in range(count):
        out = out.join(first, "commit_id").select("root", F.col("parent_id").alias("commit_id"))
    return out


def log(edges: DataFrame, roots: DataFrame, limit: int | None = 100) -> DataFrame:
    """(root, commit_id, place): breadth-first order from each root, parents in their order, at most ``limit`` for a root."""
    done, ends, others = _walked(edges, roots, None, True, None, limit)
    done = done.select("root", "commit_id", "place")
    return done if ends is None else done.unionByName(_log_by_levels(ends, others, limit))


def _log_by_levels(edges: DataFrame, roots: DataFrame, limit: int | None) -> DataFrame:
    """``log`` by levels.

    Within a level a commit's place follows the way of parent positions that
    first reaches it; places are ranks of (level, way).  A way takes three
    characters a level, and one task ranks a root's reached commits.  There are at
    most ``limit`` levels; without a limit, both grow with the root's history.
    """
    step = materialize(edges.select("commit_id", "parent_id", F.lpad(F.col("ord").cast("string"), 3, "0").alias("turn")), "turns")
    seen = frontier = materialize(roots.select("root", F.col("root").alias("commit_id"), F.lit(0).alias("level"), F.lit("").alias("way")).distinct(), "level")
    level = 0
    while frontier.take(1) and (limit is None or level < limit):
        level += 1
        reached = frontier.join(step, "commit_id").groupBy("root", F.col("parent_id").alias("commit_id")).agg(F.min(F.concat("way", "turn")).alias("way"))
        fresh = reached.join(seen, ["root", "commit_id"], "left_anti")
        frontier = materialize(fresh.select("root", "commit_id", F.lit(level).alias("level"), "way"), "level")
        seen = seen.unionByName(frontier)
    placed = seen.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("level", "way")).cast("long") - 1)
    return (placed if limit is None else placed.filter(F.col("place") < limit)).select("root", "commit_id", "place")


def describe(log: DataFrame, tags: DataFrame) -> DataFrame:
    """(root, tag, n): the tag first met in the log, by name among those of one commit, and its place."""
    return log.join(tags, "commit_id").groupBy("root").agg(F.min_by("tag", F.struct("place", "tag")).alias("tag"), F.min("place").alias("n"))


def _far(edges: DataFrame, pairs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(root, commit_id, distance) from both ends of all pairs, as a written table."""
    ends = pairs.select(F.explode(F.array("left", "right")).alias("root")).distinct()
    return materialize(distances(edges, ends, labels=labels), "ancestors")


def _of(pairs: DataFrame, far: DataFrame, end: str) -> DataFrame:
    return pairs.distinct().join(far.withColumnRenamed("root", end), end).select("left", "right", "commit_id")


def ahead_behind(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right, ahead, behind): numbers of commits that only left, and only right, reaches."""
    far = _far(edges, pairs)
    nothing, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    sides = _of(pairs, far, "left").withColumns({"l": one, "r": nothing}).unionByName(_of(pairs, far, "right").withColumns({"l": nothing, "r": one}))
    met = sides.groupBy("left", "right", "commit_id").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return met.groupBy("left", "right").agg(F.sum(F.greatest(F.col("l") - F.col("r"), nothing)).alias("ahead"),
                                            F.sum(F.greatest(F.col("r") - F.col("l"), nothing)).alias("behind"))


def symmetric_range(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``A...B``: (left, right, commit_id) that either side reaches and their merge base does not."""
    edges, pairs = materialize(edges, "walk-edges"), materialize(pairs, "pairs")
    labels = connected_components(edges, "commit_id", "parent_id")
    far = _far(edges, pairs, labels)
    bases = materialize(_bases(pairs, far).select("left", "right", "base"), "bases")
    either = _of(pairs, far, "left").unionByName(_of(pairs, far, "right")).distinct()
    below = distances(edges, bases.filter("base is not null").select(F.col("base").alias("root")), labels=labels).select(F.col("root").alias("base"), "commit_id")
    return either.join(bases, ["left", "right"]).join(below, ["base", "commit_id"], "left_anti").select("left", "right", "commit_id")


def pull_policy(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right, policy) of a local and a remote tip: up-to-date, fast-forward, local-ahead or diverged."""
    counts = ahead_behind(edges, pairs)
    # A tip reaches itself, so one side has no commit of its own exactly when the other reaches its tip.
    policy = (
        F.when((F.col("ahead") == 0) & (F.col("behind") == 0), "up-to-date").when(F.col("ahead") == 0, "fast-forward")
        .when(F.col("behind") == 0, "local-ahead").otherwise("diverged")
    )
    return counts.select("left", "right", policy.alias("policy"))


def transfer_contents(edges: DataFrame, pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """(left, right, content_id) in commits that right reaches and left does not, without contents that left's commits have."""
    far = _far(edges, pairs)
    contents = tree.select("commit_id", "content_id").distinct()
    had = far.join(contents, "commit_id").select(F.col("root").alias("left"), "content_id").distinct()
    sent = _of(pairs, far, "right").join(far.withColumnRenamed("root", "left"), ["left", "commit_id"], "left_anti")
    return sent.join(contents, "commit_id").select("left", "right", "content_id").distinct().join(had, ["left", "content_id"], "left_anti").select("left", "right", "content_id")


def range_pairs(edges: DataFrame, ranges: DataFrame) -> DataFrame:
    """(left, right, dots, before, after) for ``ranges(left, right, dots)``: two dots compare left with right, three their merge base with right."""
    bases = merge_bases(edges, ranges.filter("dots = 3").select("left", "right").distinct()).select("left", "right", "base")
    joined = ranges.join(bases, ["left", "right"], "left")
    return joined.select("left", "right", "dots", F.when(F.col("dots") == 3, F.col("base")).otherwise(F.col("left")).alias("before"), F.col("right").alias("after"))
