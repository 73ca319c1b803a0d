"""Commands that move refs and trees: commits, ref requests, merges, rebases, stashes and publication.

All take relations and return relations, many commands at once; the caller
writes the result as the next version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.cut import materialize
from . import graph
from .trees import FIELDS, commit_changes, merge_trees, side


def commit(requests: DataFrame, index: DataFrame, refs: DataFrame, tree: DataFrame) -> dict[str, DataFrame]:
    """Commits of ``requests(commit_id, name, author, time, message, amend)`` onto the refs they name.

    ``index(commit_id, path, fields.., state)`` is what each has staged.  A
    request fails if its message is blank or, without ``amend``, nothing is
    staged against the ref's tree.  An unborn ref has an empty tree.  An amended
    commit keeps the parents of the one it replaces, which ``amended_edges``
    takes from the edges.  Results: outcomes(commit_id, outcome), commits, edges,
    tree (of the new commits) and refs (all of them).
    """
    asked = requests.join(refs.withColumnRenamed("commit_id", "head"), "name", "left")
    now = index.filter("state = 'present'").select("commit_id", "path", *FIELDS)
    before = tree.withColumnRenamed("commit_id", "head").join(asked.select("commit_id", "head"), "head")
    keys = ["commit_id", "path"]
    both = side(before, keys, "old").join(side(now, keys, "new"), keys, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    staged = both.groupBy("commit_id").agg(F.count("*").alias("staged"))
    outcome = F.when(F.trim(F.coalesce("message", F.lit(""))) == "", "blank message").when((F.coalesce("staged", F.lit(0)) == 0) & ~F.col("amend"), "nothing staged").otherwise("committed")
    judged = materialize(asked.join(staged, "commit_id", "left").withColumn("outcome", outcome), "commit-outcomes")
    made = judged.filter("outcome = 'committed'")
    moved = made.groupBy("name").agg(F.max("commit_id").alias("commit_id"))
    return {
        "outcomes": judged.select("commit_id", "outcome"),
        "commits": made.select("commit_id", "author", "time", "message"),
        "edges": made.filter("head is not null and not amend").select("commit_id", F.col("head").alias("parent_id"), F.lit(0).alias("ord")),
        "replaced": made.filter("head is not null and amend").select("commit_id", F.col("head").alias("old_id")),
        "tree": now.join(made.select("commit_id"), "commit_id", "left_semi"),
        "refs": refs.join(moved, "name", "left_anti").select("name", "commit_id").unionByName(moved),
    }


def amended_edges(replaced: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges of commits that replace others: the parents of these."""
    return edges.withColumnRenamed("commit_id", "old_id").join(replaced, "old_id").select("commit_id", "parent_id", "ord")


def ref_requests(refs: DataFrame, requests: DataFrame, head: str) -> DataFrame:
    """(action, name, outcome, commit_id) of ``requests(action, name, target, force)``; ``commit_id`` is the ref's value afterwards.

    create fails where the name exists, unless forced; delete fails for the
    current branch, for unknown names, and unless forced where the branch is not
    at the current one's commit; set needs an existing name.
    """
    now = refs.select("name", F.col("commit_id").alias("old"))
    tip = refs.filter(F.col("name") == head).agg(F.max("commit_id").alias("tip"))
    joined = requests.join(now, "name", "left").join(F.broadcast(tip))  # one row
    there, action = F.col("old").isNotNull(), F.col("action")
    outcome = (
        F.when((action == "create") & there & ~F.col("force"), "exists").when((action == "delete") & ~there, "unknown").when((action == "delete") & (F.col("name") == head), "current branch")
        .when((action == "delete") & ~F.col("force") & ~F.col("old").eqNullSafe(F.col("tip")), "not merged").when((action == "set") & ~there, "unknown").otherwise("done")
    )
    after = F.when(F.col("outcome") != "done", F.col("old")).when(action != "delete", F.col("target"))
    return joined.withColumn("outcome", outcome).select("action", "name", "outcome", after.alias("commit_id"))


def merge_plans(edges: DataFrame, pairs: DataFrame, trees_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Plans (left, right, base, kind, paths, conflicts) of merging right into left, and the merged paths of all of them.

    ``kind``: up-to-date (the base is right), fast-forward (the base is left),
    unrelated (no base), conflict, or merge.  ``trees_of(commits)`` gives the
    trees of commits, here of the pairs' and their bases.
    """
    edges, pairs = materialize(edges, "walk-edges"), materialize(pairs.distinct(), "pairs")
    bases = materialize(graph.merge_bases(edges, pairs).select("left", "right", "base"), "merge-bases")

    needed = bases.select(F.explode(F.array("base", "left", "right")).alias("commit_id")).dropna()
    tree = materialize(trees_of(needed), "merged-trees")

    def of(column: str) -> DataFrame:
        return tree.withColumnRenamed("commit_id", column).join(bases, column).select("left", "right", "path", *FIELDS)

    merged = materialize(merge_trees(of("base"), of("left"), of("right"), ["left", "right", "path"]), "merged-paths")
    counts = merged.groupBy("left", "right").agg(F.count("*").alias("paths"), F.count_if("conflict").alias("conflicts"))
    kind = (
        F.when(F.col("base").isNull(), "unrelated").when(F.col("base") == F.col("right"), "up-to-date").when(F.col("base") == F.col("left"), "fast-forward")
        .when(F.col("conflicts") > 0, "conflict").otherwise("merge")
    )
    nothing = F.lit(0).cast("long")
    plans = bases.join(counts, ["left", "right"], "left").withColumns({"paths": F.coalesce("paths", nothing), "conflicts": F.coalesce("conflicts", nothing)})
    return plans.select("left", "right", "base", kind.alias("kind"), "paths", "conflicts"), merged


def rebase_plans(edges: DataFrame, pairs: DataFrame, commits: DataFrame, trees_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(left, right, commits, stopped_at) of replaying ``left..right`` onto left, farthest from right first, ties by id.

    A replayed change needs its old side: what the last replayed change of the
    path left there, or else what left has.  ``stopped_at`` is the number of the
    first commit with a change that does not fit, null if all fit.
    ``trees_of(commits)`` gives the trees of commits, here of the replayed ones,
    their first parents and left.
    """
    edges, pairs = materialize(edges, "walk-edges"), materialize(pairs.distinct(), "pairs")
    far = materialize(graph.distances(edges, pairs.select(F.explode(F.array("left", "right")).alias("root")).distinct()), "rebase-reach")
    inside = pairs.join(far.withColumnRenamed("root", "right"), "right").join(far.select(F.col("root").alias("left"), "commit_id"), ["left", "commit_id"], "left_anti")
    order = Window.partitionBy("left", "right").orderBy(F.desc("distance"), "commit_id")
    replay = materialize(inside.withColumn("n", F.row_number().over(order).cast("long")), "rebase-commits")
    replayed = materialize(replay.select("commit_id").distinct(), "replayed")
    first = materialize(edges.filter("ord = 0").join(replayed, "commit_id", "left_semi"), "replayed-edges")
    needed = replayed.unionByName(first.select(F.col("parent_id").alias("commit_id"))).unionByName(pairs.select(F.col("left").alias("commit_id")))
    tree = materialize(trees_of(needed), "replayed-trees")
    changed = commit_changes(tree, commits.join(replayed, "commit_id", "left_semi"), first)
    steps = replay.join(changed.select("commit_id", "path", "before", "after"), "commit_id")
    path = Window.partitionBy("left", "right", "path").orderBy("n")
    now = side(tree.withColumnRenamed("commit_id", "left"), ["left", "path"], "now")
    steps = steps.withColumns({"k": F.row_number().over(path), "last": F.lag("after").over(path)}).join(now, ["left", "path"], "left")
    fits = F.col("before").eqNullSafe(F.when(F.col("k") == 1, F.col("now")).otherwise(F.col("last")))
    stops = steps.filter(~fits).groupBy("left", "right").agg(F.min("n").alias("stopped_at"))
    counts = replay.groupBy("left", "right").agg(F.count("*").alias("commits"))
    return pairs.join(counts, ["left", "right"], "left").join(stops, ["left", "right"], "left").select("left", "right", F.coalesce("commits", F.lit(0)).alias("commits"), "stopped_at")


STASH = "^refs/stash/([0-9]+)/(base|index|work)$"


def stash_records(refs: DataFrame) -> DataFrame:
    """(key, base, index, work, place) of stashes kept as three refs each; place 0 is the newest, incomplete ones are left out."""
    parts = refs.select(F.regexp_extract("name", STASH, 1).alias("key"), F.regexp_extract("name", STASH, 2).alias("part"), "commit_id").filter("key <> ''")
    one = lambda p: F.max(F.when(F.col("part") == p, F.col("commit_id"))).alias(p)
    found = parts.groupBy(F.col("key").cast("long").alias("key")).agg(*[one(p) for p in ("base", "index", "work")]).dropna()
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("key"))).cast("long") - 1)  # a user's stashes


def publish(edges: DataFrame, refs: DataFrame, requests: DataFrame) -> DataFrame:
    """(name, outcome, commit_id) of ``requests(name, expected, tip, force)``: refs that other workspaces may have moved meanwhile.

    A request is stale if the ref is no longer at ``expected``, and rejected if
    the ref's commit is not in the tip's history; force overrides the second.
    """
    now = materialize(requests.join(refs.withColumnRenamed("commit_id", "old"), "name", "left"), "publish")
    pairs = now.filter("old is not null").select(F.col("old").alias("left"), F.col("tip").alias("right"))
    inside = graph.is_ancestor(edges, pairs).select(F.col("left").alias("old"), F.col("right").alias("tip"), "is_ancestor")
    joined = now.join(inside, ["old", "tip"], "left")
    outcome = (
        F.when(~F.col("old").eqNullSafe(F.col("expected")), "stale").when(F.col("old").isNull(), "created").when(F.col("old") == F.col("tip"), "up-to-date")
        .when(F.col("is_ancestor"), "fast-forward").when(F.col("force"), "forced").otherwise("rejected")
    )
    kept = F.when(F.col("outcome").isin("stale", "rejected"), F.col("old")).otherwise(F.col("tip"))
    return joined.withColumn("outcome", outcome).select("name", "outcome", kept.alias("commit_id"))
