"""Changes of repository state as functions from relations to relations.

Trees are immutable, so every operation returns the new relation; the caller
writes it as the next version.  A path set is a Column over ``path``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.pathspec import glob_regex
from .trees import FIELDS, commit_changes, side, status_kinds


def index_of(before: DataFrame, after: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys.., fields.., state): ``after``, and the paths only ``before`` has as staged deletions without attributes."""
    return stage(before, after, F.lit(True), keys)


def stage(index: DataFrame, work: DataFrame, paths: Column, keys: list[str] | None = None) -> DataFrame:
    """The index with the chosen paths taken from the work tree; a path that only the index has becomes deleted."""
    keys = keys or ["path"]
    joined = side(index, keys, "i").join(side(work, keys, "w"), keys, "full_outer").withColumn("chosen", paths).filter("chosen or i is not null")
    now = F.when(F.col("chosen"), F.col("w")).otherwise(F.col("i"))
    fields = [now[f].alias(f) for f in FIELDS]
    return joined.select(*keys, *fields, F.when(now.isNull(), "deleted").otherwise("present").alias("state"))


def index_tree(stage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return stage.filter("state = 'present'").select(*(keys or ["path"]), *FIELDS)


def restore(target: DataFrame, source: DataFrame, paths: Column, keys: list[str] | None = None) -> DataFrame:
    """``target`` with the chosen paths as in ``source``; one that the source lacks is deleted."""
    fields = [*(keys or ["path"]), *FIELDS]
    return target.filter(~paths).select(*fields).unionByName(source.filter(paths).select(*fields))


def reset_hard(index: DataFrame, work: DataFrame, target: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The target tree, with the untracked files of the work tree whose paths it does not have."""
    keys = keys or ["path"]
    spared = work.join(index.select(*keys), keys, "left_anti").join(target.select(*keys), keys, "left_anti")
    return target.select(*keys, *FIELDS).unionByName(spared.select(*keys, *FIELDS))


def checkout_blocked(status: DataFrame, target: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys.., reason) of what keeps a checkout without force from running: staged, unstaged, or untracked in the way."""
    keys = keys or ["path"]
    there = target.select(*keys, F.lit(True).alias("there"))
    reason = (
        F.when(F.col("index_kind").isNotNull(), "staged").when(F.col("work_kind") != "untracked", "unstaged").when(F.col("there"), "untracked")
    )
    return status.join(there, keys, "left").select(*keys, reason.alias("reason")).filter("reason is not null")


def blocking(sides: DataFrame, keys: list[str]) -> DataFrame:
    """``checkout_blocked`` of the ``trees.met`` head, index, work and target."""
    return sides.select(*keys, _reason().alias("reason")).filter("reason is not null")


def _reason() -> Column:
    index_kind, work_kind = status_kinds()
    untracked = work_kind == "untracked"
    return F.when(index_kind.isNotNull(), "staged").when(~untracked, "unstaged").when(untracked & F.col("target").isNotNull(), "untracked")


def checkout(sides: DataFrame, keys: list[str] | None = None, group: list[str] | None = None, force: bool = False) -> DataFrame:
    """The work trees after switching to the target: of the groups (``keys`` without the path) that nothing blocks, or of all by force.

    ``sides`` are the ``trees.met`` head, index, work and target.
    """
    keys, group = keys or ["path"], group or []
    after = F.coalesce("target", F.when(F.col("index").isNull(), F.col("work")))
    switched = sides.select(*keys, after.alias("after"), _reason().isNotNull().alias("blocked"))
    if not force and group:
        switched = switched.withColumn("blocked", F.max("blocked").over(Window.partitionBy(*group))).filter("not blocked")
    elif not force:
        switched = switched.join(switched.agg(F.count_if("blocked").alias("n")).filter("n = 0"), F.lit(True), "left_semi")
    return switched.filter("after is not null").select(*keys, "after.*")


def rename(tree: DataFrame, old: str, new: str) -> DataFrame:
    """``tree`` with a file or directory moved; contents keep their ids."""
    if f"{new}/".startswith(f"{old}/"):
        raise ValueError("a directory cannot move into itself")
    path = F.col("path")
    moved = (path == old) | path.startswith(f"{old}/")
    return tree.withColumn("path", F.when(moved, F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path))


def set_ref(refs: DataFrame, name: str, commit_id: object) -> DataFrame:
    """``refs`` with one name set (or, for None, deleted)."""
    rest = refs.filter(F.col("name") != name)
    if commit_id is None:
        return rest
    return rest.unionByName(refs.sparkSession.createDataFrame([(name, commit_id)], refs.select("name", "commit_id").schema))


def set_config(config: DataFrame, updates: DataFrame) -> DataFrame:
    """(key, value): ``config`` with the keys of ``updates`` set, or, where the value is null, unset."""
    kept = config.join(updates.select("key"), "key", "left_anti").select("key", "value")
    return kept.unionByName(updates.filter("value is not null").select("key", "value"))


def effective_config(local: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, value, origin): the local value of a key, else the global one."""
    one = lambda t, name: t.select("key", F.struct("value").alias(name))
    joined = one(local, "l").join(one(shared, "g"), "key", "full_outer")
    here = F.col("l").isNotNull()
    return joined.select("key", F.when(here, F.col("l.value")).otherwise(F.col("g.value")).alias("value"), F.when(here, "local").otherwise("global").alias("origin"))


def cherry_pick(tree: DataFrame, commits: DataFrame, edges: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``picks(commit_id, onto)``: verdicts (commit_id, onto, changes, applicable), and the trees (commit_id, onto, path, fields..) of the applicable.

    A commit's changes against its first parent apply if each changed path is
    in the tree of ``onto`` as it was in the parent's.
    """
    picks = picks.select("commit_id", "onto").distinct()
    changed = commit_changes(tree, commits, edges).join(picks, "commit_id")
    now = side(tree.withColumnRenamed("commit_id", "onto"), ["onto", "path"], "now")
    tested = changed.join(now, ["onto", "path"], "left").withColumn("fits", F.col("before").eqNullSafe(F.col("now")))
    counts = tested.groupBy("commit_id", "onto").agg(F.count("*").alias("changes"), F.bool_and("fits").alias("applicable"))
    verdicts = picks.join(counts, ["commit_id", "onto"], "left").select(
        "commit_id", "onto", F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("applicable", F.lit(True)).alias("applicable")
    )
    taken = verdicts.filter("applicable").select("commit_id", "onto")
    keys = ["commit_id", "onto", "path"]
    old = side(tree.withColumnRenamed("commit_id", "onto").join(taken, "onto"), keys, "now")
    both = old.join(changed.join(taken, ["commit_id", "onto"], "left_semi").select(*keys, "kind", "after"), keys, "full_outer")
    final = F.when(F.col("kind").isNotNull(), F.col("after")).otherwise(F.col("now"))
    return verdicts, both.withColumn("final", final).filter("final is not null").select(*keys, "final.*")


def resolve(names: list[str], refs: DataFrame, commits: DataFrame) -> DataFrame:
    """(asked, commit_id, status) of revision names: full ref, branch, tag, then a prefix of one id only.

    ``status`` is found, ambiguous or unknown.  The names are the caller's
    arguments; refs and commits are scanned once, whatever their number.
    """
    spark = refs.sparkSession
    asked = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "asked string")
    forms = [(n, f"{p}{n}", k) for n in dict.fromkeys(names) for k, p in enumerate(("", "refs/heads/", "refs/tags/"), 1)]
    named = refs.join(F.broadcast(spark.createDataFrame(forms, "asked string, name string, rank int")), "name").select("asked", "commit_id", "rank")
    prefixed = commits.join(F.broadcast(asked), F.col("commit_id").cast("string").startswith(F.col("asked"))).select("asked", "commit_id", F.lit(4).alias("rank"))
    best = named.unionByName(prefixed).groupBy("asked").agg(
        F.min_by("commit_id", F.struct("rank", "commit_id")).alias("commit_id"), F.min("rank").alias("rank"), F.count_if(F.col("rank") == 4).alias("n")
    )
    found = (F.col("rank") < 4) | (F.col("n") == 1)
    status = F.when(F.col("rank").isNull(), "unknown").when(found, "found").otherwise("ambiguous")
    return asked.join(best, "asked", "left").select("asked", F.when(found, F.col("commit_id")).alias("commit_id"), status.alias("status"))


def required(resolved: DataFrame) -> DataFrame:
    """(asked, commit_id, error) of ``resolve``'s rows."""
    error = F.when(F.col("status") == "unknown", F.concat(F.lit("unknown revision: "), "asked")).when(F.col("status") == "ambiguous", F.concat(F.lit("ambiguous revision: "), "asked"))
    return resolved.select("asked", "commit_id", error.alias("error"))


def ref_list(refs: DataFrame, prefix: str, pattern: str = "*", points_at: object = None) -> DataFrame:
    """Refs under ``prefix`` whose short name fits a glob and that are at a commit, if one is given, by name."""
    found = refs.filter(F.col("name").startswith(prefix) & F.substring("name", len(prefix) + 1, 1000).rlike(f"\\A{glob_regex(pattern, False)}\\z"))
    return (found if points_at is None else found.filter(F.col("commit_id") == points_at)).orderBy("name")


def remotes(config: DataFrame) -> DataFrame:
    """(remote, url) of the keys ``remote.<name>.url``."""
    named = F.regexp_extract("key", "\\Aremote[.](.+)[.]url\\z", 1)
    return config.select(named.alias("remote"), F.col("value").alias("url")).filter("remote <> ''")
