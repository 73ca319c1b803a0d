"""Queries of commits, refs, merges, rebases and stashes, and of status and staging over all commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import state, trees, workflow
from .catalog import CHANGES, KIND, LINEAGE, PAIRS, lineage_sides, lineage_trees, pairs, query
from .porcelain import PATHS

KEYS = ["commit_id", "path"]
#: Grandparent, parent and commit as HEAD, index and work tree of every commit that has both ancestors.
THREE = LINEAGE + """, head AS (SELECT l.commit_id, path, content_id, size, mode FROM tree t JOIN lineage l ON t.commit_id = grandparent_id), idx AS (SELECT l.commit_id, path, content_id, size, mode FROM tree t JOIN lineage l ON t.commit_id = parent_id),
work AS (SELECT l.commit_id, path, content_id, size, mode FROM tree t JOIN lineage l ON t.commit_id = l.commit_id)"""
STATUS = THREE + f", s AS (SELECT commit_id, path, {KIND.format('head', 'idx')} AS index_kind, CASE WHEN idx.content_id IS NULL AND work.content_id IS NOT NULL THEN 'untracked' ELSE {KIND.format('idx', 'work')} END AS work_kind FROM head FULL JOIN idx USING (commit_id, path) FULL JOIN work USING (commit_id, path))"


def status_of_all(r) -> DataFrame:
    return trees.status_of(lineage_sides(r, "head", "index", "work"), KEYS)


def checkouts(r) -> DataFrame:
    """Of every commit's step back to its grandparent, which is HEAD as well."""
    return lineage_sides(r, "head", "index", "work").withColumn("target", F.col("head"))


@query(STATUS + " SELECT * FROM s WHERE index_kind IS NOT NULL OR work_kind IS NOT NULL")
def t03_status_of_all(r):
    return status_of_all(r)


@query(STATUS + """ SELECT commit_id, count(index_kind) AS staged, count(*) FILTER (work_kind <> 'untracked') AS unstaged, count(*) FILTER (work_kind = 'untracked') AS untracked, false AS clean
FROM s WHERE index_kind IS NOT NULL OR work_kind IS NOT NULL GROUP BY commit_id""")
def t04_summary_of_all(r):
    return trees.summary(status_of_all(r), ["commit_id"])


@query(STATUS + " SELECT commit_id, path, work_kind FROM s WHERE work_kind <> 'untracked'")
def t08_tracked_of_all(r):
    return status_of_all(r).filter("work_kind <> 'untracked'").select(*KEYS, "work_kind")


@query(THREE + """ SELECT commit_id, bool_and(h.content_id IS NOT DISTINCT FROM w.content_id AND h.size IS NOT DISTINCT FROM w.size) AS applicable
FROM (SELECT commit_id, path FROM head FULL JOIN idx USING (commit_id, path) WHERE (head.content_id, head.size) IS DISTINCT FROM (idx.content_id, idx.size)) c
LEFT JOIN head h USING (commit_id, path) LEFT JOIN work w USING (commit_id, path) GROUP BY commit_id""")
def t17_applicable_to_all(r):
    """Whether the step from grandparent to parent would apply to the commit's own tree."""
    head, index, work = lineage_trees(r)
    return trees.applicable(trees.changes(head, index, KEYS), work, ["commit_id"])


@query(THREE + """ SELECT commit_id, path, CASE WHEN c.path IS NULL THEN w.content_id ELSE c.new_content END AS content_id
FROM (SELECT commit_id, path, idx.content_id AS new_content FROM head FULL JOIN idx USING (commit_id, path) WHERE (head.content_id, head.size) IS DISTINCT FROM (idx.content_id, idx.size)) c
FULL JOIN work w USING (commit_id, path) WHERE c.path IS NULL OR c.new_content IS NOT NULL""")
def t18_applied_to_all(r):
    """Every commit's tree with the changes from its grandparent to its parent."""
    head, index, work = lineage_trees(r)
    return trees.apply_changes(work, trees.changes(head, index, KEYS), KEYS).select(*KEYS, "content_id")


@query(THREE + " SELECT commit_id, path, w.content_id, CASE WHEN w.path IS NULL THEN 'deleted' ELSE 'present' END AS state FROM idx i FULL JOIN work w USING (commit_id, path)")
def v08_stage_of_all(r):
    _, index, work = lineage_trees(r)
    return state.index_of(index, work, KEYS).select(*KEYS, "content_id", "state")


@query(THREE + f" SELECT commit_id, path, w.content_id, CASE WHEN w.path IS NULL THEN 'deleted' ELSE 'present' END AS state FROM idx i FULL JOIN work w USING (commit_id, path) WHERE {PATHS} UNION ALL SELECT commit_id, path, content_id, 'present' FROM idx WHERE NOT {PATHS}")
def k06_stage_of_all(r):
    _, index, work = lineage_trees(r)
    return state.stage(index, work, F.expr(PATHS), KEYS).select(*KEYS, "content_id", "state")


@query(THREE + f" SELECT commit_id, path, content_id FROM work WHERE {PATHS} UNION ALL SELECT commit_id, path, content_id FROM idx WHERE NOT {PATHS}")
def k11_restore_of_all(r):
    _, target, source = lineage_trees(r)
    return state.restore(target, source, F.expr(PATHS), KEYS).select(*KEYS, "content_id")


@query(THREE + " SELECT commit_id, path, content_id FROM head UNION ALL SELECT commit_id, path, content_id FROM work ANTI JOIN idx USING (commit_id, path) ANTI JOIN head USING (commit_id, path)")
def k12_reset_of_all(r):
    """Grandparents' trees with the files of the commits that neither they nor the parents have."""
    target, index, work = lineage_trees(r)
    return state.reset_hard(index, work, target, KEYS).select(*KEYS, "content_id")


BLOCKED = STATUS + """, b AS (SELECT commit_id, path, CASE WHEN index_kind IS NOT NULL THEN 'staged' WHEN work_kind <> 'untracked' THEN 'unstaged' WHEN t.path IS NOT NULL THEN 'untracked' END AS reason
FROM s LEFT JOIN (SELECT commit_id, path FROM head) t USING (commit_id, path) WHERE index_kind IS NOT NULL OR work_kind IS NOT NULL)"""


@query(BLOCKED + " SELECT * FROM b WHERE reason IS NOT NULL")
def k13_checkout_blocked(r):
    return state.blocking(checkouts(r), KEYS)


@query(BLOCKED + """ SELECT commit_id, path, content_id FROM (SELECT commit_id, path, content_id FROM head UNION ALL SELECT commit_id, path, content_id FROM work ANTI JOIN idx USING (commit_id, path) ANTI JOIN head USING (commit_id, path))
WHERE commit_id NOT IN (SELECT commit_id FROM b WHERE reason IS NOT NULL)""")
def k13_checkout(r):
    return state.checkout(checkouts(r), KEYS, ["commit_id"]).select(*KEYS, "content_id")


REQUESTS = """, req AS (SELECT f.commit_id + 10000000 AS commit_id, CASE WHEN f.commit_id % 5 = 0 THEN 'refs/heads/new' || f.commit_id ELSE r.name END AS name, f.commit_id AS src, CASE WHEN f.commit_id % 7 = 0 THEN ' ' ELSE 'work' END AS message, f.commit_id % 11 = 0 AS amend
  FROM commits f JOIN refs r ON r.commit_id = f.commit_id WHERE f.commit_id % 3 <> 1),
staged AS (SELECT q.commit_id, path, content_id, size FROM req q JOIN tree t ON t.commit_id = q.src WHERE q.src % 2 = 0 OR path NOT LIKE '%1.clj'),
heads AS (SELECT q.*, r.commit_id AS head FROM req q LEFT JOIN refs r USING (name)),
before2 AS (SELECT h.commit_id, path, content_id, size FROM heads h JOIN tree t ON t.commit_id = h.head),
moved AS (SELECT commit_id, count(*) AS n FROM staged s FULL JOIN before2 b USING (commit_id, path) WHERE (s.content_id, s.size) IS DISTINCT FROM (b.content_id, b.size) GROUP BY 1),
outcomes AS (SELECT commit_id, name, head, amend, CASE WHEN trim(message) = '' THEN 'blank message' WHEN coalesce(n, 0) = 0 AND NOT amend THEN 'nothing staged' ELSE 'committed' END AS outcome FROM heads LEFT JOIN moved USING (commit_id))"""


def committed(r) -> dict[str, DataFrame]:
    """A commit on every branch's tip, or on a new branch, with or without files left out."""
    tips = r.commits.join(r.refs, "commit_id").filter("commit_id % 3 <> 1")
    name = F.when(F.col("commit_id") % 5 == 0, F.concat(F.lit("refs/heads/new"), "commit_id")).otherwise(F.col("name"))
    requests = tips.select(
        (F.col("commit_id") + 10_000_000).alias("commit_id"), name.alias("name"), "author", "time", F.when(F.col("commit_id") % 7 == 0, " ").otherwise("work").alias("message"), (F.col("commit_id") % 11 == 0).alias("amend")
    )
    files = r.tree.join(tips.select("commit_id"), "commit_id").filter("commit_id % 2 = 0 or path not like '%1.clj'")
    index = files.withColumn("commit_id", F.col("commit_id") + 10_000_000).withColumn("state", F.lit("present"))
    return workflow.commit(requests, index, r.refs, r.tree)


@query(REQUESTS + " SELECT commit_id, outcome FROM outcomes")
def k08_commit_outcomes(r):
    return committed(r)["outcomes"]


@query(REQUESTS + " SELECT commit_id, head AS parent_id, 0 AS ord FROM outcomes WHERE outcome = 'committed' AND head IS NOT NULL AND NOT amend UNION ALL SELECT o.commit_id, parent_id, ord FROM outcomes o JOIN edges e ON e.commit_id = o.head WHERE outcome = 'committed' AND amend")
def k08_commit_edges(r):
    made = committed(r)
    return made["edges"].unionByName(workflow.amended_edges(made["replaced"], r.edges))


@query(REQUESTS + " SELECT commit_id, path, content_id FROM staged JOIN outcomes USING (commit_id) WHERE outcome = 'committed'")
def k08_commit_trees(r):
    return committed(r)["tree"].select(*KEYS, "content_id")


@query(REQUESTS + " SELECT name, commit_id FROM refs WHERE name NOT IN (SELECT name FROM outcomes WHERE outcome = 'committed') UNION ALL SELECT name, max(commit_id) FROM outcomes WHERE outcome = 'committed' GROUP BY name")
def k08_commit_refs(r):
    return committed(r)["refs"]


@query(""", tip AS (SELECT max(commit_id) AS tip FROM refs WHERE name = 'refs/heads/c1'),
q AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' ELSE 'set' END AS action, 'refs/heads/c' || (o_custkey + o_orderkey % 4 * 1000000 * (o_orderkey % 2)) AS name, o_orderkey AS target, o_orderkey % 5 = 0 AS force FROM orders),
j AS (SELECT q.*, commit_id AS old, tip FROM q LEFT JOIN refs USING (name), tip),
o AS (SELECT *, CASE WHEN action = 'create' AND old IS NOT NULL AND NOT force THEN 'exists' WHEN action = 'delete' AND old IS NULL THEN 'unknown' WHEN action = 'delete' AND name = 'refs/heads/c1' THEN 'current branch'
  WHEN action = 'delete' AND NOT force AND old IS DISTINCT FROM tip THEN 'not merged' WHEN action = 'set' AND old IS NULL THEN 'unknown' ELSE 'done' END AS outcome FROM j)
SELECT action, name, outcome, CASE WHEN outcome <> 'done' THEN old WHEN action <> 'delete' THEN target END AS commit_id FROM o""")
def k09_ref_requests(r):
    key, orders = F.col("o_orderkey"), r.table("orders")
    name = F.concat(F.lit("refs/heads/c"), F.col("o_custkey") + key % 4 * 1_000_000 * (key % 2))
    action = F.when(key % 3 == 0, "create").when(key % 3 == 1, "delete").otherwise("set")
    return workflow.ref_requests(r.refs, orders.select(action.alias("action"), name.alias("name"), key.alias("target"), (key % 5 == 0).alias("force")), "refs/heads/c1")


COMMON = """, common AS (SELECT "left", "right", a.commit_id, a.distance + b.distance AS cost FROM pairs JOIN far a ON a.root = "left" JOIN far b ON b.root = "right" AND a.commit_id = b.commit_id),
bases AS (SELECT "left", "right", base FROM pairs LEFT JOIN (SELECT "left", "right", arg_min(commit_id, (cost, commit_id::VARCHAR)) AS base FROM common GROUP BY ALL) USING ("left", "right")),
tb AS (SELECT "left", "right", path, (content_id, size) AS s FROM bases JOIN tree ON commit_id = base), tl AS (SELECT "left", "right", path, (content_id, size) AS s FROM bases JOIN tree ON commit_id = "left"),
tr AS (SELECT "left", "right", path, (content_id, size) AS s FROM bases JOIN tree ON commit_id = "right"),
m AS (SELECT "left", "right", path, b.s AS bs, o.s AS os, t.s AS ts FROM tb b FULL JOIN tl o USING ("left", "right", path) FULL JOIN tr t USING ("left", "right", path)),
counted AS (SELECT "left", "right", count(*) AS paths, count(*) FILTER (NOT (os IS NOT DISTINCT FROM ts OR ts IS NOT DISTINCT FROM bs OR os IS NOT DISTINCT FROM bs)) AS conflicts FROM m GROUP BY ALL)"""


@query(PAIRS + COMMON + """ SELECT "left", "right", base, CASE WHEN base IS NULL THEN 'unrelated' WHEN base = "right" THEN 'up-to-date' WHEN base = "left" THEN 'fast-forward' WHEN conflicts > 0 THEN 'conflict' ELSE 'merge' END AS kind,
coalesce(paths, 0) AS paths, coalesce(conflicts, 0) AS conflicts FROM bases LEFT JOIN counted USING ("left", "right")""", recursive=True)
def m03_merge_plans(r):
    return workflow.merge_plans(r.edges, pairs(r), r.trees_of)[0]



@query(PAIRS + CHANGES.replace("before AS", "before1 AS").replace("FROM before b", "FROM before1 b") + """, inside AS (SELECT "left", "right", commit_id, distance FROM pairs JOIN far ON root = "right" WHERE NOT EXISTS (SELECT 1 FROM far f WHERE f.root = "left" AND f.commit_id = far.commit_id)),
replay AS (SELECT *, row_number() OVER (PARTITION BY "left", "right" ORDER BY distance DESC, commit_id) AS n FROM inside),
steps AS (SELECT r."left", r."right", n, c.path, (old_content, old_size) AS b, (new_content, new_size) AS a FROM replay r JOIN changes c USING (commit_id)),
tested AS (SELECT s.*, row_number() OVER w AS k, lag(a) OVER w AS last, (t.content_id, t.size) AS now FROM steps s LEFT JOIN tree t ON t.commit_id = s."left" AND t.path = s.path WINDOW w AS (PARTITION BY s."left", s."right", s.path ORDER BY n)),
stops AS (SELECT "left", "right", min(n) AS stopped_at FROM tested WHERE b IS DISTINCT FROM CASE WHEN k = 1 THEN now ELSE last END GROUP BY ALL)
SELECT "left", "right", coalesce(commits, 0) AS commits, stopped_at FROM pairs LEFT JOIN (SELECT "left", "right", count(*) AS commits FROM replay GROUP BY ALL) USING ("left", "right") LEFT JOIN stops USING ("left", "right")""", recursive=True)
def m07_rebase_plans(r):
    return workflow.rebase_plans(r.edges, pairs(r), r.commits, r.trees_of)


STASHES = """, stashed AS (SELECT 'refs/stash/' || commit_id || '/' || part AS name, commit_id + k AS commit_id FROM commits, (VALUES ('base', 0), ('index', 1), ('work', 2)) p(part, k) WHERE commit_id % 10 = 0 AND NOT (commit_id % 30 = 0 AND part = 'work'))"""


def with_stashes(r) -> DataFrame:
    parts = F.posexplode(F.array(*map(F.lit, ("base", "index", "work")))).alias("k", "part")
    rows = r.commits.filter("commit_id % 10 = 0").select("commit_id", parts).filter("not (commit_id % 30 = 0 and part = 'work')")
    return r.refs.unionByName(rows.select(F.concat(F.lit("refs/stash/"), "commit_id", F.lit("/"), "part").alias("name"), (F.col("commit_id") + F.col("k")).alias("commit_id")))


@query(STASHES + """ SELECT *, row_number() OVER (ORDER BY key DESC) - 1 AS place FROM (SELECT split_part(name, '/', 3)::BIGINT AS key, max(commit_id) FILTER (suffix(name, 'base')) AS base, max(commit_id) FILTER (suffix(name, 'index')) AS index,
max(commit_id) FILTER (suffix(name, 'work')) AS work FROM stashed GROUP BY 1) WHERE work IS NOT NULL""")
def m08_stash_records(r):
    return workflow.stash_records(with_stashes(r))


PUBLISH = PAIRS + """, req AS (SELECT r.name, CASE WHEN p."left" % 300 = 0 THEN -1 ELSE r.commit_id END AS expected, p."left" AS tip, p."left" % 200 = 0 AS force, r.commit_id AS old FROM pairs p JOIN refs r ON r.commit_id = p."right")"""


@query(PUBLISH + """, o AS (SELECT *, CASE WHEN expected <> old THEN 'stale' WHEN old = tip THEN 'up-to-date' WHEN EXISTS (SELECT 1 FROM far WHERE root = tip AND commit_id = old) THEN 'fast-forward' WHEN force THEN 'forced' ELSE 'rejected' END AS outcome FROM req)
SELECT name, outcome, CASE WHEN outcome IN ('stale', 'rejected') THEN old ELSE tip END AS commit_id FROM o""", recursive=True)
def m11_publish(r):
    asked = pairs(r).join(r.refs.withColumnRenamed("commit_id", "right"), "right")
    expected = F.when(F.col("left") % 300 == 0, F.lit(-1)).otherwise(F.col("right"))
    return workflow.publish(r.edges, r.refs, asked.select("name", expected.alias("expected"), F.col("left").alias("tip"), (F.col("left") % 200 == 0).alias("force")))
