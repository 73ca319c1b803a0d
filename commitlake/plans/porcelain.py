"""Queries behind repository commands: lookups, logs, revisions, merges, staging, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ignore, scalars as S
from ..functions.pathspec import matches
from ..operators import graph, state, textdiff, trees
from .catalog import CHANGES, LINES, PAIRS, REACH, ROOTS, SIDES, KIND, changed, pairs, query, roots

# -- attribute queries and views


@query("SELECT path, content_id FROM worktree WHERE path IN (SELECT path FROM worktree WHERE content_id % 10 = 0)")
def q11_dynamic_attribute(r):
    asked = r.worktree.filter("content_id % 10 = 0").select("path")
    return r.worktree.join(asked, "path", "left_semi").select("path", "content_id")


@query("SELECT path, format('{:06o}', mode) AS mode FROM tree WHERE commit_id = 100")
def q14_function_bind(r):
    return r.tree.filter("commit_id = 100").select("path", S.octal_mode(F.col("mode")).alias("mode"))


@query("SELECT commit_id, author, parent_id FROM commits LEFT JOIN (SELECT * FROM edges WHERE ord = 0) USING (commit_id)")
def q19_pull_flat(r):
    return r.commits.join(r.edges.filter("ord = 0"), "commit_id", "left").select("commit_id", "author", "parent_id")


@query("SELECT name, message FROM refs LEFT JOIN commits USING (commit_id)")
def q20_pull_nested_one(r):
    return r.refs.join(r.commits, "commit_id", "left").select("name", "message")


@query("SELECT * FROM refs")
def q22_pull_wildcard(r):
    return r.refs


@query("SELECT author, count(*) AS n FROM commits GROUP BY author ORDER BY n DESC, author LIMIT 10")
def q28_client_order(r):
    return r.commits.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(10)


@query("SELECT commit_id, author, message, coalesce(parents, '') AS parents FROM commits LEFT JOIN (SELECT commit_id, string_agg(parent_id, ' ' ORDER BY ord) AS parents FROM edges GROUP BY 1) USING (commit_id)")
def v06_commits(r):
    parents = r.edges.groupBy("commit_id").agg(F.array_sort(F.collect_list(F.struct("ord", "parent_id"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["parent_id"].cast("string")), " ")
    return r.commits.join(parents, "commit_id", "left").select("commit_id", "author", "message", F.coalesce(joined, F.lit("")).alias("parents"))


STAGE = """, stage AS (SELECT path, content_id, size, mode, 'present' AS state FROM tree WHERE commit_id = 200 UNION ALL
SELECT path, NULL, NULL, NULL, 'deleted' FROM tree WHERE commit_id = 100 AND path NOT IN (SELECT path FROM tree WHERE commit_id = 200))"""


def stage(r) -> DataFrame:
    """The index of a commit with the staged deletions against another."""
    after, before = (r.tree.filter(f"commit_id = {c}").drop("commit_id") for c in (200, 100))
    return state.index_of(before, after)


@query(STAGE + " SELECT path, content_id, state FROM stage")
def v08_stage(r):
    return stage(r).select("path", "content_id", "state")


@query(STAGE + " SELECT path, content_id, size, mode FROM stage WHERE state = 'present'")
def v12_index_tree(r):
    return state.index_tree(stage(r))


@query("SELECT path, content_id FROM refs JOIN tree USING (commit_id) WHERE name = 'refs/heads/c1'")
def v16_head_tree(r):
    head = r.refs.filter("name = 'refs/heads/c1'")
    return r.tree.join(head, "commit_id", "left_semi").select("path", "content_id")


@query("SELECT path FROM worktree ORDER BY path")
def v17_files(r):
    return r.worktree.select("path").orderBy("path")


ASKED = ["src1/en", "src1", "none", "src1/en/none.txt"]


@query(f""", asked AS (SELECT unnest({ASKED}) AS path UNION SELECT min(path) FROM worktree)
SELECT path, CASE WHEN path IN (SELECT path FROM worktree) THEN 'file' WHEN EXISTS (SELECT 1 FROM worktree w WHERE starts_with(w.path, asked.path || '/')) THEN 'dir' END AS type FROM asked""")
def v20_stat(r):
    asked = r.spark.createDataFrame([(p,) for p in ASKED], "path string").union(r.worktree.agg(F.min("path").alias("path")))
    return trees.stat(r.worktree, asked)


# -- trees

STATUS = SIDES + f", s AS (SELECT path, {KIND.format('head', 'idx')} AS index_kind, CASE WHEN idx.content_id IS NULL AND work.content_id IS NOT NULL THEN 'untracked' ELSE {KIND.format('idx', 'work')} END AS work_kind FROM head FULL JOIN idx USING (path) FULL JOIN work USING (path))"


def status(r) -> DataFrame:
    return trees.status(*[r.tree.filter(f"commit_id = {c}") for c in (100, 200, 300)])


@query(STATUS + """ SELECT count(index_kind) AS staged, count(*) FILTER (work_kind <> 'untracked') AS unstaged, count(*) FILTER (work_kind = 'untracked') AS untracked,
count(index_kind) = 0 AND count(work_kind) = 0 AS clean FROM s""")
def t04_status_summary(r):
    return trees.summary(status(r))


@query(STATUS + " SELECT path, work_kind FROM s WHERE work_kind <> 'untracked'")
def t08_tracked_only(r):
    return status(r).filter("work_kind <> 'untracked'").select("path", "work_kind")


@query(r"""SELECT doc_id AS content_id, regexp_replace(text, '[ \t\r]+', '', 'g') = regexp_replace(b, '[ \t\r]+', '', 'g') AS "all",
regexp_replace(regexp_replace(text, '[ \t\r]+', ' ', 'g'), ' (\n|$)', '\1', 'g') = regexp_replace(regexp_replace(b, '[ \t\r]+', ' ', 'g'), ' (\n|$)', '\1', 'g') AS change,
regexp_replace(text, '[ \t\r]+(\n|$)', '\1', 'g') = regexp_replace(b, '[ \t\r]+(\n|$)', '\1', 'g') AS eol
FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN replace(text, ' ', '  ') WHEN 1 THEN replace(text, chr(10), ' ' || chr(10)) ELSE replace(text, 'a ', 'a') END AS b FROM documents)""")
def t09_whitespace(r):
    """Which whitespace rules make a text and a respaced revision of it equal."""
    kind, text = F.col("content_id") % 3, F.col("text")
    revised = F.when(kind == 0, F.replace(text, F.lit(" "), F.lit("  "))).when(kind == 1, F.replace(text, F.lit("\n"), F.lit(" \n"))).otherwise(F.replace(text, F.lit("a "), F.lit("a")))
    rows = r.blobs.withColumn("revised", revised)
    return rows.select("content_id", *[trees.same_but_space(text, F.col("revised"), rule).alias(rule) for rule in ("all", "change", "eol")])


@query("SELECT path FROM worktree WHERE path LIKE 'src1/%.txt' AND NOT starts_with(path, 'src1/de/') AND NOT path LIKE '%7.txt'")
def t13_pathspec(r):
    return r.worktree.filter(matches(F.col("path"), ["src1/*.txt", ":!src1/de", ":(exclude,icase)*7.TXT"])).select("path")


@query(CHANGES + " SELECT commit_id, CASE kind WHEN 'deleted' THEN 'delete' ELSE 'write' END AS action, count(*) AS n FROM changes GROUP BY ALL")
def t16_materialise_plan(r):
    action = F.when(F.col("kind") == "deleted", "delete").otherwise("write")
    return changed(r).groupBy("commit_id", action.alias("action")).agg(F.count("*").alias("n"))


# -- graph


@query(REACH.replace(f" WHERE {ROOTS}", "") + " SELECT root, commit_id FROM far", recursive=True)
def g02_transitive_closure(r):
    """Every commit with all that it reaches, itself included."""
    return graph.distances(r.edges, r.commits.select(F.col("commit_id").alias("root"))).select("root", "commit_id")


LOG = """, walk(root, commit_id, way) AS (SELECT commit_id, commit_id, '' FROM commits WHERE commit_id % 100 = 0
UNION SELECT root, parent_id, way || ord FROM walk JOIN edges USING (commit_id)),
firsts AS (SELECT root, commit_id, arg_min(way, (len(way), way)) AS way FROM walk GROUP BY ALL),
placed AS (SELECT root, commit_id, row_number() OVER (PARTITION BY root ORDER BY len(way), way) - 1 AS place FROM firsts)"""


@query(LOG + " SELECT root, commit_id, place FROM placed WHERE place < 100", recursive=True)
def g08_log(r):
    return graph.log(r.edges, roots(r), 100)


@query(LOG + " SELECT root, 'v' || arg_min(commit_id, (place, 'v' || commit_id)) AS tag, min(place) AS n FROM placed WHERE commit_id % 7 = 0 GROUP BY root", recursive=True)
def g12_describe(r):
    """The nearest tag of each root by its place in the log; every seventh commit is tagged."""
    tags = r.commits.filter("commit_id % 7 = 0").select("commit_id", F.concat(F.lit("v"), "commit_id").alias("tag"))
    return graph.describe(graph.log(r.edges, roots(r), None), tags)


@query(PAIRS + """ SELECT "left", "right", (SELECT count(*) FROM far WHERE root = "left" AND commit_id NOT IN (SELECT commit_id FROM far f WHERE f.root = "right")) AS ahead,
(SELECT count(*) FROM far WHERE root = "right" AND commit_id NOT IN (SELECT commit_id FROM far f WHERE f.root = "left")) AS behind FROM pairs""", recursive=True)
def g11_ahead_behind(r):
    return graph.ahead_behind(r.edges, pairs(r))


@query(PAIRS + """, common AS (SELECT "left", "right", a.commit_id, a.distance + b.distance AS cost FROM pairs JOIN far a ON a.root = "left" JOIN far b ON b.root = "right" AND a.commit_id = b.commit_id),
bases AS (SELECT "left", "right", arg_min(commit_id, (cost, commit_id::VARCHAR)) AS base FROM common GROUP BY ALL),
below(root, commit_id) AS (SELECT base, base FROM bases UNION SELECT root, parent_id FROM below JOIN edges USING (commit_id))
SELECT DISTINCT p."left", p."right", commit_id FROM pairs p JOIN far ON root IN (p."left", p."right") LEFT JOIN bases b ON b."left" = p."left" AND b."right" = p."right"
WHERE base IS NULL OR NOT EXISTS (SELECT 1 FROM below WHERE below.root = base AND below.commit_id = far.commit_id)""", recursive=True)
def g10_symmetric_range(r):
    return graph.symmetric_range(r.edges, pairs(r))


# -- revisions

NAMES = ["refs/heads/c1", "c2", "v700", "1499", "14", "none"]


@query(f""", asked AS (SELECT unnest({NAMES}) AS asked), tags AS (SELECT 'refs/tags/v' || commit_id AS name, commit_id FROM commits WHERE commit_id % 7 = 0),
named AS (SELECT asked, commit_id, 1 AS rank FROM asked JOIN refs ON name = asked UNION ALL SELECT asked, commit_id, 2 FROM asked JOIN refs ON name = 'refs/heads/' || asked
UNION ALL SELECT asked, commit_id, 3 FROM asked JOIN tags ON name = 'refs/tags/' || asked UNION ALL SELECT asked, commit_id, 4 FROM asked JOIN commits ON starts_with(commit_id::VARCHAR, asked)),
best AS (SELECT asked, arg_min(commit_id, (rank, commit_id)) AS commit_id, min(rank) AS rank, count(*) FILTER (rank = 4) AS n FROM named GROUP BY asked)
SELECT asked, CASE WHEN rank < 4 OR n = 1 THEN commit_id END AS commit_id, CASE WHEN rank IS NULL THEN 'unknown' WHEN rank < 4 OR n = 1 THEN 'found' ELSE 'ambiguous' END AS status FROM asked LEFT JOIN best USING (asked)""")
def e01_resolve(r):
    tags = r.commits.filter("commit_id % 7 = 0").select(F.concat(F.lit("refs/tags/v"), "commit_id").alias("name"), "commit_id")
    return state.resolve(NAMES, r.refs.unionByName(tags), r.commits)


@query("SELECT name, commit_id FROM refs WHERE suffix(name, '/c7') OR suffix(name, '/c70')")
def e06_show_ref(r):
    return r.refs.filter(F.col("name").endswith("/c7") | F.col("name").endswith("/c70")).select("name", "commit_id")


@query("SELECT name, 'refs/remotes/origin/' || name[12:] AS tracking, substr(sha1(commit_id::VARCHAR), 1, 8) AS short FROM refs")
def e08_tracking_name(r):
    return r.refs.select("name", S.tracking_name(F.col("name"), "origin").alias("tracking"), F.substring(F.sha1(F.col("commit_id").cast("string").cast("binary")), 1, 8).alias("short"))


# -- merge planning


@query(PAIRS + """ SELECT "left", "right", CASE WHEN "left" = "right" THEN 'up-to-date' WHEN EXISTS (SELECT 1 FROM far WHERE root = "right" AND commit_id = "left") THEN 'fast-forward'
WHEN EXISTS (SELECT 1 FROM far WHERE root = "left" AND commit_id = "right") THEN 'local-ahead' ELSE 'diverged' END AS policy FROM pairs""", recursive=True)
def m13_pull_policy(r):
    return graph.pull_policy(r.edges, pairs(r))


@query(PAIRS + """, sent AS (SELECT DISTINCT "left", "right", content_id FROM pairs JOIN far ON root = "right" JOIN tree t ON t.commit_id = far.commit_id
WHERE NOT EXISTS (SELECT 1 FROM far f WHERE f.root = "left" AND f.commit_id = far.commit_id)),
had AS (SELECT DISTINCT "left", content_id FROM pairs JOIN far ON root = "left" JOIN tree t ON t.commit_id = far.commit_id)
SELECT "left", "right", content_id FROM sent ANTI JOIN had USING ("left", content_id)""", recursive=True)
def m10_transfer_contents(r):
    """Contents of the commits a publication sends that its target has not."""
    return graph.transfer_contents(r.edges, pairs(r), r.tree)


# -- staging

PATHS = "path LIKE '%1.clj'"
TWO = ", a AS (SELECT * FROM tree WHERE commit_id = 100), b AS (SELECT * FROM tree WHERE commit_id = 200)"


def two(r) -> list[DataFrame]:
    return [r.tree.filter(f"commit_id = {c}").drop("commit_id") for c in (100, 200)]


@query(TWO + f" SELECT path, b.content_id, CASE WHEN b.path IS NULL THEN 'deleted' ELSE 'present' END AS state FROM a FULL JOIN b USING (path) WHERE {PATHS} UNION ALL SELECT path, content_id, 'present' FROM a WHERE NOT {PATHS}")
def k06_stage(r):
    index, work = two(r)
    return state.stage(index, work, F.expr(PATHS)).select("path", "content_id", "state")


@query(TWO + f" SELECT path, content_id FROM b WHERE {PATHS} UNION ALL SELECT path, content_id FROM a WHERE NOT {PATHS}")
def k11_restore(r):
    target, source = two(r)
    return state.restore(target, source, F.expr(PATHS)).select("path", "content_id")


@query(SIDES + " SELECT path, content_id FROM idx UNION ALL SELECT path, content_id FROM work WHERE path NOT IN (SELECT path FROM idx) AND path NOT IN (SELECT path FROM head)")
def k12_reset_hard(r):
    """Commit 200's tree, and the files of the work tree that are neither tracked nor in its way."""
    index, target, work = (r.tree.filter(f"commit_id = {c}").drop("commit_id") for c in (100, 200, 300))
    return state.reset_hard(index, work, target).select("path", "content_id")


@query("SELECT 'moved/' || path[6:] AS path, content_id FROM worktree WHERE starts_with(path, 'src1/') UNION ALL SELECT path, content_id FROM worktree WHERE NOT starts_with(path, 'src1/')")
def k16_rename(r):
    return state.rename(r.worktree, "src1", "moved").select("path", "content_id")


# -- listings


@query("SELECT count(*) || ' files changed, ' || sum(n)::BIGINT || ' insertions(+)' AS line FROM (SELECT CASE WHEN text = '' THEN 0 WHEN suffix(text, chr(10)) THEN len(string_split(text, chr(10))) - 1 ELSE len(string_split(text, chr(10))) END AS n FROM documents)")
def d10_shortstat(r):
    counted = r.blobs.select(F.size(textdiff.lines_of(F.col("text"))).cast("long").alias("n"))
    return counted.agg(F.concat(F.count("*"), F.lit(" files changed, "), F.sum("n"), F.lit(" insertions(+)")).alias("line"))


@query(CHANGES + " SELECT commit_id, upper(kind[1]) || chr(9) || path AS line FROM changes")
def d11_name_status(r):
    return changed(r).select("commit_id", F.concat(F.upper(F.substring("kind", 1, 1)), F.lit("\t"), "path").alias("line"))


@query(f"SELECT path, line FROM ({LINES}) WHERE regexp_matches(text, '[ \\t]+$')")
def d12_check(r):
    lines = r.worktree.join(r.blobs, "content_id").select("path", F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    return lines.filter(F.col("text").rlike("[ \\t]+\\z")).select("path", (F.col("at") + 1).cast("long").alias("line"))


@query("SELECT commit_id, commit_id || ' ' || author || ' ' || strftime(time, '%Y-%m-%d') || ' ' || message AS line FROM commits")
def h04_log_format(r):
    return r.commits.select("commit_id", F.concat_ws(" ", "commit_id", "author", F.date_format("time", "yyyy-MM-dd"), "message").alias("line"))


@query(CHANGES + " SELECT author, message, path, kind FROM commits JOIN changes USING (commit_id) WHERE commit_id = 100")
def h06_show(r):
    return r.commits.filter("commit_id = 100").join(changed(r), "commit_id").select("author", "message", "path", "kind")


IGNORE = {".gitignore": "# sources\n/src0/\n*7.txt\n!f17.txt\n", "src1/.gitignore": "de/**\n!de/*1.txt\n"}


@query(r"""SELECT path, CASE WHEN regexp_matches(path, '^src1/de/[^/]*1[.]txt$') THEN false WHEN starts_with(path, 'src1/de/') THEN true WHEN regexp_matches(path, '/f17[.]txt$') THEN false
ELSE suffix(path, '7.txt') OR starts_with(path, 'src0/') END AS ignored FROM worktree""")
def i04_ignored(r):
    return r.worktree.select("path", ignore.ignored(F.col("path"), ignore.rules(IGNORE)).alias("ignored"))
