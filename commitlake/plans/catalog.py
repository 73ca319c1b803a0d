"""The repository queries: attribute queries, views, trees, graph, merge, history, content, code.

Each is registered with the SQL that states its result over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import graph, textdiff, trees
from ..sources.views import SQL, Repository

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Roots of multi-source traversals, and the side revisions of tree queries.
ROOTS = "commit_id % 100 = 0"


def query(sql: str, recursive: bool = False) -> Callable:
    """Registers a query of a repository under its function's name; ``sql`` follows the relations' definitions."""

    def register(f: Callable[[Repository], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Repository(spark, sf_dir))
        more = sql.strip()
        ORACLES[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{SQL.strip()}" + (", " + more[1:] if more[0] == "," else " " + more)
        return f

    return register


def unchecked(f: Callable[[Repository], DataFrame]) -> Callable:
    """Registers a query that SQL cannot state; tests compare its operator with brute force."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Repository(spark, sf_dir))
    return f


CHANGES = """, firsts AS (SELECT commit_id, parent_id FROM edges WHERE ord = 0),
before AS (SELECT f.commit_id, path, content_id, size, mode FROM tree t JOIN firsts f ON t.commit_id = f.parent_id),
after AS (SELECT t.* FROM tree t JOIN commits USING (commit_id)),
changes AS (SELECT commit_id, path, CASE WHEN b.content_id IS NULL THEN 'added' WHEN a.content_id IS NULL THEN 'deleted' ELSE 'modified' END AS kind,
  b.content_id AS old_content, a.content_id AS new_content, b.size AS old_size, a.size AS new_size
  FROM before b FULL JOIN after a USING (commit_id, path) WHERE b.content_id IS DISTINCT FROM a.content_id OR b.size IS DISTINCT FROM a.size)"""

REACH = f""", reach(root, commit_id, distance) AS (SELECT commit_id, commit_id, 0::BIGINT FROM commits WHERE {ROOTS}
  UNION SELECT root, parent_id, distance + 1 FROM reach JOIN edges USING (commit_id)),
far AS (SELECT root, commit_id, min(distance) AS distance FROM reach GROUP BY ALL)"""

#: Pairs of a customer's commits: each root with that customer's latest commit.
PAIRS = f""", pairs AS (SELECT DISTINCT c.commit_id AS "left", r.commit_id AS "right" FROM (SELECT *, o_custkey FROM commits JOIN orders ON o_orderkey = commit_id WHERE {ROOTS}) c JOIN refs r ON r.name = 'refs/heads/c' || c.o_custkey),
ends AS (SELECT "left" AS root FROM pairs UNION SELECT "right" FROM pairs),
reach(root, commit_id, distance) AS (SELECT root, root, 0::BIGINT FROM ends UNION SELECT root, parent_id, distance + 1 FROM reach JOIN edges USING (commit_id)),
far AS (SELECT root, commit_id, min(distance) AS distance FROM reach GROUP BY ALL)"""


def roots(r: Repository) -> DataFrame:
    return r.commits.filter(ROOTS).select(F.col("commit_id").alias("root"))


def pairs(r: Repository) -> DataFrame:
    owners = r.table("orders").select(F.col("o_orderkey").alias("commit_id"), F.concat(F.lit("refs/heads/c"), "o_custkey").alias("name"))
    left = r.commits.filter(ROOTS).join(owners, "commit_id").select(F.col("commit_id").alias("left"), "name")
    return left.join(r.refs.withColumnRenamed("commit_id", "right"), "name").select("left", "right").distinct()


def changed(r: Repository) -> DataFrame:
    return trees.commit_changes(r.tree, r.commits, r.edges)


# -- flagship


@query(REACH + """ SELECT author, count(DISTINCT commit_id) AS merges FROM far JOIN commits USING (commit_id)
JOIN (SELECT commit_id FROM edges GROUP BY 1 HAVING count(DISTINCT parent_id) >= 2) USING (commit_id) GROUP BY author""", recursive=True)
def merge_authors(r: Repository) -> DataFrame:
    """Authors of merge commits in the roots' ancestry."""
    reached = graph.distances(r.edges, roots(r)).select("commit_id").distinct()
    found = reached.join(graph.merges(r.edges), "commit_id").join(r.commits, "commit_id")
    return found.groupBy("author").agg(F.count_distinct("commit_id").alias("merges"))


# -- attribute queries


@query("SELECT DISTINCT author, message FROM commits")
def q01_relation_find(r):
    return r.commits.select("author", "message").distinct()


@query("SELECT commit_id FROM refs WHERE name = 'refs/heads/c1'")
def q02_scalar_find(r):
    return r.refs.filter("name = 'refs/heads/c1'").select("commit_id").limit(1)


@query("SELECT DISTINCT parent_id FROM edges")
def q03_collection_find(r):
    return r.edges.select("parent_id").distinct()


@query("SELECT min(content_id) AS content_id, min(size) AS size FROM tree WHERE commit_id = (SELECT min(commit_id) FROM tree)")
def q04_tuple_find(r):
    first = r.tree.agg(F.min("commit_id").alias("commit_id"))
    return r.tree.join(first, "commit_id", "left_semi").agg(F.min("content_id").alias("content_id"), F.min("size").alias("size"))


@query("SELECT path, content_id FROM worktree")
def q05_attribute_scan(r):
    return r.worktree.select("path", "content_id")


@query("SELECT commit_id FROM commits WHERE message = '1-URGENT'")
def q06_constant_pattern(r):
    return r.commits.filter("message = '1-URGENT'").select("commit_id")


@query("SELECT t.commit_id, path, s_name FROM tree t JOIN supplier ON content_id = s_suppkey WHERE mode = 33188")
def q07_implicit_join(r):
    contents = r.table("supplier").select(F.col("s_suppkey").alias("content_id"), "s_name")
    return r.tree.filter("mode = 33188").join(contents, "content_id").select("commit_id", "path", "s_name")


@query("SELECT commit_id FROM commits JOIN (SELECT DISTINCT commit_id FROM edges) USING (commit_id)")
def q08_attribute_exists(r):
    return r.commits.join(r.edges, "commit_id", "left_semi").select("commit_id")


@query("SELECT commit_id, author, message FROM commits WHERE commit_id = 100")
def q09_scalar_parameter(r):
    return r.spark.sql("SELECT commit_id, author, message FROM {commits} WHERE commit_id = :id", args={"id": 100}, commits=r.commits)


@query("SELECT commit_id, author FROM commits WHERE commit_id IN (SELECT commit_id FROM refs)")
def q10_collection_parameter(r):
    return r.commits.join(r.refs, "commit_id", "left_semi").select("commit_id", "author")


@query("SELECT commit_id FROM commits WHERE commit_id NOT IN (SELECT commit_id FROM tree)")
def q12_negation(r):
    return r.commits.join(r.tree, "commit_id", "left_anti").select("commit_id")


@query("SELECT DISTINCT a.commit_id FROM edges a JOIN edges b ON a.commit_id = b.commit_id AND a.parent_id <> b.parent_id")
def q13_predicate(r):
    other = r.edges.select("commit_id", F.col("parent_id").alias("other"))
    return r.edges.join(other, "commit_id").filter("parent_id <> other").select("commit_id").distinct()


@query("SELECT author, count(DISTINCT commit_id) AS commits FROM commits GROUP BY author")
def q17_aggregate_find(r):
    return r.commits.groupBy("author").agg(F.count_distinct("commit_id").alias("commits"))


@query("SELECT count(DISTINCT content_id) AS contents FROM tree")
def q18_global_aggregate(r):
    return r.tree.agg(F.count_distinct("content_id").alias("contents"))


@query("SELECT commit_id, list_transform(list_sort(list({'o': ord, 'p': parent_id})), lambda x: x.p) AS parents FROM edges GROUP BY commit_id UNION ALL SELECT commit_id, [] FROM commits WHERE commit_id NOT IN (SELECT commit_id FROM edges)")
def q21_pull_nested_many(r):
    parents = r.edges.groupBy("commit_id").agg(F.array_sort(F.collect_list(F.struct("ord", "parent_id"))).alias("p"))
    empty = F.array().cast("array<bigint>")
    return r.commits.select("commit_id").join(parents, "commit_id", "left").select("commit_id", F.coalesce("p.parent_id", empty).alias("parents"))


@query("SELECT author FROM commits WHERE commit_id % 2 = 0 INTERSECT SELECT author FROM commits WHERE commit_id % 3 = 0")
def q23_two_sources(r):
    return r.commits.filter("commit_id % 2 = 0").select("author").intersect(r.commits.filter("commit_id % 3 = 0").select("author"))


@query("SELECT author, n_name, count(*) AS commits FROM commits JOIN customer ON c_name = author JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def q24_application_data(r):
    people = r.table("customer").select(F.col("c_name").alias("author"), F.col("c_nationkey").alias("n_nationkey"))
    return r.commits.join(people, "author").join(r.table("nation"), "n_nationkey").groupBy("author", "n_name").agg(F.count("*").alias("commits"))


@query("SELECT e, a, arg_max(v, (tx, event_id)) AS v FROM facts WHERE tx <= (SELECT median(tx) FROM facts) GROUP BY e, a".replace("(SELECT median(tx) FROM facts)", "TIMESTAMP '2024-06-01'"))
def q26_as_of(r):
    return r.facts.filter("tx <= timestamp'2024-06-01'").groupBy("e", "a").agg(F.max_by("v", F.struct("tx", "event_id")).alias("v"))


# -- views


@query("SELECT name, r.commit_id, author FROM refs r LEFT JOIN commits USING (commit_id)")
def v04_refs(r):
    return r.refs.join(r.commits, "commit_id", "left").select("name", "commit_id", "author")


@query("SELECT path, content_id, size, mode FROM tree WHERE commit_id = 100")
def v14_tree_at(r):
    return r.tree.filter("commit_id = 100").select("path", *trees.FIELDS)


@query("SELECT path, text FROM worktree JOIN documents ON doc_id = content_id WHERE path LIKE 'src1/en/%'")
def v15_read(r):
    return r.worktree.filter("path like 'src1/en/%'").join(r.blobs, "content_id").select("path", "text")


@query("SELECT DISTINCT array_to_string(p[1:i], '/') AS path FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(path, '/') AS p FROM worktree))")
def v19_directories(r):
    return trees.directories(r.worktree)


@query("SELECT split_part(path[6:], '/', 1) AS name, CASE WHEN max(len(string_split(path[6:], '/'))) > 1 THEN 'dir' ELSE 'file' END AS type, count(*) AS files FROM worktree WHERE path LIKE 'src1/%' GROUP BY 1")
def v21_list_dir(r):
    return trees.list_dir(r.worktree, "src1")


@query("SELECT commit_id, count(parent_id) AS parents, count(child) AS children FROM (SELECT commit_id, parent_id, NULL AS child FROM edges UNION ALL SELECT parent_id, NULL, commit_id FROM edges UNION ALL SELECT commit_id, NULL, NULL FROM commits) GROUP BY commit_id")
def v22_commit_graph(r):
    nothing = F.lit(0).cast("long")
    rows = (
        r.edges.select("commit_id", F.lit(1).cast("long").alias("p"), nothing.alias("c"))
        .unionByName(r.edges.select(F.col("parent_id").alias("commit_id"), nothing.alias("p"), F.lit(1).cast("long").alias("c")))
        .unionByName(r.commits.select("commit_id", nothing.alias("p"), nothing.alias("c")))
    )
    return rows.groupBy("commit_id").agg(F.sum("p").alias("parents"), F.sum("c").alias("children"))


# -- trees


@query(CHANGES + " SELECT * FROM changes")
def t05_commit_changes(r):
    return trees.flat(changed(r))


@query(CHANGES + " SELECT commit_id, kind, count(*) AS n FROM changes WHERE kind IN ('added', 'deleted') GROUP BY ALL")
def t06_diff_filter(r):
    return changed(r).filter(F.col("kind").isin("added", "deleted")).groupBy("commit_id", "kind").agg(F.count("*").alias("n"))


@query(CHANGES + " SELECT commit_id, path, CASE kind WHEN 'added' THEN 'deleted' WHEN 'deleted' THEN 'added' ELSE kind END AS kind, new_content AS old_content, old_content AS new_content, new_size AS old_size, old_size AS new_size FROM changes")
def t07_reverse(r):
    return trees.flat(trees.reverse(changed(r)))


SIDES = ", head AS (SELECT * FROM tree WHERE commit_id = 100), idx AS (SELECT * FROM tree WHERE commit_id = 200), work AS (SELECT * FROM tree WHERE commit_id = 300)"
KIND = "CASE WHEN {0}.content_id IS NULL AND {1}.content_id IS NOT NULL THEN 'added' WHEN {0}.content_id IS NOT NULL AND {1}.content_id IS NULL THEN 'deleted' WHEN ({0}.content_id, {0}.size) IS DISTINCT FROM ({1}.content_id, {1}.size) THEN 'modified' END"


@query(SIDES + f", s AS (SELECT path, {KIND.format('head', 'idx')} AS index_kind, CASE WHEN idx.content_id IS NULL AND work.content_id IS NOT NULL THEN 'untracked' ELSE {KIND.format('idx', 'work')} END AS work_kind FROM head FULL JOIN idx USING (path) FULL JOIN work USING (path)) SELECT * FROM s WHERE index_kind IS NOT NULL OR work_kind IS NOT NULL")
def t03_status(r):
    return trees.status(*[r.tree.filter(f"commit_id = {c}") for c in (100, 200, 300)])


@query(CHANGES + """, d AS (SELECT commit_id, old_content AS content_id, path AS old_path, row_number() OVER (PARTITION BY commit_id, old_content ORDER BY path) AS n FROM changes WHERE kind = 'deleted'),
a AS (SELECT commit_id, new_content AS content_id, path AS new_path, row_number() OVER (PARTITION BY commit_id, new_content ORDER BY path) AS n FROM changes WHERE kind = 'added')
SELECT commit_id, content_id, old_path, new_path FROM d JOIN a USING (commit_id, content_id, n)""")
def t10_exact_renames(r):
    return trees.exact_renames(changed(r), ["commit_id"])


@query(", a AS (SELECT * FROM tree WHERE commit_id = 100), b AS (SELECT * FROM tree WHERE commit_id = 200) SELECT path, content_id, size, mode FROM b")
def t18_apply_changes(r):
    a, b = (r.tree.filter(f"commit_id = {c}").drop("commit_id") for c in (100, 200))
    return trees.apply_changes(a, trees.changes(a, b))


@query(", a AS (SELECT * FROM tree WHERE commit_id = 100), b AS (SELECT * FROM tree WHERE commit_id = 200) SELECT count(*) = 0 AS applicable FROM (SELECT path, a.content_id x, b.content_id y, a.size p, b.size q FROM a FULL JOIN b USING (path)) WHERE x IS DISTINCT FROM y OR p IS DISTINCT FROM q")
def t17_applicable(r):
    a, b = (r.tree.filter(f"commit_id = {c}").drop("commit_id") for c in (100, 200))
    return trees.applicable(trees.changes(a, b), b)


# -- graph


@query(REACH + " SELECT * FROM far", recursive=True)
def g01_distances(r):
    return graph.distances(r.edges, roots(r))


@query(REACH + " SELECT root, max(distance) AS depth FROM far GROUP BY root", recursive=True)
def g03_depth(r):
    return graph.distances(r.edges, roots(r)).groupBy("root").agg(F.max("distance").alias("depth"))


@query(PAIRS + """, common AS (SELECT "left", "right", a.commit_id, a.distance + b.distance AS cost FROM pairs JOIN far a ON a.root = "left" JOIN far b ON b.root = "right" AND a.commit_id = b.commit_id)
SELECT "left", "right", base, cost FROM pairs LEFT JOIN (SELECT "left", "right", arg_min(commit_id, (cost, commit_id::VARCHAR)) AS base, min(cost) AS cost FROM common GROUP BY ALL) USING ("left", "right")""", recursive=True)
def g05_merge_base(r):
    return graph.merge_bases(r.edges, pairs(r))


@query(PAIRS + """ SELECT "left", "right", EXISTS (SELECT 1 FROM far WHERE root = "right" AND commit_id = "left") AS is_ancestor FROM pairs""", recursive=True)
def g06_is_ancestor(r):
    return graph.is_ancestor(r.edges, pairs(r))


@query(PAIRS + """ SELECT "left", "right", commit_id FROM pairs JOIN far ON root = "right" WHERE NOT EXISTS (SELECT 1 FROM far f WHERE f.root = "left" AND f.commit_id = far.commit_id)""", recursive=True)
def g09_range(r):
    return graph.reachable_not(r.edges, pairs(r))


@query(", down(root, commit_id) AS (SELECT commit_id, commit_id FROM commits WHERE commit_id % 500 = 0 UNION SELECT root, e.commit_id FROM down d JOIN edges e ON e.parent_id = d.commit_id) SELECT root, name FROM down JOIN refs USING (commit_id)", recursive=True)
def g13_contains(r):
    below = graph.distances(r.edges, r.commits.filter("commit_id % 500 = 0").select(F.col("commit_id").alias("root")), forward=False)
    return below.join(r.refs, "commit_id").select("root", "name")


@query(f", down(root, commit_id) AS (SELECT commit_id, commit_id FROM commits WHERE {ROOTS} UNION SELECT root, e.commit_id FROM down d JOIN edges e ON e.parent_id = d.commit_id) SELECT root, name FROM down JOIN refs USING (commit_id)", recursive=True)
def g13_contains_roots(r):
    return graph.distances(r.edges, roots(r), forward=False).join(r.refs, "commit_id").select("root", "name")


@query(PAIRS + """, common AS (SELECT "left", "right", a.commit_id FROM pairs JOIN far a ON a.root = "left" JOIN far b ON b.root = "right" AND a.commit_id = b.commit_id)
SELECT "left", "right", commit_id FROM common c WHERE NOT EXISTS (SELECT 1 FROM common o JOIN edges e ON e.commit_id = o.commit_id WHERE o."left" = c."left" AND o."right" = c."right" AND e.parent_id = c.commit_id)""", recursive=True)
def g14_lowest_common_ancestors(r):
    return graph.lowest_common_ancestors(r.edges, pairs(r))


@query("SELECT commit_id FROM commits WHERE commit_id NOT IN (SELECT commit_id FROM edges)")
def g15_roots(r):
    return graph.roots(r.commits, r.edges)


@query("SELECT commit_id, count(DISTINCT parent_id) AS parents FROM edges GROUP BY 1 HAVING count(DISTINCT parent_id) >= 2")
def g16_merges(r):
    return graph.merges(r.edges)


@query(", f AS (SELECT * FROM edges WHERE ord = 0) SELECT a.commit_id AS root, c.parent_id AS commit_id FROM f a JOIN f b ON b.commit_id = a.parent_id JOIN f c ON c.commit_id = b.parent_id")
def g20_nth_ancestor(r):
    return graph.nth_ancestor(r.edges, r.commits.select(F.col("commit_id").alias("root")), 3)


@query("SELECT name, commit_id FROM refs WHERE name LIKE 'refs/heads/c1%' ORDER BY name DESC LIMIT 20")
def e05_for_each_ref(r):
    return r.refs.filter(F.col("name").startswith("refs/heads/c1")).orderBy(F.desc("name")).limit(20)


# -- merge


MERGED = """, base AS (SELECT * FROM tree WHERE commit_id = 100), ours AS (SELECT * FROM tree WHERE commit_id = 200), theirs AS (SELECT * FROM tree WHERE commit_id = 300),
m AS (SELECT path, b.content_id AS bc, o.content_id AS oc, t.content_id AS tc, (b.content_id, b.size) AS bs, (o.content_id, o.size) AS os, (t.content_id, t.size) AS ts
FROM base b FULL JOIN ours o USING (path) FULL JOIN theirs t USING (path))"""


@query(MERGED + """ SELECT path, bc AS base, oc AS ours, tc AS theirs, CASE WHEN os IS NOT DISTINCT FROM ts OR ts IS NOT DISTINCT FROM bs THEN oc WHEN os IS NOT DISTINCT FROM bs THEN tc END AS resolved,
NOT (os IS NOT DISTINCT FROM ts OR ts IS NOT DISTINCT FROM bs OR os IS NOT DISTINCT FROM bs) AS conflict FROM m""")
def m02_plan_trees(r):
    merged = trees.merge_trees(*[r.tree.filter(f"commit_id = {c}") for c in (100, 200, 300)])
    return merged.select("path", *[F.col(f"{c}.content_id").alias(c) for c in ("base", "ours", "theirs", "resolved")], "conflict")


LINEAGE = ", firsts AS (SELECT commit_id, parent_id FROM edges WHERE ord = 0), lineage AS (SELECT a.commit_id, a.parent_id, b.parent_id AS grandparent_id FROM firsts a JOIN firsts b ON b.commit_id = a.parent_id)"


def lineage(r: Repository) -> DataFrame:
    firsts = r.edges.filter("ord = 0").select("commit_id", "parent_id")
    older = firsts.select(F.col("commit_id").alias("parent_id"), F.col("parent_id").alias("grandparent_id"))
    return firsts.join(older, "parent_id").select(F.col("commit_id").alias("of"), "parent_id", "grandparent_id")


def lineage_trees(r: Repository) -> list[DataFrame]:
    """The trees of grandparent, parent and commit, under the commit's id, for every commit that has both ancestors."""
    rows = lineage(r)
    return [
        r.tree.join(rows.select("of", F.col(c).alias("commit_id")), "commit_id").drop("commit_id").withColumnRenamed("of", "commit_id")
        for c in ("grandparent_id", "parent_id", "of")
    ]


def lineage_sides(r: Repository, *names: str) -> DataFrame:
    """``lineage_trees`` met by commit and path under three names; the tree is put together once."""
    places = F.posexplode(F.array("grandparent_id", "parent_id", "of")).alias("side", "commit_id")
    rows = r.tree.join(lineage(r).select("of", places), "commit_id").drop("commit_id").withColumnRenamed("of", "commit_id")
    return trees.met(rows, list(names), ["commit_id", "path"])


@query(LINEAGE + """, base AS (SELECT l.commit_id, path, content_id, size FROM tree t JOIN lineage l ON t.commit_id = grandparent_id), ours AS (SELECT l.commit_id, path, content_id, size FROM tree t JOIN lineage l ON t.commit_id = parent_id),
theirs AS (SELECT l.commit_id, path, content_id, size FROM tree t JOIN lineage l ON t.commit_id = l.commit_id),
m AS (SELECT commit_id, path, b.content_id AS bc, o.content_id AS oc, t.content_id AS tc, (b.content_id, b.size) AS bs, (o.content_id, o.size) AS os, (t.content_id, t.size) AS ts
FROM base b FULL JOIN ours o USING (commit_id, path) FULL JOIN theirs t USING (commit_id, path))
SELECT commit_id, path, bc AS base, oc AS ours, tc AS theirs, CASE WHEN os IS NOT DISTINCT FROM ts OR ts IS NOT DISTINCT FROM bs THEN oc WHEN os IS NOT DISTINCT FROM bs THEN tc END AS resolved,
NOT (os IS NOT DISTINCT FROM ts OR ts IS NOT DISTINCT FROM bs OR os IS NOT DISTINCT FROM bs) AS conflict FROM m""")
def m02_plan_all_trees(r):
    merged = trees.resolved(lineage_sides(r, "base", "ours", "theirs"))
    return merged.select("commit_id", "path", *[F.col(f"{c}.content_id").alias(c) for c in ("base", "ours", "theirs", "resolved")], "conflict")


# -- history


@query("SELECT author, count(*) AS commits FROM commits GROUP BY author")
def h08_authors(r):
    return r.commits.groupBy("author").agg(F.count("*").alias("commits"))


@query("SELECT nullif(lower(regexp_extract(path, '[.]([^./]+)$', 1)), '') AS extension, count(*) AS files FROM tree GROUP BY 1")
def h08_extensions(r):
    return r.tree.groupBy(S.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"))


@query("SELECT commit_id FROM commits WHERE regexp_matches(message, '^[12]-') AND regexp_matches(lower(message), 'high')")
def h01_log_grep(r):
    return r.commits.filter(F.col("message").rlike("^[12]-") & F.col("message").rlike("(?i)high")).select("commit_id")


@query(CHANGES + " SELECT DISTINCT commit_id FROM changes WHERE path = 'src/d1/m1.clj' ORDER BY commit_id LIMIT 50")
def h03_log_path(r):
    return changed(r).filter("path = 'src/d1/m1.clj'").select("commit_id").distinct().orderBy("commit_id").limit(50)


@query(", t AS (SELECT content_id, size FROM tree), c AS (SELECT doc_id, text FROM documents)" + CHANGES + """ SELECT DISTINCT commit_id FROM changes LEFT JOIN documents a ON a.doc_id = old_content LEFT JOIN documents b ON b.doc_id = new_content
WHERE len(regexp_extract_all(coalesce(a.text, ''), 'the')) <> len(regexp_extract_all(coalesce(b.text, ''), 'the'))""")
def h02_pickaxe(r):
    counted = r.blobs.select("content_id", F.regexp_count("text", F.lit("\\Qthe\\E")).cast("long").alias("n"))
    rows = trees.flat(changed(r)).select("commit_id", "old_content", "new_content")
    for name in ("old", "new"):
        # A file without this side meets no content; the second key deals such files over all tasks.
        spread = F.when(F.col(f"{name}_content").isNull(), F.col("commit_id")).otherwise(0)
        sides = counted.select(F.col("content_id").alias(f"{name}_content"), F.lit(0).cast("long").alias("spread"), F.col("n").alias(f"{name}_n"))
        rows = rows.withColumn("spread", spread.cast("long")).join(sides, [f"{name}_content", "spread"], "left").drop("spread")
    nothing = F.lit(0).cast("long")
    return rows.filter(F.coalesce("old_n", nothing) != F.coalesce("new_n", nothing)).select("commit_id").distinct()


LINES = "SELECT path, i AS line, l[i] AS text FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, string_split(text, chr(10)) AS l FROM worktree JOIN documents ON doc_id = content_id))"


@query(f"SELECT path, line, text FROM ({LINES}) WHERE regexp_matches(text, 'password')")
def h05_grep(r):
    lines = r.worktree.join(r.blobs, "content_id").select("path", F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    return lines.filter(F.col("text").rlike("password")).select("path", (F.col("at") + 1).cast("long").alias("line"), "text")


@query(f"SELECT path, count(*) AS n FROM ({LINES}) WHERE regexp_matches(lower(text), 'apache license') GROUP BY path")
def h05_grep_count(r):
    lines = r.worktree.join(r.blobs, "content_id").select("path", F.explode(F.split("text", "\n", -1)).alias("text"))
    return lines.filter(F.col("text").rlike("(?i)apache license")).groupBy("path").agg(F.count("*").alias("n"))


# -- objects and content


@query("SELECT doc_id AS content_id, sha1(('blob ' || strlen(text))::BLOB || '\\x00'::BLOB || encode(text)) AS oid FROM documents")
def o01_object_id(r):
    return r.blobs.select("content_id", S.object_id("blob", F.encode("text", "utf-8")).alias("oid"))


@query("SELECT sha256(encode(text)) AS id, count(*) AS n FROM documents GROUP BY 1")
def c01_content_id(r):
    return r.blobs.groupBy(S.content_id(F.encode("text", "utf-8")).alias("id")).agg(F.count("*").alias("n"))


@query("SELECT doc_id AS content_id, CASE WHEN strlen(text) >= 4096 THEN 'chunks' ELSE 'full' END AS kind FROM documents")
def c05_threshold(r):
    return r.blobs.select("content_id", F.when(F.octet_length("text") >= 4096, "chunks").otherwise("full").alias("kind"))


@query("SELECT DISTINCT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id % 2 = 0) INTERSECT SELECT unnest(string_split(text, chr(10))) FROM documents WHERE doc_id % 2 = 1")
def c08_reuse(r):
    even, odd = (r.blobs.filter(f"content_id % 2 = {k}").select(F.explode(F.split("text", "\n", -1)).alias("line")) for k in (0, 1))
    return even.intersect(odd)


@query("SELECT doc_id AS content_id, contains(text[1:8000], chr(0)) AS binary, true AS utf8 FROM documents")
def d14_binary(r):
    data = F.encode("text", "utf-8")
    return r.blobs.select("content_id", S.is_binary(data).alias("binary"), S.strict_utf8(data).alias("utf8"))


@query("SELECT doc_id AS content_id, (CASE WHEN text = '' THEN 0 WHEN suffix(text, chr(10)) THEN len(string_split(text, chr(10))) - 1 ELSE len(string_split(text, chr(10))) END)::BIGINT AS lines FROM documents")
def d01_lines(r):
    return r.blobs.select("content_id", F.size(textdiff.lines_of(F.col("text"))).cast("long").alias("lines"))


@query("SELECT doc_id AS content_id, (CASE WHEN text = '' THEN 0 WHEN suffix(text, chr(10)) THEN len(string_split(text, chr(10))) - 1 ELSE len(string_split(text, chr(10))) END)::BIGINT AS added, 0::BIGINT AS deleted FROM documents")
def d09_numstat_added(r):
    """Counts of the diff from the empty text."""
    edits = textdiff.diff_edits(F.lit(""), F.col("text"))
    return r.blobs.withColumn("e", edits).select("content_id", textdiff.added(F.col("e")).alias("added"), textdiff.deleted(F.col("e")).alias("deleted"))


# -- code objects


@query("SELECT sha1(text) AS hash, min(doc_id) AS first, count(*) AS occurrences FROM documents GROUP BY 1")
def f06_forms(r):
    return r.blobs.groupBy(F.sha1(F.encode("text", "utf-8")).alias("hash")).agg(F.min("content_id").alias("first"), F.count("*").alias("occurrences"))


@query("SELECT round(count(*)::DOUBLE / count(DISTINCT text), 6) AS factor FROM documents")
def f13_dedup_factor(r):
    return r.blobs.agg(F.round(F.count("*") / F.count_distinct("text"), 6).alias("factor"))


KNN = ", q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), near AS (SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], v), 6) AS distance, label FROM embeddings, q ORDER BY list_cosine_distance(embedding::DOUBLE[], v), vec_id LIMIT 10)"


def nearest(r: Repository, k: int = 10) -> DataFrame:
    vectors = r.table("embeddings")
    target = vectors.filter("vec_id = 0").select(F.col("embedding").alias("target")).limit(1)
    ranked = vectors.crossJoin(F.broadcast(target)).withColumn("d", S.cosine_distance(F.col("embedding"), F.col("target")))  # one row
    return ranked.orderBy("d", "vec_id").limit(k).select("vec_id", F.round("d", 6).alias("distance"), "label")


@query(KNN + " SELECT vec_id, distance FROM near")
def f09_knn(r):
    return nearest(r).select("vec_id", "distance")


@query(KNN + " SELECT vec_id, distance FROM near WHERE label % 2 = 0")
def f10_knn_then_filter(r):
    return nearest(r).filter("label % 2 = 0").select("vec_id", "distance")


@query(KNN + " SELECT vec_id, distance FROM near WHERE vec_id NOT IN (SELECT content_id FROM tree)")
def f11_knn_dead_ends(r):
    return nearest(r).join(r.tree.select(F.col("content_id").alias("vec_id")), "vec_id", "left_anti").select("vec_id", "distance")
