"""Queries of object codecs, ranges, configuration and picked commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph, state
from ..sources import objects
from .catalog import CHANGES, PAIRS, pairs, query


def entries(r):
    """The files of every commit as the entries of one tree; an id stands for the content's."""
    oid = F.sha1(F.col("content_id").cast("string").cast("binary"))
    return r.tree.select("commit_id", F.lit("100644").alias("mode"), F.substring_index("path", "/", -1).alias("name"), oid.alias("oid"))


@query("""SELECT commit_id, '100644' AS mode, split_part(path, '/', 3) AS name, sha1(content_id::VARCHAR) AS oid FROM tree""")
def o03_tree_entries(r):
    return objects.tree_entries(objects.encode_trees(entries(r), ["commit_id"]), ["commit_id"])


@query(""", e AS (SELECT commit_id, split_part(path, '/', 3) AS name, sha1(content_id::VARCHAR) AS oid FROM tree),
p AS (SELECT commit_id, string_agg(hex('100644 ' || name) || '00' || upper(oid), '' ORDER BY name) AS h FROM e GROUP BY 1)
SELECT commit_id, sha1(encode('tree ' || (length(h) // 2)) || '\\x00'::BLOB || unhex(h)) AS oid FROM p""")
def o02_tree_id(r):
    return objects.encode_trees(entries(r), ["commit_id"]).select("commit_id", "oid")


@query("SELECT DISTINCT sha1(('blob ' || strlen(text))::BLOB || '\\x00'::BLOB || encode(text)) AS oid, 'blob' AS kind, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL")
def o12_pack_scan(r):
    packs = objects.write_packs(r.blobs.select(F.encode("text", "utf-8").alias("payload")))
    return objects.read_packs(packs).select("oid", "kind", "size").distinct()


@query("""SELECT doc_id AS content_id, sha1(('blob ' || strlen(text))::BLOB || '\\x00'::BLOB || encode(text)) AS oid FROM documents WHERE doc_id % 10 = 0 AND text IS NOT NULL""")
def o17_object_lookup(r):
    """The objects of asked contents, found in an index by id."""
    index = r.blobs.select("content_id", S.object_id("blob", F.encode("text", "utf-8")).alias("oid"))
    asked = index.filter("content_id % 10 = 0")
    return objects.index_lookup(index, asked).join(asked.select("content_id"), "content_id", "left_semi")


@query(PAIRS + """, common AS (SELECT "left", "right", a.commit_id, a.distance + b.distance AS cost FROM pairs JOIN far a ON a.root = "left" JOIN far b ON b.root = "right" AND a.commit_id = b.commit_id),
bases AS (SELECT "left", "right", arg_min(commit_id, (cost, commit_id::VARCHAR)) AS base FROM common GROUP BY ALL)
SELECT "left", "right", 2 AS dots, "left" AS before, "right" AS after FROM pairs UNION ALL SELECT "left", "right", 3, base, "right" FROM pairs LEFT JOIN bases USING ("left", "right")""", recursive=True)
def e04_range_pairs(r):
    ranges = pairs(r).select("left", "right", F.explode(F.array(F.lit(2), F.lit(3))).alias("dots"))
    return graph.range_pairs(r.edges, ranges)


@query("SELECT c_mktsegment || c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS value FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 = 0")
def k02_set_config(r):
    customers = r.table("customer")
    key = F.concat("c_mktsegment", "c_custkey").alias("key")
    set_to = F.when(F.col("c_custkey") % 3 == 0, "new").alias("value")
    updates = customers.filter("c_custkey % 3 = 0 or c_custkey % 5 = 0").select(key, set_to)
    return state.set_config(customers.select(key, F.col("c_name").alias("value")), updates)


@query("""SELECT coalesce(c_custkey, s_suppkey) AS key, coalesce(c_name, s_name) AS value, CASE WHEN c_custkey IS NULL THEN 'global' ELSE 'local' END AS origin
FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) FULL JOIN supplier ON c_custkey = s_suppkey""")
def z12_effective_config(r):
    local = r.table("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    return state.effective_config(local, r.table("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value")))


PICKS = CHANGES + """, picks AS (SELECT f.commit_id, CASE WHEN f.commit_id % 2 = 0 THEN f.parent_id ELSE g.parent_id END AS onto FROM firsts f JOIN firsts g ON g.commit_id = f.parent_id WHERE f.commit_id % 5 = 0),
tested AS (SELECT p.commit_id, onto, c.path, kind, new_content, (old_content IS NOT DISTINCT FROM t.content_id AND old_size IS NOT DISTINCT FROM t.size) AS fits
  FROM picks p JOIN changes c USING (commit_id) LEFT JOIN tree t ON t.commit_id = onto AND t.path = c.path),
verdicts AS (SELECT p.commit_id, p.onto, count(path) AS changes, coalesce(bool_and(fits), true) AS applicable FROM picks p LEFT JOIN tested USING (commit_id, onto) GROUP BY ALL)"""


def picked(r):
    first = r.edges.filter("ord = 0").select("commit_id", "parent_id")
    second = first.select(F.col("commit_id").alias("parent_id"), F.col("parent_id").alias("grandparent"))
    onto = F.when(F.col("commit_id") % 2 == 0, F.col("parent_id")).otherwise(F.col("grandparent"))
    picks = first.join(second, "parent_id").filter("commit_id % 5 = 0").select("commit_id", onto.alias("onto"))
    return state.cherry_pick(r.tree, r.commits, r.edges, picks)


@query(PICKS + " SELECT * FROM verdicts")
def m06_cherry_pick(r):
    return picked(r)[0]


@query(PICKS + """ SELECT v.commit_id, v.onto, t.path, t.content_id FROM verdicts v JOIN tree t ON t.commit_id = v.onto
WHERE applicable AND NOT EXISTS (SELECT 1 FROM tested x WHERE x.commit_id = v.commit_id AND x.onto = v.onto AND x.path = t.path)
UNION ALL SELECT x.commit_id, x.onto, x.path, new_content FROM tested x JOIN verdicts USING (commit_id, onto) WHERE applicable AND kind <> 'deleted'""")
def m06_picked_trees(r):
    return picked(r)[1].select("commit_id", "onto", "path", "content_id")
