"""The relations of a repository, and a synthetic repository over the test tables.

``commits(commit_id, author, time, message)``, ``edges(commit_id, parent_id,
ord)``, ``tree(commit_id, path, content_id, size, mode)``, ``refs(name,
commit_id)``, ``blobs(content_id, text)``, ``facts(e, a, v, tx)``.  Contents are
never part of the trees: plans carry ids and join ``blobs`` last.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

HEAD = "refs/heads/c1"


class Repository:
    """Orders of a customer are a line of commits with some merges; line items are the files of a commit."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def commits(self) -> DataFrame:
        authors = self.table("customer").select("c_custkey", "c_name")
        orders = self.table("orders").join(authors, F.col("o_custkey") == F.col("c_custkey"))
        return orders.select(
            F.col("o_orderkey").alias("commit_id"), F.col("c_name").alias("author"),
            F.col("o_orderdate").alias("time"), F.col("o_orderpriority").alias("message"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        line = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("commit_id"), F.lag("o_orderkey").over(line).alias("first"),
            F.when(F.col("o_orderkey") % 4 == 0, F.lag("o_orderkey", 3).over(line)).alias("second"),
        )
        parents = F.posexplode(F.array("first", "second")).alias("ord", "parent_id")
        return orders.select("commit_id", parents).filter("parent_id is not null").select("commit_id", "parent_id", "ord")

    @cached_property
    def _lines(self) -> DataFrame:
        path = F.concat(F.lit("src/d"), F.col("l_partkey") % 5, F.lit("/m"), F.col("l_partkey") % 40, F.lit(".clj"))
        return self.table("lineitem").select(F.col("l_orderkey").alias("commit_id"), path.alias("path"), "l_suppkey", "l_quantity")

    @cached_property
    def tree(self) -> DataFrame:
        # By commit, so that grouping by commit and path, by directory, and joins on the commit need no other exchange.
        return self._files(self._lines.repartition("commit_id"))

    def trees_of(self, commits: DataFrame) -> DataFrame:
        """The part of ``tree`` that is of ``commits(commit_id)``: the lines of others are left out before files are made of them."""
        return self._files(self._lines.join(commits.select("commit_id").distinct(), "commit_id", "left_semi"))

    @staticmethod
    def _files(lines: DataFrame) -> DataFrame:
        files = lines.groupBy("commit_id", "path")
        return files.agg(F.max("l_suppkey").alias("content_id"), F.sum("l_quantity").cast("long").alias("size")).withColumn("mode", F.lit(33188))

    @cached_property
    def refs(self) -> DataFrame:
        last = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
        heads = self.table("orders").groupBy("o_custkey").agg(last.alias("commit_id"))
        return heads.select(F.concat(F.lit("refs/heads/c"), "o_custkey").alias("name"), "commit_id")

    @cached_property
    def blobs(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("content_id"), "text")

    @cached_property
    def worktree(self) -> DataFrame:
        path = F.concat_ws("/", "source", "lang", F.concat(F.lit("f"), F.col("doc_id"), F.lit(".txt")))
        return self.table("documents").select(path.alias("path"), F.col("doc_id").alias("content_id"), F.octet_length("text").cast("long").alias("size"), F.lit(33188).alias("mode"))

    @cached_property
    def facts(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("e"), F.col("event_type").alias("a"), F.col("value").alias("v"), F.col("ts").alias("tx"), "event_id")

    def tree_of(self, source: object) -> DataFrame:
        """(path, content_id, size, mode) of ``head``, ``worktree``, ``empty`` or a commit's id."""
        fields = ("path", "content_id", "size", "mode")
        if source == "worktree":
            return self.worktree.select(*fields)
        if source == "head":
            return self.tree.join(self.refs.filter(F.col("name") == HEAD), "commit_id", "left_semi").select(*fields)
        return self.tree.filter(F.lit(False) if source == "empty" else F.col("commit_id") == source).select(*fields)

    def sql(self, text: str, **relations: DataFrame) -> DataFrame:
        """Spark SQL in which ``{name}`` stands for a relation of the repository or one given here; no view is left behind."""
        own = {n: getattr(self, n) for n in ("commits", "edges", "tree", "refs", "blobs", "worktree", "facts") if "{" + n + "}" in text}
        return self.spark.sql(text, **own, **relations)


#: The same relations as common table expressions.
SQL = """
commits AS (SELECT o_orderkey AS commit_id, c_name AS author, o_orderdate AS time, o_orderpriority AS message FROM orders JOIN customer ON o_custkey = c_custkey),
lagged AS (SELECT o_orderkey, lag(o_orderkey) OVER w AS p0, CASE WHEN o_orderkey % 4 = 0 THEN lag(o_orderkey, 3) OVER w END AS p1
           FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
edges AS (SELECT o_orderkey AS commit_id, p0 AS parent_id, 0 AS ord FROM lagged WHERE p0 IS NOT NULL
          UNION ALL SELECT o_orderkey, p1, 1 FROM lagged WHERE p1 IS NOT NULL),
tree AS (SELECT l_orderkey AS commit_id, 'src/d' || (l_partkey % 5) || '/m' || (l_partkey % 40) || '.clj' AS path, max(l_suppkey) AS content_id,
         CAST(sum(l_quantity) AS BIGINT) AS size, 33188 AS mode FROM lineitem GROUP BY 1, 2),
refs AS (SELECT 'refs/heads/c' || o_custkey AS name, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS commit_id FROM orders GROUP BY o_custkey),
worktree AS (SELECT source || '/' || lang || '/f' || doc_id || '.txt' AS path, doc_id AS content_id, CAST(strlen(text) AS BIGINT) AS size, 33188 AS mode FROM documents),
facts AS (SELECT user_id AS e, event_type AS a, value AS v, ts AS tx, event_id FROM events)"""
