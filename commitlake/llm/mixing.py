"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves' members in a tree of domain, language and source.  The
token budget is handed down the tree: each node shares its budget among its
children by weight, none gets more than it can give (the tokens of its leaves
that have no node of weight 0 above them, times ``max_epochs``), and what a child cannot use goes to its siblings by weight;
only what a whole subtree cannot use comes back to the ancestors' children.
A leaf's quota is met by whole epochs over its documents and a prefix of one
more epoch, in an order seeded by (seed, epoch, document): as many documents
as fit, in order, without going over the quota.

All quotas are exact integers, found by window sums over the tree's nodes.  The
prefix is cut without sorting a leaf: tokens are summed for each (leaf, bucket
of the order), only the bucket in which a quota ends is ordered, and its last
document's key becomes the leaf's cut-off.

Edge cases: a null text has no tokens; null domain, language or source is a
node of its own; nodes without a weight weigh ``default_weight``, those of
weight 0 get nothing; repeated rows share a key and are taken or left together,
so that a prefix never ends inside a tie; an empty table or a budget of 0 gives
an empty result.  The result has the columns of ``docs`` and ``epoch`` (one of
that name in ``docs`` is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .literals import literal_table
from .ranking import buckets_for
from .storage import materialize

LEVELS = ("domain", "lang", "source")
TOKENS = "[^\\x20\\x09-\\x0D]+"


def token_count(text_col: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(TOKENS)).cast("long")


def _number(c: Column, digits: int = 19) -> Column:
    return c.cast(f"decimal({digits},0)")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``quota``: the parents' ``budget`` over nodes(parent.., name, weight, cap), capped, by weight, in integers.

    Nodes in order of cap / weight: the first ones fill up while their cap is
    at most their share of what is left; the others share the rest by rounded
    running sums, so the quotas add up exactly.
    """
    order = [F.try_divide(F.col("cap"), F.col("weight")).asc_nulls_last(), F.col(name).asc_nulls_first()]
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)
    out = nodes.withColumns({
        "_w": F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), zero),
        "_b": F.col("budget") - F.coalesce(F.sum("cap").over(before), zero),
    })
    full = _number(F.col("cap")) * _number(F.col("_w"), 15) <= _number(F.col("weight"), 15) * _number(F.col("_b"))
    out = out.withColumn("_full", (F.col("weight") > 0) & full)
    out = out.withColumns({
        "_left": F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(group), zero),
        "_weights": F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group), zero),
        "_to": F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(upto), zero),
    })

    def part(weight: Column) -> Column:
        product = _number(weight, 15) * _number(F.greatest(F.col("_left"), zero))
        return F.when(F.col("_weights") > 0, F.floor(product / F.greatest(F.col("_weights"), F.lit(1)).cast("decimal(15,0)")).cast("long")).otherwise(0)

    # Decimal division rounds; the remainder test puts a quotient that was rounded up back down.
    def exact(weight: Column) -> Column:
        q = part(weight)
        over = _number(q) * _number(F.col("_weights"), 15) > _number(weight, 15) * _number(F.greatest(F.col("_left"), zero))
        return q - F.when(over, 1).otherwise(0)

    rest = exact(F.col("_to")) - exact(F.col("_to") - F.col("weight"))
    out = out.withColumn("quota", F.when(F.col("_full"), F.col("cap")).when(F.col("weight") > 0, rest).otherwise(0).cast("long"))
    return out.drop("_w", "_b", "_full", "_left", "_weights", "_to")


def budgets(leaves: DataFrame, total: int, weights: dict[tuple, int], max_epochs: int, default_weight: int = 1) -> DataFrame:
    """``leaves(domain, lang, source, tokens)`` with ``quota``.  ``weights``: of nodes by path, as ("web",) or ("web", "en")."""
    spark = leaves.sparkSession
    rows = [{**{level: (path + (None,) * 3)[i] for i, level in enumerate(LEVELS)}, "depth": len(path), "weight": w} for path, w in weights.items()]
    table = literal_table(spark, rows, "domain string, lang string, source string, depth int, weight long")
    nodes = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    for depth in range(1, 4):
        path = list(LEVELS[:depth])
        given = table.filter(F.col("depth") == depth).select(*[F.col(p).alias(f"_{p}") for p in path], F.col("weight").alias("_weight"))
        nodes = nodes.join(F.broadcast(given), [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in path], "left")  # the given weights
        weight = F.coalesce("_weight", F.lit(default_weight)).cast("long")
        nodes = nodes.withColumns({f"weight{depth}": weight, "cap": F.when(weight > 0, F.col("cap")).otherwise(0)}).drop("_weight", *[f"_{p}" for p in path])
    above = None
    for depth in range(1, 4):
        path = list(LEVELS[:depth])
        level = nodes.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"), F.first(f"weight{depth}").alias("weight"))
        if above is None:
            level = level.withColumn("budget", F.lit(total).cast("long"))
        else:
            up = above.select(*[F.col(p).alias(f"_{p}") for p in path[:-1]], F.col("quota").alias("budget"))
            level = level.join(up, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in path[:-1]]).drop(*[f"_{p}" for p in path[:-1]])
        above = share_out(level, path[:-1], path[-1])
    return above.select(*LEVELS, "tokens", "weight", "quota")


def _same_leaf(prefix: str = "_") -> list[Column]:
    return [F.col(p).eqNullSafe(F.col(prefix + p)) for p in LEVELS]


def mix(docs: DataFrame, domain: Column, weights: dict[tuple, int], total: int | None = None, fraction: float | None = None, max_epochs: int = 2,
        seed: int = 0, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` once for each epoch that takes them, with ``epoch``; give ``total`` tokens or a ``fraction`` of those there are."""
    if (total is None) == (fraction is None):
        raise ValueError("give either total or fraction")
    mine = "__mix_"
    document = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    leaf_of = {"domain": domain.cast("string"), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string")}
    keyed = docs.withColumns({**{f"{mine}{p}": c for p, c in leaf_of.items()}, f"{mine}document": document}).drop("epoch")
    meta = docs.select(*[c.alias(p) for p, c in leaf_of.items()], document.alias("document"), (tokens if tokens is not None else token_count(text_col)).alias("tokens"))
    meta = materialize(meta, "mix-documents")
    leaves = meta.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    leaves = materialize(leaves, "mix-leaves")
    there, rows = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    budget = int(total if total is not None else there * fraction)
    quotas = budgets(leaves, budget, weights, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(0)
    quotas = quotas.withColumn("whole", whole.cast("int")).withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens"))
    quotas = materialize(quotas.select(*[F.col(p).alias(f"_{p}") for p in LEVELS], "whole", "rest"), "mix-quotas")

    def key(whole: Column, document: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(seed), whole, document).cast("binary"))

    count = buckets_for(rows)

    def bucket(k: Column) -> Column:
        return F.floor(F.conv(F.substring(k, 1, 8), 16, 10).cast("long") * count / 4294967296).cast("long")

    partial = meta.join(quotas, _same_leaf()).filter("rest > 0").withColumn("key", key(F.col("whole"), F.col("document"))).withColumn("bucket", bucket(F.col("key")))
    leaf = [f"_{p}" for p in LEVELS]
    sums = partial.groupBy(*leaf, "rest", "bucket").agg(F.sum("tokens").alias("here"))
    upto = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("upto", F.sum("here").over(upto)).filter("upto > rest and upto - here <= rest")
    ends = materialize(ends.select(*[F.col(f"_{p}").alias(f"e_{p}") for p in LEVELS], F.col("bucket").alias("end"), (F.col("upto") - F.col("here")).alias("before")), "mix-ends")
    inside = partial.join(ends, [F.col(f"_{p}").eqNullSafe(F.col(f"e_{p}")) for p in LEVELS] + [F.col("bucket") == F.col("end")])
    running = F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("key"))  # rows of a tie count together
    last = inside.withColumn("running", F.col("before") + running).filter("running <= rest").groupBy(*leaf).agg(F.max("key").alias("last"))
    cut = ends.join(last, [F.col(f"e_{p}").eqNullSafe(F.col(f"_{p}")) for p in LEVELS], "left").select(*[f"e_{p}" for p in LEVELS], "end", "last")
    plan = quotas.join(cut, [F.col(f"_{p}").eqNullSafe(F.col(f"e_{p}")) for p in LEVELS], "left").select(*leaf, "whole", "rest", "end", "last")
    plan = materialize(plan, "mix-plan")

    # Names of its own, so that columns of ``docs`` cannot clash.
    plan = plan.select(*[F.col(f"_{p}").alias(f"{mine}leaf_{p}") for p in LEVELS], *[F.col(c).alias(mine + c) for c in ("whole", "rest", "end", "last")])
    out = keyed.join(plan, [F.col(f"{mine}{p}").eqNullSafe(F.col(f"{mine}leaf_{p}")) for p in LEVELS])
    whole, rest, end, last = (F.col(mine + c) for c in ("whole", "rest", "end", "last"))
    order = key(whole, F.col(f"{mine}document"))
    taken = (rest > 0) & (end.isNull() | (bucket(order) < end) | ((bucket(order) == end) & (order <= F.coalesce(last, F.lit("")))))
    copies = whole + F.when(taken, 1).otherwise(0)
    out = out.withColumn(f"{mine}copies", copies).filter(F.col(f"{mine}copies") > 0)
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col(f"{mine}copies") - 1)))
    return out.select(*[c for c in docs.columns if c != "epoch"], "epoch")
