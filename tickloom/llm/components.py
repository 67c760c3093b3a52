"""Groups of records linked directly or through others, by seed-tree pruning.

Each round has two steps. Selection: every vertex u finds the least vertex m(u) of itself and
its neighbours and tells it to all of them, so x gets the arcs x -> m(u) of its neighbours u.
Pruning: a vertex that nobody chose, itself included, drops out of the graph and hangs below
the least of its arcs in a propagation forest; the other ends of its arcs become neighbours of
that least one. Vertices shrink by at least half a round in practice, so the rounds are about
logarithmic in the longest chain. Ids are numbered in their order by one sort, and all rounds are on
the numbers. When no edge is left, what never dropped out are the seeds,
the least vertex of each group, and their ids flow down the forest, last round first.

Scale: all groupings are minima or distinct pairs, combined before the shuffle. A vertex with
many edges meets its one row of the other side by a join; vertices that have more than
1 / ``HOT_SHARE`` of all rows are at most ``HOT_SHARE`` and that join is a broadcast of them, the
rest goes through a shuffle. Each round is cut by a reliable checkpoint; only counts reach the driver.

Defined results for odd input: NULL, empty and self pairs are no links; repeated and reversed
pairs are one; an empty table gives no rows; ids are strings compared by their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

HOT_SHARE, HOT_FROM = 1000, 1_000_000
#: White space around ids that doesn't count (fixed values).
BLANKS = " \t\n\r\x0b\x0c 　"


def meet(many: DataFrame, one: DataFrame, key: str, rows: int) -> DataFrame:
    """many join one on ``key``; ``one`` has each key once and its number ``n`` of rows in ``many``."""
    if rows < HOT_FROM:
        return many.join(one.drop("n"), key)
    hot = F.col("n") > rows // HOT_SHARE
    few = F.broadcast(one.where(hot).drop("n"))
    return many.join(few, key).unionByName(many.join(few.select(key), key, "left_anti").join(one.where(~hot).drop("n"), key))


def _numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers in the order of the ids (number, id), and edges (u, v) both ways by number."""
    known = cut_lineage(pairs.distinct())
    # a sort puts the ids into partitions by range, so these numbers have the ids' order
    ids = cut_lineage(known.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).orderBy("id").withColumn("number", F.monotonically_increasing_id()))
    rows = 2 * known.count()
    one = lambda end, to: ids.select(F.col("id").alias(end), F.col("number").alias(to), "n")
    named = meet(meet(known, one("a", "u"), "a", rows), one("b", "v"), "b", rows).select("u", "v")
    both = named.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").distinct()
    return ids.select("number", "id"), cut_lineage(both)


def linked_groups(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, group_id) of every id with a link; group_id is the least id of the group."""
    ids, edges = _numbered(pairs.select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b")).where("a <> b and a <> '' and b <> ''"))
    forest: list[tuple[DataFrame, int]] = []
    rows = edges.count()
    while rows:
        least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        arcs = cut_lineage(meet(edges, least, "u", rows).select(F.col("v").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("u").alias("x"), F.col("m").alias("y"))).distinct())
        chosen = arcs.groupBy("x").agg(F.min("y").alias("low"), F.max(F.col("x") == F.col("y")).alias("stays"), F.count("*").alias("n"))
        onward = meet(arcs, chosen.drop("stays"), "x", rows).where("y <> low").select(F.explode(F.array(F.struct(F.col("y").alias("a"), F.col("low").alias("b")), F.struct(F.col("low").alias("a"), F.col("y").alias("b")))).alias("e")).select(F.lit(True).alias("edge"), "e.a", "e.b").distinct()
        dropped = chosen.where("not stays").select(F.lit(False).alias("edge"), F.col("low").alias("a"), F.col("x").alias("b"))
        step = cut_lineage(onward.unionByName(dropped))
        sizes = {r.edge: r.n for r in step.groupBy("edge").agg(F.count("*").alias("n")).collect()}  # at most two rows
        forest.append((step.where("not edge").select(F.col("a").alias("parent"), F.col("b").alias("child")), sizes.get(False, 0)))
        edges, rows = step.where("edge").select(F.col("a").alias("u"), F.col("b").alias("v")), sizes.get(True, 0)
    if not forest:
        return ids.select("id", F.col("id").alias("group_id"))
    hung = forest[0][0]
    for tree, _ in forest[1:]:
        hung = hung.unionByName(tree)
    seeds = hung.select("parent").distinct().join(hung.select(F.col("child").alias("parent")), "parent", "left_anti")
    labels = cut_lineage(seeds.select(F.col("parent").alias("x"), F.col("parent").alias("seed")))
    for tree, size in reversed(forest):
        # each level's labels are written once; it reads those of the vertices that were left after its round
        children = tree.groupBy("parent").agg(F.count("*").alias("n"))
        known = labels.withColumnRenamed("x", "parent").join(children, "parent")
        labels = labels.unionByName(cut_lineage(meet(tree, known, "parent", size).select(F.col("child").alias("x"), "seed")))
    heads = labels.groupBy("seed").agg(F.count("*").alias("n")).join(ids.withColumnsRenamed({"number": "seed", "id": "group_id"}), "seed")
    total = sum(n for _, n in forest)
    return meet(labels, heads, "seed", total).join(ids.withColumnRenamed("number", "x"), "x").select("id", "group_id")


def reported_links(search_trace: DataFrame, pair_similarities: DataFrame) -> DataFrame:
    """(a, b): duplicates named by the trace and reported pairs with any true flag, ids without blanks around."""
    clean = lambda c: F.btrim(F.col(c), F.lit(BLANKS))
    named = search_trace.select(clean("candidate_id").alias("a"), F.explode(F.array(clean("exact_duplicate_of"), clean("behavior_duplicate_of"))).alias("b"))
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("exact_signals", "exact_entries", "highly_overlapping", "behaviorally_similar")]
    seen = pair_similarities.where(flags[0] | flags[1] | flags[2] | flags[3]).select(clean("left_id").alias("a"), clean("right_id").alias("b"))
    return named.unionByName(seen)
