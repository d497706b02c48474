"""Cut vertices of graphs whose components may be of any size.

A large component is handled by all tasks together: a spanning forest by contraction,
an order of its arcs by pointer jumping along the tour around each tree, the reach of
each subtree by doubling, and a graph of tree edges whose components are the blocks. Every
step is a join or an aggregation, and all loops take some logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import drop_scratch, materialize
from .ordering import numbered


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(u, v): edges of one tree for each component; edges: (u, v), longs, in no matter which direction, materialized.

    A round links each node to its least neighbour that is less, by one edge of the graph, shortens
    these links to their roots, and contracts the graph by them.
    """
    g = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    g = materialize(g.select("u", "v", F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.a", "e.b", "u", "v"), "forest")
    found, scratch = [], [g]
    while True:
        hooks = materialize(g.where("b < a").groupBy("a").agg(F.min(F.struct("b", "u", "v")).alias("m")).select("a", "m.b", "m.u", "m.v"), "hooks")
        if not _any(hooks):
            drop_scratch(hooks)
            break
        found.append(hooks.select("u", "v"))
        roots = hooks.select("a", "b")
        while True:  # chains of links fall, so most are short
            far = roots.join(roots.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left")
            roots = materialize(far.select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "links")
            scratch.append(roots)
            moved = _any(roots.where("moved"))
            roots = roots.select("a", "b")
            if not moved:
                break
        for c in "ab":
            own = roots.select(F.col("a").alias(c), F.col("b").alias("_r"))
            g = g.join(own, c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
        g = materialize(g.where("a <> b").groupBy("a", "b").agg(F.min(F.struct("u", "v")).alias("e")).select("a", "b", "e.u", "e.v"), "forest")
        scratch.append(g)
    out = found[0] if found else edges.where("false").select("u", "v")
    for f in found[1:]:
        out = out.unionByName(f)
    out = materialize(out, "trees")
    drop_scratch(*scratch, *found)
    return out


def rooted(trees: DataFrame) -> DataFrame:
    """(node, parent, first, last) of each node, by the tour around its tree; a root, the least node, has no parent; trees: (u, v), materialized.

    first and last are the places of the arcs into and out of a node, so a node is below
    another one if its places lie between. The arc behind x -> y is the one from y to
    the neighbour that follows x among y's; neighbours are numbered over all nodes at
    once, so that a node of many is no hot task.
    """
    arcs = trees.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")
    arcs = materialize(numbered(arcs.select(F.struct("y", "x").alias("s")), "s", "i").select("s.y", "s.x", "i"), "arcs")
    spans = arcs.groupBy("y").agg(F.min("i").alias("low"), F.max("i").alias("high"))
    # the number of the neighbour that follows: the next one, or the first behind the last
    turn = arcs.join(spans.select(F.col("high").alias("i"), "low"), "i", "left").select("x", "y", "i", F.coalesce(F.col("low"), F.col("i") + 1).alias("k"), F.col("low").isNotNull().alias("wraps"))
    after = turn.join(arcs.select(F.col("i").alias("k"), F.col("x").alias("z")), "k")
    d = after.join(arcs.select(F.col("y").alias("z"), F.col("x").alias("y"), F.col("i").alias("next")), ["y", "z"]).select("x", "y", "i", "next", "wraps")
    from .graph import components  # graph imports this module

    comps = components(trees, "u", "v")
    root = comps.where("node = component").select(F.col("node").alias("y"), F.lit(True).alias("is_root"))
    # the tour of a tree ends where it comes back to its root from the last neighbour
    d = materialize(d.join(root, "y", "left").select("x", "y", "i", F.when(~(F.col("wraps") & F.col("is_root").isNotNull()), F.col("next")).alias("next"), F.lit(1).cast("long").alias("d")), "tour")
    scratch = [arcs, comps]
    while _any(d.where("next is not null")):
        far = d.join(d.select(F.col("i").alias("next"), F.col("next").alias("then"), F.col("d").alias("more")), "next", "left")
        scratch.append(d)
        d = materialize(far.select("x", "y", "i", F.col("then").alias("next"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d")), "tour")
    back = d.select(F.col("x").alias("y"), F.col("y").alias("x"), F.col("d").alias("back"))
    down = d.join(back, ["x", "y"]).where(F.col("d") > F.col("back"))
    nodes = down.select(F.col("y").alias("node"), F.col("x").alias("parent"), (-F.col("d")).alias("first"), (-F.col("back")).alias("last"))
    far = 1 << 62
    nodes = nodes.unionByName(root.select(F.col("y").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(-far).alias("first"), F.lit(far).alias("last")))
    out = materialize(nodes, "rooted")
    drop_scratch(d, *scratch)
    return out


def reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with low and high: the least and greatest first place that edges besides the tree's lead to from the node's subtree.

    Values go up by doubling: after k rounds a node has those of all nodes fewer than 2 ** k levels below it.
    """
    at = nodes.select(F.col("node").alias("b"), F.col("first").alias("f"))
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).toDF("node", "b")
    own = both.join(at, "b").groupBy("node").agg(F.min("f").alias("l"), F.max("f").alias("h"))
    start = nodes.join(own, "node", "left").select("node", F.col("parent").alias("up"), F.least("first", F.coalesce("l", "first")).alias("low"), F.greatest("first", F.coalesce("h", "first")).alias("high"))
    d, scratch = materialize(start, "reach"), []
    while _any(d.where("up is not null")):
        below = d.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.min("low").alias("l"), F.max("high").alias("h"))
        higher = d.select(F.col("node").alias("up"), F.col("up").alias("then"))
        scratch.append(d)
        d = d.join(below, "node", "left").join(higher, "up", "left")
        d = materialize(d.select("node", F.col("then").alias("up"), F.least("low", "l").alias("low"), F.greatest("high", "h").alias("high")), "reach")
    out = materialize(nodes.join(d.select("node", "low", "high"), "node"), "reached")
    drop_scratch(d, *scratch)
    return out


def blocks(edges: DataFrame) -> DataFrame:
    """(node, parent, block) of each node of the spanning forest but the roots: the block of the edge to its parent, and the roots with none; edges: (u, v), longs, materialized."""
    from .graph import components

    trees = spanning_forest(edges)
    nodes = rooted(trees)
    same = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    others = materialize(same.join(trees.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti"), "others")
    own = reach(nodes, others)
    place = own.select("node", "first", "last")
    met = others.join(place.toDF("u", "fu", "lu"), "u").join(place.toDF("v", "fv", "lv"), "v")
    apart = met.where((F.col("lu") < F.col("fv")) | (F.col("lv") < F.col("fu"))).select("u", "v")
    up = own.join(place.toDF("parent", "fp", "lp"), "parent").where((F.col("low") < F.col("fp")) | (F.col("high") > F.col("lp")))
    linked = materialize(apart.unionByName(up.select(F.col("node").alias("u"), F.col("parent").alias("v"))), "linked")
    comps = components(linked, "u", "v")
    out = own.join(comps, "node", "left").select("node", "parent", F.when(F.col("parent").isNotNull(), F.coalesce("component", "node")).alias("block"))
    out = materialize(out, "blocks")
    drop_scratch(trees, nodes, others, own, linked, comps)
    return out


def cut_nodes(edges: DataFrame) -> DataFrame:
    """(node): those whose edges are of two blocks or more; edges: (u, v), longs."""
    e = materialize(edges.select("u", "v"), "edges")
    own = blocks(e)
    ends = own.where("parent is not null").select(F.explode(F.array("node", "parent")).alias("node"), "block")
    out = materialize(ends.groupBy("node").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a <> b").select("node"), "cuts")
    drop_scratch(e, own)
    return out
