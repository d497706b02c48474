"""Modularity of partitions, and communities of components that no one task holds.

Nodes move at the same time, by joins: in a sweep a seeded half of the communities gives nodes
and the other half takes them, where the gain is greatest under the partition that stood before, ties by a
seeded hash. A node goes if its gain stays one with all others that leave its community or
enter the new one, or if its gain is the greatest of both; so no sweep lowers the modularity.
A level ends when no node would gain by a move; communities are then contracted to nodes, until that helps no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import drop_scratch, materialize


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (modularity) of a partition; edges: (source, target, weight), each once; labels: (node_id, community). Nodes without a label are alone."""
    own = labels.select("node_id", F.col("community").cast("string").alias("c"))
    e = edges.join(own.toDF("source", "ca"), "source", "left").join(own.toDF("target", "cb"), "target", "left")
    name = lambda c, node: F.when(F.col(c).isNotNull(), F.concat(F.lit("c"), c)).otherwise(F.concat(F.lit("n"), F.col(node).cast("string")))
    e = e.select(name("ca", "source").alias("a"), name("cb", "target").alias("b"), F.col("weight").cast("double").alias("w"))
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("w").alias("k"), F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0).alias("i")), F.struct(F.col("b").alias("c"), F.col("w").alias("k"), F.lit(0.0).alias("i")))).alias("x")).select("x.*")
    sums = ends.groupBy("c").agg(F.sum("k").alias("k"), F.sum("i").alias("i"))
    m2 = F.sum("k")
    return sums.agg(F.coalesce(2 * F.sum("i") / m2 - F.sum(F.col("k") * F.col("k")) / (m2 * m2), F.lit(0.0)).alias("modularity"))


def _level(g: DataFrame, total2: float, seed: int, level: int, sweeps: int) -> tuple[DataFrame, bool]:
    """(node, c) after the moves of one level, and whether any node moved; g: (a, b, w), both directions, a node's own weight as b = a."""
    state = materialize(g.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).select("node", F.col("node").alias("c"), "k"), "state")
    moved_ever = False
    dice = lambda *x: F.xxhash64(F.lit(seed), F.lit(level), *x)
    for sweep in range(sweeps):
        totals = state.groupBy("c").agg(F.sum("k").alias("tot"))
        to = g.where("a <> b").join(state.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").alias("w"))
        to = to.unionByName(state.select("node", "c", F.lit(0.0).alias("w"))).groupBy("node", "c").agg(F.sum("w").alias("w"))
        d = to.join(totals, "c").join(state.select("node", F.col("c").alias("home"), "k"), "node")
        at_home = F.col("c") == F.col("home")
        gain = F.col("w") - (F.col("tot") - F.when(at_home, F.col("k")).otherwise(0.0)) * F.col("k") / total2
        takes = lambda c: F.pmod(dice(F.lit(sweep), F.col(c)), F.lit(2)) == 0  # noqa: B023, E731
        d = d.select("node", "home", "k", "c", gain.alias("gain"), at_home.alias("stay"))
        here = F.when(F.col("stay") | takes("c") & ~takes("home"), F.struct("gain", dice("c").alias("t"), "c"))
        best = d.groupBy("node", "home", "k").agg(F.max(here).alias("best"), F.max(F.when(F.col("stay"), F.col("gain"))).alias("now"), F.max("gain").alias("top"))
        asked = materialize(best.select("node", "home", "k", F.col("best.c").alias("to"), (F.col("best.gain") - F.col("now")).alias("up"), (F.col("top") - F.col("now")).alias("most")), "asked")
        if not asked.where("most > 1e-12").limit(1).count():
            drop_scratch(asked)
            break
        moved_ever = True
        moves = asked.where("up > 1e-12")
        for side in ("to", "home"):
            first = F.max(F.struct("up", dice(F.lit(sweep), "node").alias("t"), "node"))["node"]
            moves = moves.join(asked.where("up > 1e-12").groupBy(side).agg(F.sum("k").alias(f"k_{side}"), first.alias(f"first_{side}")), side)
        sure = F.col("up") - (F.col("k_to") + F.col("k_home") - 2 * F.col("k")) * F.col("k") / total2 > 1e-12
        gone = moves.where(sure | (F.col("node") == F.col("first_to")) & (F.col("node") == F.col("first_home"))).select("node", F.col("to").alias("new"))
        before = state
        state = materialize(asked.join(gone, "node", "left").select("node", F.coalesce("new", "home").alias("c"), "k"), "state")
        drop_scratch(before, asked)
    return state.select("node", "c"), moved_ever


def large_communities(edges: DataFrame, total: float, seed: int = 42, sweeps: int = 60, levels: int = 20) -> DataFrame:
    """(node, community) of numbered nodes; edges: (u, v, weight), longs; total: the weight of the whole graph, other components included."""
    both = F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b"), F.col("weight").alias("w")), F.struct(F.col("v").alias("a"), F.col("u").alias("b"), F.col("weight").alias("w")))
    g = materialize(edges.select(F.explode(both).alias("e")).select("e.*").groupBy("a", "b").agg(F.sum(F.col("w").cast("double")).alias("w")), "level")
    labels = g.select(F.col("a").alias("node"), F.col("a").alias("c")).distinct()
    for level in range(levels):
        found, moved = _level(g, 2 * total, seed, level, sweeps)
        if not moved:
            break
        joined = labels.join(found.select(F.col("node").alias("c"), F.col("c").alias("to")), "c").select("node", F.col("to").alias("c"))
        labels = materialize(joined, "labels")
        own = found.select(F.col("node").alias("a"), F.col("c").alias("x")), found.select(F.col("node").alias("b"), F.col("c").alias("y"))
        before = g
        g = materialize(g.join(own[0], "a").join(own[1], "b").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")), "level")
        drop_scratch(before, found)
    return labels.select("node", F.col("c").alias("community"))
