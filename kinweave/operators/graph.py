"""Graphs of hits: components, bipartite networks, twins, cut vertices, communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CLUSTER_COLOR, category_color
from ..runtime import drop_scratch, materialize
from . import biconnected, modularity
from .joins import join_lookup, self_pairs
from .ordering import numbered


def _scrambled(x: Column) -> Column:
    """A bijection of longs whose order looks random: three rounds that mix one half with a hash of the other."""
    low = F.lit((1 << 32) - 1)
    hi, lo = F.shiftrightunsigned(x, 32), x.bitwiseAND(low)
    lo = lo.bitwiseXOR(F.xxhash64(hi).bitwiseAND(low))
    hi = hi.bitwiseXOR(F.xxhash64(lo).bitwiseAND(low))
    lo = lo.bitwiseXOR(F.xxhash64(hi, F.lit(1)).bitwiseAND(low))
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def components(edges: DataFrame, u: str, v: str, max_rounds: int = 100) -> DataFrame:
    """(node, component): component is the least node that edges lead to.

    Nodes become longs in scrambled order. A round maps every node to the least of
    its neighbourhood and that one's least in turn, contracts the edges by this map
    and drops loops, so later rounds see a fraction of the edges and long chains
    shrink as fast as others. The maps are then composed from the smallest back.
    Every round ends in written tables; joins on a popular label have one row for
    each key on the other side, and adaptive execution splits them. Raises if
    ``max_rounds`` do not suffice.
    """
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    integers = e.schema["a"].dataType.typeName() in ("byte", "short", "integer", "long")
    nodes = materialize(nodes.withColumn("p", _scrambled(F.col("node").cast("long") if integers else F.monotonically_increasing_id())), "nodes")
    if integers:
        e = e.select(_scrambled(F.col("a").cast("long")).alias("a"), _scrambled(F.col("b").cast("long")).alias("b"))
    else:
        for c in "ab":
            e = e.join(nodes.select(F.col("node").alias(c), F.col("p").alias("_p")), c).drop(c).withColumnRenamed("_p", c)
    e = e.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    e, maps, scratch = materialize(e.distinct(), "edges"), [], [nodes]
    for _ in range(max_rounds):
        scratch.append(e)
        if not e.limit(1).count():
            break
        least = materialize(e.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "least")
        after = least.select(F.col("v").alias("label"), F.col("label").alias("far"))
        maps.append(materialize(least.join(after, "label").select("v", F.col("far").alias("label")), "map"))
        scratch += [least, maps[-1]]
        for c in "ab":
            e = e.join(maps[-1].select(F.col("v").alias(c), F.col("label").alias("_l")), c).drop(c).withColumnRenamed("_l", c)
        e = materialize(e.where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = None
    for m in reversed(maps):
        if root is not None:
            m = materialize(m.join(root.select(F.col("v").alias("label"), F.col("label").alias("far")), "label", "left").select("v", F.coalesce("far", "label").alias("label")), "roots")
            scratch.append(m)
        root = m
    own = nodes if root is None else nodes.join(root.withColumnRenamed("v", "p"), "p", "left")
    own = materialize(own.select("node", F.col("p").alias("label") if root is None else F.coalesce("label", "p").alias("label")), "labels")
    out = materialize(own.join(own.groupBy("label").agg(F.min("node").alias("component")), "label").select("node", "component"), "components")
    drop_scratch(own, *scratch)
    return out


#: Edges that one call joins before any is shuffled.
EDGES_TOGETHER = 200_000


def _roots_together(e: DataFrame) -> DataFrame:
    """(node, root) of each node of some edges (a, b) that stand together: root is the least node that these lead to."""
    kind = e.schema["a"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def made(held):
            both = pa.chunked_array([b.column(c) for c in (0, 1) for b in held]).combine_chunks()
            names = both.unique()
            names = names.take(pc.sort_indices(names))
            codes = pc.index_in(both, names).to_pylist()
            up, n = list(range(len(names))), len(codes) // 2
            for x, y in zip(codes[:n], codes[n:], strict=True):
                while up[x] != x:
                    up[x] = x = up[up[x]]
                while up[y] != y:
                    up[y] = y = up[up[y]]
                up[max(x, y)] = min(x, y)
            for k in range(len(up)):  # a root is less than what it leads, so it is settled before
                up[k] = up[up[k]]
            return pa.record_batch([names, names.take(pa.array(up, pa.int32()))], names=["node", "root"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= EDGES_TOGETHER:
                yield made(held)
                held, rows = [], 0
        if rows:
            yield made(held)

    return e.mapInArrow(run, f"node {kind}, root {kind}")


def components_of_near(edges: DataFrame, u: str, v: str) -> DataFrame:
    """``components`` of edges that mostly stand near the others of their component, as hits do that were joined by a cluster: strings or integers.

    Edges that stand together are joined before the shuffle, into one row for each node; nodes that stand in several places link
    these, and ``components`` of the links joins the rest. Right for any order of edges; of scattered ones the links are as many as the edges.
    """
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null")
    by_node = Window.partitionBy("node").orderBy("root")
    roots = materialize(_roots_together(e).select("node", "root", F.row_number().over(by_node).alias("k"), F.first("root").over(by_node).alias("first")), "roots")
    linked = components(roots.where("root <> first").select("root", "first").distinct(), "root", "first")
    own = join_lookup(roots.where("k = 1").select("node", "first"), linked.select(F.col("node").alias("first"), "component"), "first", "left")
    out = materialize(own.select("node", F.coalesce("component", "first").alias("component")), "components")
    drop_scratch(roots, linked)
    return out


def clusters(hits: DataFrame, prefix: str = "CHG_") -> DataFrame:
    """(protein_id, chg_id): components of the hits, numbered by their first hit in order of the unordered pair."""
    comps = components(hits, "query", "target")
    lo, hi = F.least("query", "target"), F.greatest("query", "target")
    first = hits.select(F.struct(lo.alias("lo"), hi.alias("hi")).alias("seq"), F.col("query").alias("node")).join(comps, "node").groupBy("component").agg(F.min("seq").alias("seq"))
    return comps.join(numbered(first, "seq", "i"), "component").select(F.col("node").alias("protein_id"), F.concat(F.lit(prefix), F.col("i").cast("string")).alias("chg_id"))


def members_of_genomes(membership: DataFrame, proteins: DataFrame) -> DataFrame:
    """(protein_id, chg_id, genome_accession); unmapped proteins go."""
    return membership.join(proteins.select("protein_id", "genome_accession"), "protein_id").select("protein_id", "chg_id", "genome_accession")


def genome_cluster_counts(membership: DataFrame, proteins: DataFrame) -> DataFrame:
    """(genome, chg, weight): proteins of each genome in each cluster; unmapped proteins go."""
    joined = members_of_genomes(membership, proteins)
    return joined.groupBy(F.col("genome_accession").alias("genome"), F.col("chg_id").alias("chg")).agg(F.count("*").alias("weight"))


def genomes_per_cluster(counts: DataFrame) -> DataFrame:
    return counts.groupBy("chg").agg(F.countDistinct("genome").alias("n_genomes"))


def genome_sets(counts: DataFrame) -> DataFrame:
    return counts.groupBy("chg").agg(F.array_sort(F.collect_set("genome")).alias("genomes"))


def shared_clusters(counts: DataFrame, least: int = 2) -> DataFrame:
    """counts of clusters with ``least`` or more genomes."""
    keep = genomes_per_cluster(counts).where(F.col("n_genomes") >= least).select("chg")
    return counts.join(keep, "chg", "left_semi")


def taxon_of_genome(proteins: DataFrame) -> DataFrame:
    """(genome_accession, category): lower-cased; the greatest protein id speaks for its genome."""
    return proteins.groupBy("genome_accession").agg(F.max_by(F.lower("taxon"), "protein_id").alias("category"))


def bipartite(counts: DataFrame, proteins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) over clusters of two or more genomes."""
    kept = shared_clusters(counts)
    genomes = kept.select(F.col("genome").alias("node_id")).distinct().join(taxon_of_genome(proteins).withColumnRenamed("genome_accession", "node_id"), "node_id", "left")
    genomes = genomes.select("node_id", F.lit("genome").alias("type"), F.coalesce("category", F.lit("")).alias("category"), category_color(F.coalesce("category", F.lit(""))).alias("color"))
    chgs = kept.select(F.col("chg").alias("node_id")).distinct().select("node_id", F.lit("CHG").alias("type"), F.lit("").alias("category"), F.lit(CLUSTER_COLOR).alias("color"))
    return genomes.unionByName(chgs), kept.select(F.col("genome").alias("source"), F.col("chg").alias("target"), F.col("weight").cast("int").alias("weight"))


def oriented(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(genome, chg, weight) of edges between a genome and a cluster, whichever way they point; others go."""
    kind = nodes.select("node_id", "type")
    d = edges.join(kind.select(F.col("node_id").alias("source"), F.col("type").alias("ts")), "source").join(kind.select(F.col("node_id").alias("target"), F.col("type").alias("tt")), "target")
    forward, back = (F.col("ts") == "genome") & (F.col("tt") == "CHG"), (F.col("ts") == "CHG") & (F.col("tt") == "genome")
    d = d.where(forward | back).select(F.when(forward, F.col("source")).otherwise(F.col("target")).alias("genome"), F.when(forward, F.col("target")).otherwise(F.col("source")).alias("chg"), "weight")
    return d.groupBy("genome", "chg").agg(F.sum("weight").alias("weight"))


def twins(adjacency: DataFrame) -> DataFrame:
    """(chg, representative): clusters with the same genomes share ``CHG_TWIN_k``; k by the least number (then name) in the group."""
    number = F.coalesce(F.regexp_extract("chg", r"(\d+)$", 1).try_cast("bigint"), F.lit((1 << 62)))
    keys = adjacency.groupBy("chg").agg(F.array_sort(F.collect_set("genome")).alias("key")).withColumn("key", F.sha2(F.to_json("key"), 256))
    groups = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(number.alias("i"), F.col("chg").alias("c"))).alias("first"))
    named = numbered(groups.where("n > 1"), "first", "k").select("key", F.concat(F.lit("CHG_TWIN_"), F.col("k").cast("string")).alias("twin"))
    return keys.join(named, "key", "left").select("chg", F.coalesce("twin", "chg").alias("representative"))


def reduced_edges(adjacency: DataFrame, reps: DataFrame) -> DataFrame:
    return adjacency.join(reps, "chg").groupBy(F.col("genome").alias("source"), F.col("representative").alias("target")).agg(F.sum("weight").cast("int").alias("weight"))


def reduced_membership(membership: DataFrame, reps: DataFrame) -> DataFrame:
    joined = membership.withColumnRenamed("chg_id", "original_chg_id").join(reps.withColumnRenamed("chg", "original_chg_id"), "original_chg_id", "left")
    return joined.select("protein_id", F.coalesce("representative", "original_chg_id").alias("chg_id"), "original_chg_id")


def _cut_vertices(edges: list[tuple[str, str]]) -> list[str]:
    """Cut vertices of one connected graph, with an explicit stack."""
    near: dict[str, list[str]] = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    cuts: set[str] = set()
    for root in near:
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        branches, stack = 0, [(root, "", iter(near[root]))]
        while stack:
            x, parent, rest = stack[-1]
            for y in rest:
                if y not in seen:
                    seen[y] = low[y] = len(seen)
                    stack.append((y, x, iter(near[y])))
                    break
                if y != parent:
                    low[x] = min(low[x], seen[y])
            else:
                stack.pop()
                if stack:
                    low[parent] = min(low[parent], low[x])
                    if parent == root:
                        branches += 1
                    elif low[x] >= seen[parent]:
                        cuts.add(parent)
        if branches > 1:
            cuts.add(root)
    return sorted(cuts)


#: Components of up to so many edges are one task's work each; larger ones are handled by all tasks together, with the same result.
ONE_TASK_EDGES = 100_000


def by_component(small: DataFrame, work, schema: str) -> DataFrame:
    """The rows that ``work(rows)`` makes of each components edges; small: edges with component, of up to ``ONE_TASK_EDGES`` each.

    Components of a task follow each other in sorted batches, so that millions of small
    ones cost their own work only, and a task holds a batch and the component it is at.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    columns = [c for c in small.columns if c != "component"]

    def run(batches):
        import pandas as pd

        def made(frames):
            d = pd.concat(frames) if len(frames) > 1 else frames[0]
            keys, values = d["component"].to_numpy(), [d[c].tolist() for c in columns]
            starts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            out = [row for a, b in zip(starts, starts[1:]) for row in work(list(zip(*[v[a:b] for v in values])))]
            return pd.DataFrame(out, columns=names, dtype=str)

        held = []
        for frame in batches:
            if not len(frame):
                continue
            last = frame["component"].iloc[-1]
            if held and held[-1]["component"].iloc[-1] == last:  # one component all over
                held.append(frame)
                continue
            done = (frame["component"] != last).to_numpy()
            yield made([*held, frame[done]])
            held = [frame[~done]]
        if held:
            yield made(held)

    return small.repartition("component").sortWithinPartitions("component").mapInPandas(run, schema)


def by_size(edges: DataFrame, comps: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(edges of components of up to ``most`` edges, with component; edges of larger ones); comps: (node, component)."""
    own = materialize(edges.join(comps.withColumnRenamed("node", "source"), "source"), "own")
    large = materialize(own.groupBy("component").agg(F.count("*").alias("c")).where(F.col("c") > most).select("component"), "large")
    if not large.count():
        return own, edges.where("false")
    return join_lookup(own, large, "component", "left_anti"), join_lookup(own, large, "component", "left_semi").select(edges.columns)


def with_numbers(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with u and v, numbers of source and target; nodes: node, number, in order of the nodes, whatever the partitions), materialized."""
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    nodes = materialize(numbered(nodes, "node", "number"), "nodes")
    for side, name in (("source", "u"), ("target", "v")):
        edges = edges.join(nodes.select(F.col("node").alias(side), F.col("number").alias(name)), side)
    return materialize(edges, "edges"), nodes


def cut_vertices(edges: DataFrame, one_task_edges: int | None = None) -> DataFrame:
    """(node_id): vertices whose removal splits their component."""
    edges = edges.select("source", "target")
    small, large = by_size(edges, components(edges, "source", "target"), ONE_TASK_EDGES if one_task_edges is None else one_task_edges)

    out = by_component(small.select("component", "source", "target"), lambda rows: [(x,) for x in _cut_vertices(rows)], "node_id string")
    if large.limit(1).count():
        e, nodes = with_numbers(large)
        out = out.unionByName(nodes.join(biconnected.cut_nodes(e).withColumnRenamed("node", "number"), "number").select(F.col("node").alias("node_id")))
    return out


def reduce_network(nodes: DataFrame, edges: DataFrame, membership: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges, twin_groups, membership and genomes of the network with twins merged."""
    adj = materialize(oriented(nodes, edges), "adjacency")
    reps = materialize(twins(adj), "twins")
    small = materialize(reduced_edges(adj, reps), "reduced")
    cuts = materialize(cut_vertices(small), "cuts").withColumn("is_articulation", F.lit(True))
    genomes = nodes.where("type = 'genome'").join(adj.select(F.col("genome").alias("node_id")).distinct(), "node_id", "left_semi").select("node_id", "type", "category", "color", F.lit("").alias("twin_group"))
    chgs = reps.select(F.col("representative").alias("node_id")).distinct().join(nodes.select("node_id", "color"), "node_id", "left")
    chgs = chgs.select("node_id", F.lit("CHG").alias("type"), F.lit("").alias("category"), F.coalesce("color", F.lit(CLUSTER_COLOR)).alias("color"), F.when(F.startswith("node_id", F.lit("CHG_TWIN_")), F.col("node_id")).otherwise("").alias("twin_group"))
    out = genomes.unionByName(chgs).join(cuts, "node_id", "left").withColumn("is_articulation", F.coalesce("is_articulation", F.lit(False)))
    groups = reps.where("representative <> chg").select(F.col("representative").alias("twin_group"), F.col("chg").alias("member_chg"))
    return {"nodes": out, "edges": small, "twin_groups": groups, "membership": reduced_membership(membership, reps), "genomes": genomes.select("node_id")}


def genome_network(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): genomes, and pairs weighted by the clusters they share; a cluster of many genomes is split over tasks."""
    pairs = self_pairs(counts.select("chg", "genome").distinct(), ["chg"], "genome")
    edges = pairs.groupBy(F.col("genome_a").alias("source"), F.col("genome_b").alias("target")).agg(F.count("*").alias("weight"))
    return counts.select(F.col("genome").alias("node_id")).distinct(), edges


def strong_edges(hits: DataFrame, min_bitscore: float = 100.0) -> DataFrame:
    """Edges of hits over the score; of a repeated pair the greatest stays. Raises ValueError if there are none."""
    lo, hi = F.least("query", "target"), F.greatest("query", "target")
    over = hits.where(F.col("bits") > min_bitscore)
    if over.limit(1).count() == 0:
        raise ValueError("no edge is over the bit score")
    return over.groupBy(lo.alias("source"), hi.alias("target")).agg(F.max("bits").alias("weight"))


def _louvain(rows: list[tuple[str, str, float]], total: float, seed: int) -> dict[str, int]:
    """Greedy modularity moves, level by level, in a seeded order. total: the weight of the whole graph."""
    import random

    rng = random.Random(seed)
    names = sorted({x for a, b, _ in rows for x in (a, b)})
    at = {x: i for i, x in enumerate(names)}
    graph: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in rows:
        i, j = at[a], at[b]
        graph[i][j] = graph[i].get(j, 0.0) + w
        graph[j][i] = graph[j].get(i, 0.0) + w * (i != j)
    belongs = list(range(len(names)))
    while True:
        n = len(graph)
        degree = [sum(g.values()) + g.get(i, 0.0) for i, g in enumerate(graph)]
        home, weight, moved = list(range(n)), degree[:], False
        for _ in range(50):
            order, any_move = list(range(n)), False
            rng.shuffle(order)
            for i in order:
                links: dict[int, float] = {}
                for j, w in graph[i].items():
                    if j != i:
                        links[home[j]] = links.get(home[j], 0.0) + w
                weight[home[i]] -= degree[i]
                gain = lambda c: links.get(c, 0.0) - weight[c] * degree[i] / (2 * total)  # noqa: B023, E731
                best = max(sorted(links), key=gain, default=home[i])
                if gain(best) > gain(home[i]) + 1e-12:
                    home[i], any_move, moved = best, True, True
                weight[home[i]] += degree[i]
            if not any_move:
                break
        if not moved:
            return {x: belongs[i] for x, i in at.items()}
        ids = {c: k for k, c in enumerate(sorted(set(home)))}
        belongs = [ids[home[b]] for b in belongs]
        merged: list[dict[int, float]] = [{} for _ in ids]
        for i, g in enumerate(graph):
            for j, w in g.items():
                a, b = ids[home[i]], ids[home[j]]
                if i == j:
                    merged[a][a] = merged[a].get(a, 0.0) + w
                elif a != b:
                    merged[a][b] = merged[a].get(b, 0.0) + w
                elif i < j:
                    merged[a][a] = merged[a].get(a, 0.0) + w
        graph = merged


def strong_components(hits: DataFrame, min_bitscore: float = 100.0) -> DataFrame:
    """(node, component) of the ``strong_edges``."""
    return components_of_near(hits.where(F.col("bits") > min_bitscore), "query", "target")


def communities(hits: DataFrame, min_bitscore: float = 100.0, seed: int = 42, one_task_edges: int | None = None, comps: DataFrame | None = None) -> DataFrame:
    """(node_id, community): weighted modularity communities; ids are names of their least node. comps: the ``strong_components`` where they are known.

    Small components are one task's work each, larger ones that of all tasks together;
    all share the global weight.
    """
    edges = materialize(strong_edges(hits, min_bitscore), "strong")
    total = float(edges.agg(F.sum("weight")).first()[0])
    comps = strong_components(hits, min_bitscore) if comps is None else comps
    small, large = by_size(edges, comps, ONE_TASK_EDGES if one_task_edges is None else one_task_edges)

    def work(rows):
        if len(rows) == 1 and 1e-9 < rows[0][2] <= total:  # two nodes gain by one community, a loop is its own
            return [(x, rows[0][0]) for x in dict.fromkeys(rows[0][:2])]
        found = _louvain(rows, total, seed)
        least: dict[int, str] = {}
        for x in sorted(found):
            least.setdefault(found[x], x)
        return [(x, least[c]) for x, c in found.items()]

    out = by_component(small.select("component", "source", "target", "weight"), work, "node_id string, community string")
    if large.limit(1).count():
        e, nodes = with_numbers(large)
        found = materialize(nodes.join(modularity.large_communities(e, total, seed).withColumnRenamed("node", "number"), "number").select("node", "community"), "found")
        least = found.groupBy("community").agg(F.min("node").alias("least"))
        out = out.unionByName(found.join(least, "community").select(F.col("node").alias("node_id"), F.col("least").alias("community")))
    return out
