"""Trees: Newick text, depths, distances between leaves, trees from lineages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import drop_scratch, materialize
from ..schemas import TREE_NODES
from .biconnected import rooted
from .ordering import numbered


#: Nodes carry their paths from the root if none is longer; in a deeper tree paths would take the square of its nodes, and are null.
LONGEST_PATH = 500


def parse_newick(text: str) -> list[tuple[int, int | None, str | None, float | None, int, list[int] | None]]:
    """Rows (node_id, parent_id, name, length, depth, path) of the first tree; path starts at the root."""
    nodes: list[list] = [[0, None, None, None]]
    at, place = 0, 0
    body = re.sub(r"\[[^\]]*\]", "", text.strip()).split(";")[0]
    token = re.compile(r"\s*(?:'((?:[^']|'')*)'|([(),:])|([^\s(),:;']+))")
    wants_length = False
    while place < len(body) and (m := token.match(body, place)):
        quoted, mark, word = m.groups()
        place = m.end()
        if mark == "(":
            nodes.append([len(nodes), at, None, None])
            at = len(nodes) - 1
        elif mark == ",":
            nodes.append([len(nodes), nodes[at][1], None, None])
            at = len(nodes) - 1
        elif mark == ")":
            if nodes[at][1] is None:
                raise ValueError("unbalanced parentheses")
            at = nodes[at][1]
        elif mark == ":":
            wants_length = True
            continue
        elif wants_length:
            nodes[at][3] = float(word)
        else:
            nodes[at][2] = quoted.replace("''", "'") if quoted is not None else word
        wants_length = False
    if at != 0:
        raise ValueError("unbalanced parentheses")
    depths: list[int] = []
    for _, parent, *_ in nodes:
        depths.append(0 if parent is None else depths[parent] + 1)
    if max(depths) > LONGEST_PATH:
        return [(i, parent, name, length, depths[i], None) for i, parent, name, length in nodes]
    paths: list[list[int]] = []
    for i, parent, *_ in nodes:
        paths.append([*(paths[parent] if parent is not None else []), i])
    return [(i, parent, name, length, depths[i], paths[i]) for i, parent, name, length in nodes]


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """The tree's nodes. A tree is one text of dimension size, parsed where it is read."""
    texts = spark.read.text(path, wholetext=True)

    def run(batches):
        import pandas as pd

        for frame in batches:
            for text in frame["value"]:
                yield pd.DataFrame(parse_newick(text), columns=["node_id", "parent_id", "name", "length", "depth", "path"]).astype({"parent_id": "Int64"})

    return texts.mapInPandas(run, TREE_NODES)


def rename_leaves(text, names: dict[str, str]) -> str:
    """Newick text with names replaced, longest first; a match may not touch a letter, digit, underscore or, before it, a point."""
    for old in sorted(names, key=len, reverse=True):
        text = re.sub(rf"(?<![A-Za-z0-9_.]){re.escape(old)}(?![A-Za-z0-9_])", lambda _, new=names[old]: new, text)
    return text


def rename_nodes(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """names: (old, new); others keep theirs."""
    joined = nodes.join(names.withColumnRenamed("old", "name"), "name", "left")
    return joined.withColumn("name", F.coalesce("new", "name")).select(*nodes.columns)


def leaves(nodes: DataFrame) -> DataFrame:
    """Named nodes without children."""
    parents = nodes.select(F.col("parent_id").alias("node_id")).where("node_id is not null").distinct()
    return nodes.join(parents, "node_id", "left_anti").where("name is not null and name <> ''")


def common_prefix(a, b):
    """How many leading elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i >= n) | (F.get(a, i) != F.get(b, i)))
    return F.get(differ, F.lit(0))


def internal_nodes_between(path_a, path_b):
    """Inner nodes on the way between two leaves, their meeting point included."""
    meet = common_prefix(path_a, path_b)
    return F.greatest(F.size(path_a) + F.size(path_b) - 2 * meet - 1, F.lit(0))


def depths(nodes: DataFrame) -> DataFrame:
    """(node_id, depth) from parents alone, by pointer jumping: each round doubles how far up a node sees; nodes: (node_id, parent_id)."""
    d = materialize(nodes.select("node_id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth")), "depths")
    while d.where("up is not null").limit(1).count():
        far = d.select(F.col("node_id").alias("up"), F.col("up").alias("then"), F.col("depth").alias("more"))
        before, d = d, materialize(d.join(far, "up", "left").select("node_id", F.col("then").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depths")
        drop_scratch(before)
    return d.select("node_id", "depth")


def _deep(nodes: DataFrame) -> bool:
    return bool(nodes.where("path is null").limit(1).count())


def ancestors(nodes: DataFrame) -> list[DataFrame]:
    """Tables (node_id, up) of the 1st, 2nd, 4th, 8th, ... ancestors, materialized; the last one has a row at least."""
    up = materialize(nodes.where("parent_id is not null").select("node_id", F.col("parent_id").alias("up")), "up")
    out = []
    while up.limit(1).count():
        out.append(up)
        up = materialize(up.join(up.select(F.col("node_id").alias("up"), F.col("up").alias("far")), "up").select("node_id", F.col("far").alias("up")), "up")
    return out


def meeting_depths(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: (ia, ib, ...) of node ids, with da, db, the depths of both, and meet, that of the node where their ways to the root meet.

    The deeper node goes up to the other's depth, then both go up while their ancestors
    differ, by powers of two, the greatest first: a join for each.
    """
    at = depths(nodes)
    d = pairs.join(at.toDF("ia", "da"), "ia").join(at.toDF("ib", "db"), "ib").withColumns({"_a": F.col("ia"), "_b": F.col("ib")})
    tables = ancestors(nodes)
    jump = lambda d, side, up: d.join(up.toDF(f"_{side}", f"_u{side}"), f"_{side}", "left")
    for side, own, other in (("a", "da", "db"), ("b", "db", "da")):
        for k, up in enumerate(tables):
            bit = F.greatest(F.col(own) - F.col(other), F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0
            d = jump(d, side, up).withColumn(f"_{side}", F.when(bit, F.col(f"_u{side}")).otherwise(F.col(f"_{side}"))).drop(f"_u{side}")
    d = materialize(d.withColumn("_n", F.lit(0)), "meet")
    for k in reversed(range(len(tables))):
        both = jump(jump(d, "a", tables[k]), "b", tables[k])
        apart = F.coalesce(F.col("_ua") != F.col("_ub"), F.lit(False))
        d = both.select(*pairs.columns, "da", "db", F.when(apart, F.col("_ua")).otherwise(F.col("_a")).alias("_a"), F.when(apart, F.col("_ub")).otherwise(F.col("_b")).alias("_b"), (F.col("_n") + F.when(apart, 1 << k).otherwise(0)).alias("_n"))
    level = F.least("da", "db") - F.col("_n")
    return d.select(*pairs.columns, "da", "db", F.when(F.col("_a") == F.col("_b"), level).otherwise(level - 1).alias("meet"))


def leaves_below(nodes: DataFrame) -> DataFrame:
    """(v, n): how many leaves are in the subtree of each node, by doubling: after k rounds those fewer than 2 ** k levels below it."""
    own = leaves(nodes).select("node_id", F.lit(1.0).alias("n"))
    d = materialize(nodes.select("node_id", F.col("parent_id").alias("up")).join(own, "node_id", "left").select("node_id", "up", F.coalesce("n", F.lit(0.0)).alias("n")), "below")
    while d.where("up is not null").limit(1).count():
        more = d.where("up is not null").groupBy(F.col("up").alias("node_id")).agg(F.sum("n").alias("m"))
        far = d.select(F.col("node_id").alias("up"), F.col("up").alias("then"))
        before, d = d, materialize(d.join(more, "node_id", "left").join(far, "up", "left").select("node_id", F.col("then").alias("up"), (F.col("n") + F.coalesce("m", F.lit(0.0))).alias("n")), "below")
        drop_scratch(before)
    return d.select(F.col("node_id").alias("v"), "n")


def leaf_distances(nodes: DataFrame) -> DataFrame:
    """(genome_a, genome_b, N_int) for each pair of leaves."""
    if _deep(nodes):
        own = leaves(nodes).select("name", "node_id")
        d = own.toDF("genome_a", "ia").join(own.toDF("genome_b", "ib"), F.col("ia") < F.col("ib"))
        return _between(meeting_depths(nodes, d))
    a = leaves(nodes).select(F.col("name").alias("genome_a"), F.col("node_id").alias("ia"), F.col("path").alias("pa"))
    b = leaves(nodes).select(F.col("name").alias("genome_b"), F.col("node_id").alias("ib"), F.col("path").alias("pb"))
    d = a.join(b, F.col("ia") < F.col("ib"))
    return d.select("genome_a", "genome_b", internal_nodes_between(F.col("pa"), F.col("pb")).alias("N_int"))


def pair_distances(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(genome_a, genome_b, N_int) of stated pairs only; pairs: (genome_a, genome_b). Pairs with a name that is no leaf go."""
    at = leaves(nodes)
    d = pairs.select("genome_a", "genome_b").distinct()
    if _deep(nodes):
        for side in "ab":
            d = d.join(at.select(F.col("name").alias(f"genome_{side}"), F.col("node_id").alias(f"i{side}")), f"genome_{side}")
        return _between(meeting_depths(nodes, d.where("genome_a <> genome_b")))
    for side in "ab":
        d = d.join(at.select(F.col("name").alias(f"genome_{side}"), F.col("path").alias(f"p{side}")), f"genome_{side}")
    return d.where("genome_a <> genome_b").select("genome_a", "genome_b", internal_nodes_between(F.col("pa"), F.col("pb")).alias("N_int"))


def _between(d: DataFrame) -> DataFrame:
    return d.select("genome_a", "genome_b", F.greatest(F.col("da") + F.col("db") - 2 * F.col("meet") - 1, F.lit(0)).cast("int").alias("N_int"))


def mean_distance(nodes: DataFrame) -> DataFrame:
    """One row: n_int_mean over all pairs of leaves (0 without pairs) and leaf_count, without the pairs.

    Two leaves of depths a and b that meet at depth m have a + b - 2 m - 1 nodes between
    them, and the meeting depths of all pairs add up to the pairs below each node but the
    root. So it takes the leaves below each node only.
    """
    own = leaves(nodes)
    if _deep(nodes):
        below = leaves_below(nodes).join(nodes.where("parent_id is not null").select(F.col("node_id").alias("v")), "v", "left_semi")
    else:
        below = own.select(F.explode(F.slice("path", F.lit(2), F.size("path"))).alias("v")).groupBy("v").agg(F.count("*").cast("double").alias("n"))
    meets = below.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("meet"))
    ends = own.agg(F.count("*").alias("leaf_count"), F.coalesce(F.sum(F.col("depth").cast("double")), F.lit(0.0)).alias("depths"))
    n = F.col("leaf_count").cast("double")
    pairs = n * (n - 1) / 2
    mean = F.when(pairs > 0, ((n - 1) * F.col("depths") - 2 * F.col("meet") - pairs) / pairs).otherwise(F.lit(0.0))
    return ends.crossJoin(meets).select(mean.alias("n_int_mean"), "leaf_count")  # two single rows


def distance_summary(distances: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: n_int_mean (0 without pairs), leaf_count."""
    mean = distances.agg(F.coalesce(F.avg("N_int"), F.lit(0.0)).alias("n_int_mean"))
    return mean.crossJoin(leaves(nodes).agg(F.count("*").alias("leaf_count")))  # two single rows


def lineage_tree(taxa: DataFrame, root: str = "Root") -> DataFrame:
    """(path_text, parent_text, name, depth, is_leaf) of the tree that lineages span; taxa: (leaf, lineage array<string>)."""
    full = F.concat(F.array(F.lit(root)), "lineage", F.array("leaf"))
    d = taxa.select(full.alias("p"), F.posexplode(full).alias("depth", "name"))
    text = F.array_join(F.slice("p", F.lit(1), F.col("depth") + 1), "|")
    parent = F.when(F.col("depth") > 0, F.array_join(F.slice("p", F.lit(1), F.col("depth")), "|"))
    d = d.select(text.alias("path_text"), parent.alias("parent_text"), "name", "depth", (F.col("depth") + 1 == F.size("p")).alias("is_leaf"))
    return d.groupBy("path_text", "parent_text", "name", "depth").agg(F.max("is_leaf").alias("is_leaf"))


def _label(name: str) -> str:
    return "'" + name.replace("'", "''") + "'" if re.search(r"[\s(),:;'\[\]]", name) else name


def to_newick(nodes: list[tuple[str, str | None, str]]) -> str:
    """Newick text of a few (key, parent key, name) rows with branch length 1, siblings by key; ``newick_text`` is for tables."""
    below: dict[str | None, list[tuple[str, str]]] = {}
    for key, parent, name in nodes:
        below.setdefault(parent, []).append((key, name))
    out, todo = [], [(*below[None][0], False)]
    while todo:
        key, name, done = todo.pop()
        kids = sorted(below.get(key, []))
        if kids and not done:
            out.append("(")
            todo.append((key, name, True))
            todo.extend((*k, False) for k in reversed(kids))
            continue
        out.append((")" if kids else "") + _label(name) + (":1," if todo else ""))
    return "".join(out).replace(",)", ")") + ";"


def newick_text(nodes: DataFrame) -> DataFrame:
    """One row (value): the Newick text of a tree of any depth, siblings by key; nodes: (key, parent_key, name[, length]).

    Nodes are numbered by depth and key, the tour around the tree gives each the places where its text
    begins and ends, and all texts are joined in this order: a tree is one line.
    """
    keyed = materialize(nodes.select("key", "parent_key", "name", (F.col("length") if "length" in nodes.columns else F.lit(1)).cast("double").alias("length")), "keyed")
    at = depths(keyed.select(F.col("key").alias("node_id"), F.col("parent_key").alias("parent_id")))
    n = materialize(numbered(keyed.join(at.toDF("key", "depth"), "key").select(F.struct("depth", "key").alias("s"), "name", "length", "parent_key"), "s", "i").select("s.key", "i", "name", "length", "parent_key"), "numbers")
    edges = materialize(n.join(n.select(F.col("key").alias("parent_key"), F.col("i").alias("u")), "parent_key").select("u", F.col("i").alias("v")), "edges")
    size = F.when(F.col("length") == F.floor("length"), F.col("length").cast("bigint").cast("string")).otherwise(F.col("length").cast("string"))
    label = F.when(F.col("name").rlike(r"[\s(),:;'\[\]]"), F.concat(F.lit("'"), F.replace("name", F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(F.coalesce("name", F.lit("")))
    d = n.select(F.col("i").alias("node"), label.alias("label"), F.coalesce(F.concat(F.lit(":"), size), F.lit("")).alias("length"))
    tour = rooted(edges)
    far = 1 << 62
    d = d.join(tour, "node", "left").select("node", "label", "length", "parent", F.coalesce("first", F.lit(-far)).alias("first"), F.coalesce("last", F.lit(far)).alias("last"))
    inner = tour.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.min("first").alias("eldest"))
    eldest = inner.select(F.col("eldest").alias("first"), F.lit("").alias("gap"))
    d = d.join(inner, "node", "left").join(eldest, "first", "left")
    gap, end = F.when(F.col("parent").isNull(), "").otherwise(F.coalesce("gap", F.lit(","))), F.when(F.col("parent").isNull(), ";").otherwise(F.col("length"))
    enter = F.struct(F.col("first").alias("at"), F.when(F.col("eldest").isNotNull(), F.concat(gap, F.lit("("))).otherwise(F.concat(gap, "label", end)).alias("text"))
    leave = F.struct(F.col("last").alias("at"), F.when(F.col("eldest").isNotNull(), F.concat(F.lit(")"), "label", end)).otherwise("").alias("text"))
    parts = d.select(F.explode(F.array(enter, leave)).alias("p")).where("p.text <> ''")
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["text"]), "").alias("value"))


def species_tree(taxonomy: DataFrame) -> dict[str, DataFrame]:
    """nodes (of the lineage tree, leaves are accessions), organisms (genome_accession, organism_name, taxid) and counts (leaves, nodes).

    taxonomy: (accession, taxid, name, lineage_list), as an archive client gives it.
    """
    known = taxonomy.where("accession is not null and taxid is not null")
    nodes = lineage_tree(known.select(F.col("accession").alias("leaf"), F.concat("lineage_list", F.array("name")).alias("lineage")))
    organisms = known.select(F.col("accession").alias("genome_accession"), F.col("name").alias("organism_name"), "taxid").distinct()
    return {"nodes": nodes, "organisms": organisms, "counts": nodes.agg(F.count_if("is_leaf").alias("leaves"), F.count("*").alias("nodes"))}


def write_species_tree(taxonomy: DataFrame, folder: str, prefix: str = "reduced") -> dict[str, DataFrame]:
    """The species tree as Newick text and the organisms of its genomes as CSV, in the folder."""
    out = species_tree(taxonomy)
    text = newick_text(out["nodes"].select(F.col("path_text").alias("key"), F.col("parent_text").alias("parent_key"), "name"))
    text.select(F.when(F.col("value") == "", ";").otherwise(F.col("value")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/{prefix}_species_tree")
    out["organisms"].orderBy("genome_accession").write.mode("overwrite").csv(f"{folder}/genome_to_organism_name", header=True)
    return out


def assign_taxids(genomes: DataFrame) -> DataFrame:
    """(genome_accession, organism_name, taxid): 1..n as text, by the file's line; genomes: (line, genome_accession, organism_name)."""
    return numbered(genomes, "line", "_n").select("genome_accession", "organism_name", F.col("_n").cast("string").alias("taxid"))
