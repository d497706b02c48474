"""Operators on tables of hits, networks, trees and scores."""

from .._lazy import exports

_NAMES = {
    "SearchParams": "similarity",
    "align": "similarity",
    "dedup_mutual_hits": "similarity",
    "drop_self_hits": "similarity",
    "jaccard_join": "similarity",
    "cosine_join": "similarity",
    "components": "graph",
    "clusters": "graph",
    "bipartite": "graph",
    "reduce_network": "graph",
    "genome_network": "graph",
    "cut_vertices": "graph",
    "communities": "graph",
    "DisjointSets": "sets",
    "leaf_distances": "tree",
    "species_tree": "tree",
    "write_species_tree": "tree",
    "lineage_tree": "tree",
    "read_newick": "tree",
    "ScoringParams": "ranking",
    "score_hits": "ranking",
    "mean_similarity": "ranking",
    "by_score": "ranking",
    "describe": "stats",
    "fit_distributions": "stats",
    "bootstrap_quantiles": "stats",
    "grouped_bootstrap": "stats",
    "high_confidence": "stats",
    "genome_hits": "lgt",
    "best_per_cluster": "lgt",
    "mark_significant": "lgt",
    "merge_scores": "lgt",
}
__getattr__, __all__ = exports(__name__, _NAMES)
