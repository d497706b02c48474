"""kinweave: similarity-network analytics expressed as Spark DataFrame plans."""

from ._lazy import exports

__version__ = "0.1.0"

_NAMES = {
    "Analysis": "plans.pipeline",
    "run_transfers": "plans.pipeline",
    "transfers": "plans.pipeline",
    "session": "runtime",
    "ship": "runtime",
    "ScoringMethod": "functions.scorers",
    "ScoringParams": "operators.ranking",
    "SearchParams": "operators.similarity",
    "align": "operators.similarity",
    "clusters": "operators.graph",
    "DisjointSets": "operators.sets",
    "Fetcher": "sources.fetch",
    "DatasetConfig": "sources.fetch",
    "ArchiveClient": "sources.remote",
    "RecordedClient": "sources.remote",
    "HttpClient": "sources.http",
}
__getattr__, __all__ = exports(__name__, _NAMES)
