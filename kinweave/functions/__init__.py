"""Scalar functions and scoring methods as Column expressions."""

from .._lazy import exports

_NAMES = {
    "ScoringMethod": "scorers",
    "scorer": "scorers",
    "protein_key": "scalars",
    "sanitize": "scalars",
    "split_accessions": "scalars",
    "safe_int": "scalars",
    "gc_percent": "scalars",
}
__getattr__, __all__ = exports(__name__, _NAMES)
