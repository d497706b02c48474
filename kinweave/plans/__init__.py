"""The dataset analysis, its stages, and the queries."""

from .._lazy import exports

_NAMES = {
    "Analysis": "pipeline",
    "restore_names": "pipeline",
    "transfers": "pipeline",
    "run_transfers": "pipeline",
    "STAGES": "stages",
}
__getattr__, __all__ = exports(__name__, _NAMES)
