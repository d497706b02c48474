"""Readers, sinks, archive clients and the fetcher."""

from .._lazy import exports

_NAMES = {
    "read_inputfile": "files",
    "read_fasta": "files",
    "read_protein_folders": "files",
    "count_sequences": "files",
    "read_hits": "files",
    "read_distances": "files",
    "read_proteins": "files",
    "read_membership": "files",
    "read_taxids": "files",
    "read_scores": "files",
    "read_nodes": "files",
    "read_edges": "files",
    "read_genbank": "files",
    "read_organisms": "files",
    "read_workbook": "files",
    "write_fasta": "sinks",
    "write_genbank": "sinks",
    "write_workbook": "sinks",
    "write_tsv": "sinks",
    "write_csv": "sinks",
    "Fetcher": "fetch",
    "DatasetConfig": "fetch",
    "ArchiveClient": "remote",
    "RecordedClient": "remote",
    "retry": "remote",
}
__getattr__, __all__ = exports(__name__, _NAMES)
