"""Records of a sequence archive: the interface, and a reader of recorded responses.

There is no network here, so the one implementation reads what was recorded: a
table (kind, key, body). A live client only has to implement ``ArchiveClient``.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lineage_list


def retry(attempts: int = 3, base: float = 2.0, errors: tuple[type[Exception], ...] = (OSError,), sleep: Callable[[float], None] = time.sleep):
    """Repeats a call on the errors, waiting base ** attempt seconds; the last error is raised."""

    def wrap(f):
        @wraps(f)
        def call(*args, **kwargs):
            for k in range(attempts):
                try:
                    return f(*args, **kwargs)
                except errors:
                    if k == attempts - 1:
                        raise
                    sleep(base ** (k + 1))

        return call

    return wrap


class ArchiveClient(ABC):
    @abstractmethod
    def fetch_sequences(self, accessions: DataFrame, kind: str) -> DataFrame:
        """(accession, body) of FASTA or GenBank text."""

    @abstractmethod
    def search(self, terms: DataFrame) -> DataFrame:
        """(term, accession) of first hits."""

    @abstractmethod
    def fetch_records(self, keys: DataFrame, kind: str) -> DataFrame:
        """(key, body) of project, sample or assembly records."""

    @abstractmethod
    def taxonomy(self, accessions: DataFrame) -> DataFrame:
        """(accession, taxid, name, rank, lineage, lineage_list)."""


class RecordedClient(ArchiveClient):
    """Answers from a table (kind, key, body); what is not recorded has no row."""

    def __init__(self, recorded: DataFrame) -> None:
        self.recorded = recorded

    def _of(self, kind: str, keys: DataFrame, key: str) -> DataFrame:
        own = self.recorded.where(F.col("kind") == kind).select(F.col("key").alias(key), "body")
        return keys.select(key).distinct().join(own, key)

    def fetch_sequences(self, accessions: DataFrame, kind: str) -> DataFrame:
        return self._of(kind, accessions, "accession")

    def search(self, terms: DataFrame) -> DataFrame:
        return self._of("search", terms, "term").withColumnRenamed("body", "accession")

    def fetch_records(self, keys: DataFrame, kind: str) -> DataFrame:
        return self._of(kind, keys, "key")

    def taxonomy(self, accessions: DataFrame) -> DataFrame:
        d = self._of("taxonomy", accessions, "accession").withColumn("r", F.from_json("body", "taxid string, name string, rank string, lineage string"))
        return d.select("accession", "r.*").withColumn("lineage_list", lineage_list(F.col("lineage")))
