"""A client of a sequence archive's web service, in batches of keys.

Keys are spread over a few tasks, which set the number of connections; a task sends its keys batch by
batch, waits after each request, repeats failed ones, and skips a batch that fails for
good. The service's public query interface is spoken: ``efetch``, ``esummary`` and
``esearch`` below a base address. Responses become rows in the tasks, nothing passes the driver.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lineage_list
from .remote import ArchiveClient, retry

#: Keys of one request for the taxa of accessions, and for the records of taxa.
ACCESSION_BATCH, TAXON_BATCH = 200, 100
#: The database and form of each kind of record.
RECORDS = {"bioproject": ("bioproject", "xml"), "biosample": ("biosample", "xml"), "assembly": ("assembly", "json")}
FORMS = {"fasta": "fasta", "genbank": "gbwithparts"}


@dataclass(frozen=True)
class Service:
    base: str
    email: str | None = None
    api_key: str | None = None
    #: seconds after each request, in each task
    delay: float = 0.4
    attempts: int = 3
    #: seconds before the k-th repetition: backoff ** k
    backoff: float = 2.0
    timeout: float = 60.0
    #: tasks that send requests at the same time
    connections: int = 1

    def get(self, endpoint: str, **query: str) -> str:
        """The body of one response, after repetitions; OSError if all fail."""
        known = {"email": self.email, "api_key": self.api_key} | query
        address = f"{self.base.rstrip('/')}/{endpoint}.fcgi?{urllib.parse.urlencode({k: v for k, v in known.items() if v})}"

        @retry(self.attempts, self.backoff)
        def send() -> str:
            with urllib.request.urlopen(address, timeout=self.timeout) as r:
                return r.read().decode("utf-8", "replace")

        try:
            return send()
        finally:
            time.sleep(self.delay)


def in_batches(keys: DataFrame, service: Service, size: int, schema: str, ask: Callable[[Service, list[str]], Iterator[tuple]]) -> DataFrame:
    """Rows of ``ask(service, batch of keys)``; keys: one column of distinct strings. A batch whose requests or responses fail gives no rows."""

    def run(frames):
        import pandas as pd

        names = [part.split()[0] for part in schema.split(", ")]
        waiting: list[str] = []

        def send(batch: list[str]):
            try:
                rows = list(ask(service, batch))
            except (OSError, ValueError, KeyError, ElementTree.ParseError):
                rows = []
            return pd.DataFrame(rows, columns=names)

        for frame in frames:
            waiting.extend(frame.iloc[:, 0].tolist())
            while len(waiting) >= size:
                yield send(waiting[:size])
                waiting = waiting[size:]
        if waiting:
            yield send(waiting)

    one = keys.columns[0]
    return keys.where(F.col(one).isNotNull()).select(F.col(one).cast("string").alias(one)).distinct().repartition(service.connections).sortWithinPartitions(one).mapInPandas(run, schema)


def _sequences(kind: str):
    def ask(service: Service, batch: list[str]) -> Iterator[tuple]:
        for key in batch:
            yield key, service.get("efetch", db="nucleotide", id=key, rettype=FORMS[kind], retmode="text")

    return ask


def _first_hits(service: Service, batch: list[str]) -> Iterator[tuple]:
    for term in batch:
        found = json.loads(service.get("esearch", db="nucleotide", term=term, retmax="1", retmode="json"))["esearchresult"]["idlist"]
        if found:
            yield term, found[0]


def _records(kind: str):
    db, form = RECORDS[kind]

    def ask(service: Service, batch: list[str]) -> Iterator[tuple]:
        for key in batch:
            yield key, service.get("esummary" if form == "json" else "efetch", db=db, id=key, retmode=form)

    return ask


def _taxa_of_accessions(service: Service, batch: list[str]) -> Iterator[tuple]:
    result = json.loads(service.get("esummary", db="nucleotide", id=",".join(batch), retmode="json"))["result"]
    for uid in result.get("uids", []):
        own = result[uid]
        if own.get("taxid"):
            yield own.get("accessionversion") or own["caption"], str(own["taxid"])


def _taxa(service: Service, batch: list[str]) -> Iterator[tuple]:
    tree = ElementTree.fromstring(service.get("efetch", db="taxonomy", id=",".join(batch), retmode="xml"))
    for taxon in tree.findall("Taxon"):
        yield tuple(taxon.findtext(tag) for tag in ("TaxId", "ScientificName", "Rank", "Lineage"))


class HttpClient(ArchiveClient):
    """Answers over the network. What a failed request asked for has no row, as in a client of recorded responses."""

    def __init__(self, service: Service) -> None:
        self.service = service

    def fetch_sequences(self, accessions: DataFrame, kind: str) -> DataFrame:
        return in_batches(accessions.select("accession"), self.service, 1, "accession string, body string", _sequences(kind))

    def search(self, terms: DataFrame) -> DataFrame:
        return in_batches(terms.select("term"), self.service, 1, "term string, accession string", _first_hits)

    def fetch_records(self, keys: DataFrame, kind: str) -> DataFrame:
        return in_batches(keys.select("key"), self.service, 1, "key string, body string", _records(kind))

    def taxids(self, accessions: DataFrame) -> DataFrame:
        """(accession, taxid), ``ACCESSION_BATCH`` accessions a request."""
        return in_batches(accessions.select("accession"), self.service, ACCESSION_BATCH, "accession string, taxid string", _taxa_of_accessions)

    def taxonomy(self, accessions: DataFrame) -> DataFrame:
        """One row for each accession whose taxon is known, ``TAXON_BATCH`` taxa a request."""
        from ..runtime import materialize

        own = materialize(self.taxids(accessions), "taxids")  # requests are sent once
        known = materialize(in_batches(own.select("taxid"), self.service, TAXON_BATCH, "taxid string, name string, rank string, lineage string", _taxa), "taxa")
        return own.join(known, "taxid").select("accession", "taxid", "name", "rank", "lineage").withColumn("lineage_list", lineage_list(F.col("lineage")))
