"""The archive client over a stub of the web service on this machine."""

from __future__ import annotations

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from kinweave.sources import http
from kinweave.sources.remote import RecordedClient

TAXA = {str(k): {"taxid": str(k), "name": f"Species {k}", "rank": "species", "lineage": f"cellular organisms; Group {k % 3}; Genus {k % 7}"} for k in range(1, 131)}
OF = {f"NC_{k:06d}.1": str(1 + k % 130) for k in range(450)}


@pytest.fixture
def service():
    seen: list[tuple[str, dict]] = []
    tries: Counter = Counter()

    class Stub(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_GET(self):
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            endpoint = url.path.rsplit("/", 1)[1]
            seen.append((endpoint, q))
            tries[self.path] += 1
            ids = q.get("id", "").split(",")
            if "NC_000007.1" in ids and q["db"] == "nucleotide" and "rettype" in q and tries[self.path] < 3:
                return self.reply(500, "busy")  # answers at the third attempt
            if "99" in ids and q["db"] == "taxonomy" or "gone" in ids:
                return self.reply(503, "never")
            if endpoint == "esearch.fcgi":
                return self.reply(200, json.dumps({"esearchresult": {"idlist": [] if q["term"] == "nothing" else [q["term"].upper(), "second"]}}))
            if endpoint == "esummary.fcgi" and q["db"] == "nucleotide":
                return self.reply(200, json.dumps({"result": {"uids": [f"u{i}" for i in ids]} | {f"u{i}": {"accessionversion": i, "taxid": int(OF[i])} for i in ids}}))
            if q["db"] == "taxonomy":
                tags = (("TaxId", "taxid"), ("ScientificName", "name"), ("Rank", "rank"), ("Lineage", "lineage"))
                return self.reply(200, "<TaxaSet>" + "".join("<Taxon>" + "".join(f"<{t}>{TAXA[i][k]}</{t}>" for t, k in tags) + "</Taxon>" for i in ids) + "</TaxaSet>")
            return self.reply(200, f"{q['db']} {q.get('rettype', q['retmode'])} {q['id']}\n")

        def reply(self, code, text):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(text.encode())

    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield http.Service(f"http://127.0.0.1:{server.server_port}/entrez", email="a@b.c", delay=0.0, backoff=0.05), seen
    server.shutdown()


def test_taxonomy_in_batches_equals_recorded_responses(spark, service):
    own, seen = service
    accessions = spark.createDataFrame([(a,) for a in OF] + [("NC_000000.1",), (None,)], "accession string")
    got = sorted(map(tuple, http.HttpClient(own).taxonomy(accessions).collect()))
    sizes = [len(q["id"].split(",")) for e, q in seen if q.get("db") == "nucleotide"]
    assert sorted(sizes) == [50, 200, 200] and all(q["email"] == "a@b.c" for _, q in seen)
    asked = [q["id"].split(",") for e, q in seen if q.get("db") == "taxonomy"]
    lost = next(ids for ids in asked if "99" in ids)
    assert sorted({len(ids) for ids in asked}) in ([30, 100], [100], [30]) or {len(ids) for ids in asked} == {100, 30}
    assert sum(ids == lost for ids in asked) == 3  # repeated, then skipped
    recorded = spark.createDataFrame([("taxonomy", a, json.dumps(TAXA[t])) for a, t in OF.items() if t not in lost], "kind string, key string, body string")
    assert got == sorted(map(tuple, RecordedClient(recorded).taxonomy(accessions.where("accession is not null")).collect()))
    assert got and len(got) < len(OF)


def test_sequences_searches_and_records(spark, service):
    own, seen = service
    client = http.HttpClient(own)
    accessions = spark.createDataFrame([("NC_000001.1",), ("NC_000007.1",), ("gone",)], "accession string")
    assert dict(map(tuple, client.fetch_sequences(accessions, "genbank").collect())) == {a: f"nucleotide gbwithparts {a}\n" for a in ("NC_000001.1", "NC_000007.1")}
    assert sum(q["id"] == "gone" for _, q in seen) >= 3
    terms = spark.createDataFrame([("abc",), ("nothing",)], "term string")
    assert [tuple(r) for r in client.search(terms).collect()] == [("abc", "ABC")]
    keys = spark.createDataFrame([("PRJ1",)], "key string")
    assert [r["body"] for r in client.fetch_records(keys, "bioproject").collect()] == ["bioproject xml PRJ1\n"]
    assert [r["body"] for r in client.fetch_records(keys, "assembly").collect()] == ["assembly json PRJ1\n"]
    assert client.taxonomy(accessions.where("false")).count() == 0
