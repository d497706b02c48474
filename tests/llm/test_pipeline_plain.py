"""Each stage of the pipeline against a plain version of its result, on what the stage before kept."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
from test_llm_operators import plain_classes
from test_sql_and_clashes import plain_mix
from tokenizers import Tokenizer

import corpus_pipeline

from kinweave.llm import langid
from kinweave.llm import queries as q
from kinweave.llm.shared import materialize, table

DATA = "/root/testdata/sf0.001"


def plain_share(item, text):
    """The longest common subsequence of words over the item's length."""
    best = [0] * (len(item) + 1)
    for w in text:
        last = 0
        for k, x in enumerate(item):
            here = best[k + 1]
            best[k + 1] = last + 1 if x == w else max(here, best[k])
            last = here
    return best[-1] / len(item)


def plain_scores(model, text):
    """Language scores n-gram by n-gram."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    letters = re.sub(" +", " ", letters)
    letters = letters[1:] if letters.startswith(" ") else letters
    if not letters.strip():
        return None
    total, n = np.zeros(len(model.langs)), 0
    for order in langid.ORDERS:
        for k in range(len(letters) - order + 1):
            h = order * 0x9E3779B1 & 0xFFFFFFFF
            for c in letters[k : k + order]:
                h = (h ^ ord(c)) * 0x85EBCA6B & 0xFFFFFFFF
                h ^= h >> 15
            total += model.table[(h * 0xC2B2AE35 & 0xFFFFFFFF) >> 32 - langid.BITS]
            n += 1
    s = (total / max(n, 1) * model.scale + model.bias) / model.temperature
    e = np.exp(s - s.max())
    return e / e.sum()


def test_pipeline_against_plain_versions(spark):
    docs = table(spark, DATA, "documents")
    bench = {r["item_id"]: r["text"] for r in table(spark, DATA, "benchmark").collect()}
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    tokenizer = Tokenizer.from_file(q.tokenizer_path())
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text", "source", "lang").collect()]
        after = materialize(stage(spark, docs, DATA), f"plain-{name}")
        got = collections.Counter(r["doc_id"] for r in after.select("doc_id").collect())
        if name == "language_id":
            known = docs.where(~langid.held_out(docs["doc_id"])).where("lang is not null").select("doc_id", "text", "lang")
            model = langid.train(known)
            want = collections.Counter()
            for i, t, _, _ in before:
                s = plain_scores(model, t)
                assert s is None or abs(s.max() - 0.5) > 1e-6
                want[i] += s is not None and s.max() >= 0.5
            assert got == +want
        elif name == "ngram_jaccard_join":
            classes = plain_classes([(i, t) for i, t, _, _ in before])
            assert got == collections.Counter({c for c, _, _ in classes.values()})
        elif name == "decontamination":
            gone = {i for i, *_ in before} - set(got)
            shares = {i: max((plain_share(words(x), words(t)) for x in bench.values() if x), default=0) for i, t, _, _ in before if i in gone}
            assert all(s >= 0.55 for s in shares.values())  # what goes holds an item's words in order
            copies = {i for i, t, _, _ in before for x in bench.values() if f" {' '.join(words(x))} " in f" {' '.join(words(t))} "}
            assert copies <= gone and len(gone) <= len(copies) + 0.05 * len(before)
        elif name == "mixing":
            sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in before}
            taken = plain_mix([(i, t, s) for i, t, s, _ in before])
            assert got == +collections.Counter({i: n // sizes[i] if sizes[i] else 0 for (i, _), n in taken.items()})
        else:
            want, start = [], 0
            for i, t, _, _ in sorted(before, key=lambda r: r[0]):
                ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
                want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
            assert sorted(map(tuple, after.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want
        docs = after
