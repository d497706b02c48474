"""Filter interactions and packing against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.llm import filter_audit, packing
from kinweave.llm import queries as q

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = q.tokenizer_path("byte_bpe_50k.json")


def frame(spark, rows):
    """Documents of (doc_id, text, source) with clashing extra columns."""
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    return df.selectExpr("*", "1 as mask", "'x' as part", "2 as keys", "3 as key", "'w' as words", "4 as length", "5 as piece", "'y' as tie", "6 as index", "7 as whole")


# --- 11: filter interactions ------------------------------------------------------


def plain_audit(rows, good, toxic):
    """{(part, order, step): (kept, removed, redundant, unique, good lost, toxic lost, shapley)}."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    failed = []
    for i, t, s in rows:
        t, first = t or "", least.get(t or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            fails.add("C")
        if set(t) & set("#$%&*|"):
            fails.add("D")
        if first is not None and (i is None or i > first):
            fails.add("E")
        failed.append((s or "", fails, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in failed}:
        own = [x[1:] for x in failed if x[0] == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                removed_by[f] += len(gone)
                redundant = sum(f in x[0] for x in own) - len(gone)
                out[part, "".join(order), k + 1] = (len(left), len(gone), redundant, sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone))
        out |= {key: (*v, removed_by[key[1][key[2] - 1]]) for key, v in out.items() if key[0] == part}
    return out


def measured(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows}


def odd_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.choice((10, 49, 50, 51, 400)))) for _ in range(25)]
    long = " ".join(word() for _ in range(9000))
    texts += [long, long[:-1] + "z", long[:300] + "#" + long[301:], long[:5000] + "Q" + long[5001:], "A" * 60000, "a" * 60000, "a" * 59999 + "b", "", None, "  \t\n", "é😀 " * 60, "%" + texts[0]]
    rows = [(k, rng.choice(texts), rng.choice(["s0", "s0", "s1", None])) for k in range(300)] + [(k, "the copied line " * 30, "s0") for k in range(300, 450)]
    # the same id twice, with one text and with two; rows without an id, of new and of known texts
    return rows + [(5, "twice", "s1"), (5, "twice", "s1"), (6, "other", "s1"), (6, "twice", "s2"), (None, "twice", "s1"), (None, "alone", "s1"), (None, "alone", "s1"), (None, None, None), (-7, "B" + texts[0], "s1"), (-8, "B" + texts[0], "s1")]


@pytest.mark.parametrize("weak", [False, True])
def test_audit_against_a_plain_version(spark, monkeypatch, weak):
    """weak: all blocks hash alike, so that only whole texts tell rows of a length apart; few keys may be broadcast."""
    rows = odd_rows()
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, k % 2, int(k % 5 == 0), "x") for k in range(0, 460, 3)] + [(3, 0, 1, "y"), (9, None, None, "z"), (None, 1, 1, "n"), (10**9, 1, 1, "far")], "doc_id long, quality int, toxic int, part string")
    said = labels.collect()
    good, toxic = ({r["doc_id"] for r in said if r["doc_id"] is not None and r[c] == 1} for c in ("quality", "toxic"))
    if weak:
        monkeypatch.setattr(filter_audit, "BROADCAST_KEYS", 0)
        counts = filter_audit.mask_counts(docs, labels, block_hash=lambda c: F.length(c).cast("long") * 0)
        got = filter_audit.interactions(counts, "ABCDE")
    else:
        got = filter_audit.audit(docs, labels)
    assert measured(got) == plain_audit(rows, good, toxic)


def test_rounds_drop_singletons_and_no_heavy_class(spark):
    """Texts that part at the k-th block leave in that round; classes of most rows are joined by broadcast."""
    base = "".join(random.Random(1).choice("abc") for _ in range(30_000))
    texts = [base] * 2000 + [base[:k] + "Z" + base[k + 1 :] for k in (10, 300, 2000, 8000, 29_999)] + [f"unique {k}" * (k % 7) for k in range(700)]
    docs = frame(spark, [(k, t, "s") for k, t in enumerate(texts)])
    rows = filter_audit.screened(docs, filter_audit.CONDITIONS)
    sizes = Counter(len(r["keys"]) for r in rows.collect())
    assert max(sizes) == 1 + 5 and min(sizes) == 1
    shared = filter_audit.shared_classes(rows, len(texts))
    counts = Counter(texts)
    want = sorted(k for k, t in enumerate(texts) if counts[t] > 1)
    assert sorted(r["doc_id"] for r in shared.collect()) == want


def test_audit_of_no_rows_and_other_filters(spark):
    docs = frame(spark, [(1, "a b", "s"), (2, "a b", "s"), (3, "x", None)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    got = filter_audit.audit(docs, labels, {"X": lambda text, words: F.size(words) < 2})
    found = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in got.collect()}
    assert found == {("s", "XE", 1): (2, 0, 0), ("s", "XE", 2): (1, 1, 2), ("s", "EX", 1): (1, 1, 2), ("s", "EX", 2): (1, 0, 0), ("", "XE", 1): (0, 1, 2), ("", "XE", 2): (0, 0, 0), ("", "EX", 1): (1, 0, 0), ("", "EX", 2): (0, 1, 2)}
    with pytest.raises(ValueError, match="orders"):
        filter_audit.interactions(docs, "ABCDEFG")


# --- 12: packing -----------------------------------------------------------------------


def check_packing(out, texts, capacity=2048):
    """Every piece once, right ids, sequences without gaps. Returns the number of sequences."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = list(range(len(ids), 0, -capacity))[::-1]
        for k, b in enumerate(cuts):
            a = cuts[k - 1] if k else 0
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


EDGE = [(1, None), (2, ""), (3, "  \n \t"), (4, "!!"), (4, "!!"), (None, "no id"), (None, "no id"), (6, "a b <|endoftext|> c"), (7, "w " * 9000), (8, "a" * 30000), (9, " " * 5000 + "x"), (10, "😀 é " * 900), (-3, "日本語 и русский\x1c\x85 z"), (11, "it's  we'll\r\n12b4"), (12, " nbsp  em")]


def test_packing_of_the_driver_rows_and_edges(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    out = q.op12_best_fit_packing(spark, DATA).collect()
    n = check_packing(out, texts)
    lengths = Counter(r["length"] for r in out)
    assert n <= packing.lower_bound(lengths, 2048) * 1.06
    docs = frame(spark, [(i, t, "s") for i, t in EDGE])
    check_packing(packing.pack(docs, TOKENIZER).collect(), EDGE)
    small = packing.PackParams(capacity=64, groups=8, bucket_share=1)
    check_packing(packing.pack(docs, TOKENIZER, small).collect(), EDGE, 64)
    assert packing.pack(docs.where("false"), TOKENIZER).count() == 0


def test_written_sequences_hold_the_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    t, path = Tokenizer.from_file(TOKENIZER), str(tmp_path / "sequences")
    texts = [(k, "some words here " * (k % 300)) for k in range(400)]
    packing.write_sequences(frame(spark, [(i, x, "s") for i, x in texts]), TOKENIZER, path)
    found = []
    for r in spark.read.parquet(path).collect():
        assert len(r["ids"]) == sum(r["lengths"]) <= 2048
        at = 0
        for i, n in zip(r["doc_ids"], r["lengths"], strict=True):
            found.append((i, tuple(r["ids"][at : at + n])))
            at += n
    assert sorted(found) == sorted((i, (*t.encode(x, add_special_tokens=False).ids, 0)) for i, x in texts)


@pytest.mark.parametrize("kind", ["uniform", "thirds", "few", "tight", "long_tail", "ones"])
@pytest.mark.parametrize("n", [1, 90, 20_000])
def test_plans_place_every_piece(kind, n):
    rng = np.random.default_rng(12)
    draw = {
        "uniform": lambda: rng.integers(1, 2049, n), "thirds": lambda: np.clip(rng.normal(690, 30, n).astype(int), 1, 2048), "few": lambda: rng.choice([1000, 700, 360, 340, 10], n),
        "tight": lambda: rng.integers(500, 900, n), "long_tail": lambda: np.clip(rng.lognormal(6, 1, n).astype(int), 1, 2048), "ones": lambda: np.ones(n, int),
    }
    lengths = draw[kind]()
    counts = Counter(lengths.tolist())
    rows, sequences = packing.plan(counts)
    placed, fill = Counter(), np.zeros(sequences, int)
    for size, first, many, copies, sequence, offset in rows.tolist():
        assert first == placed[size]
        placed[size] += many
        k = np.arange(many)
        np.add.at(fill, sequence + k // copies, size)
    assert placed == counts and fill.max() <= 2048 and fill.min() > 0 and fill.sum() == lengths.sum()
    greedy = packing._Plan(counts, 2048)
    greedy.best_fit()
    assert sequences <= greedy.sequences * 1.006 + 1
    if n >= 2000 and kind in ("thirds", "few", "tight"):  # where configurations matter
        assert sequences < greedy.sequences * 0.98
    assert len(rows) < 12_000  # of lengths, not pieces


def test_encoders_agree_on_every_letter():
    e = packing._Encoder(TOKENIZER)
    assert e.second is not None
    chars = [chr(c) for c in (*range(0x20), *range(0x20, 0x300), 0x370, 0x430, 0x5D0, 0x660, 0x1E00, 0x2028, 0x3042, 0x1F600)]
    rng = random.Random(4)
    texts = [f"a{c}b {c} 1{c}2  {c}{c}\n{c} '{c}s" for c in chars] + ["".join(rng.choice(chars[0x20:0x280]) for _ in range(200)) for _ in range(300)] + ["".join(rng.choice("ab  \n\t'1.,sé") for _ in range(400)) for _ in range(300)]
    texts += ["x" * 5000, " " * 3000 + "y", "\n" * 2000, None, "", "<|endoftext|>", "a<|endoftext|>b"]
    got = e.encode_all(pa.array(texts))
    assert e.second is not None  # no slice differed
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == e.plain(t or "").tolist(), repr(t)


# --- many spans in one text ---------------------------------------------------------------


def test_many_spans_in_one_text_take_linear_time(spark):
    """100,000 of each, where a quadratic way takes minutes; values of any number of parts are whole."""
    import time

    from kinweave.llm import pii, secrets

    n = 100_000
    mixed = "a@b.co 123-45-6789 ssn "
    texts = [(1, "a@b.co, " * n), (2, mixed * (n // 2)), (3, "password: aaaabbbb " * n), (4, "token=" + "&".join(f"p{k}7Xx" for k in range(100))), (5, "token=" + "&".join(f"p{k}7Xx" for k in range(20_000)))]
    docs = frame(spark, [(i, t, "s") for i, t in texts])
    began = time.monotonic()
    found = {r["doc_id"]: r["pii"] for r in pii.find_pii(docs.where("doc_id < 3")).collect()}
    seen = {r["doc_id"]: (r["n_candidates"], r["secrets"]) for r in secrets.find_secrets(docs.where("doc_id > 2"), threshold=0.0).collect()}
    assert time.monotonic() - began < 60
    assert [(s["start"], s["end"]) for s in found[1]] == [(8 * k, 8 * k + 6) for k in range(n)]
    assert [(s["kind"], s["start"]) for s in found[2][:4]] == [("email", 0), ("email", 23), ("ssn", 30), ("email", 46)] and len(found[2]) == n - 1  # a word before tells the second from the first
    assert seen[3][0] == n and [s["start"] for s in seen[3][1]] == [10 + 19 * k for k in range(n)]
    assert [[s["text"] for s in seen[k][1]] for k in (4, 5)] == [[dict(texts)[k][6:]] for k in (4, 5)]


def test_added_spans_never_overlap_base_spans(spark):
    """Blocks of base spans against all of them, one by one."""
    from kinweave.llm.spans import apart

    rng = random.Random(9)
    span = lambda: (lambda a: (a, a + rng.randint(1, 9)))(rng.randrange(20_000))
    spans, others = [[span() for _ in range(k)] for k in (700, 2500)]
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame([(spans, others), (spans, []), ([], others)], f"a {kind}, b {kind}")
    got = [[tuple(s) for s in r["x"]] for r in df.select(apart(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [[(a, b) for a, b in spans if not any(a < d and c < b for c, d in others)], spans, []]
