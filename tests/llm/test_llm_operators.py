"""The training-data operators against plain versions, on small made tables and the smallest driver tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from kinweave.llm import decontam, fingerprints, langid, mixing, ngram_join, pii, quality, secrets, shared, tokens, urls
from kinweave.llm import queries as q

DATA, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, extra=True):
    """Documents with clashing extra columns; texts: (doc_id, text)."""
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 as _text", "'x' as rid", "2 as comp", "0.5 as score", "3 as bin", "'y' as start", "4 as _range") if extra else df


def save(df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


EDGE = [(1, None), (2, ""), (3, "  \n"), (4, "!!"), (5, "!!"), (None, "no id at all here"), (6, "one two three"), (7, "One, two THREE"), (8, "w " * 30000), (9, "a" * 60000), (6, "one two three"), (10, "😀 é " * 40)]


# --- 1: personal data ---------------------------------------------------------


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


def plain_pii(text):
    text, out = text or "", []
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for k, (kind, p) in enumerate(kinds):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def test_pii_base_spans(spark, tmp_path):
    rng = random.Random(1)
    bits = ["a@b.c", "@", ".", "x@y-z.co.uk", "1.2.3.4", "300.1.1.1", "4111 1111-1111 1111", "4111111111111111", "0" * 15, "+1 (555) 555-1234", "+", " ", "-", "99", "é", "😀", "\n", "_", "%", "12345678901234567890"]
    texts = EDGE + [(100 + k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for k in range(200)] + [(400, "9" * 50000), (401, "1.1.1.1 " * 2000), (402, "a@b.c" * 1500), (403, "GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, call 555-123-4567 not 555-123-9999x")]
    out = q.op1_pii(spark, save(frame(spark, texts), tmp_path)).collect()
    assert len(out) == len(texts)
    by = collections.defaultdict(list)
    for i, t in texts:
        by[i].append(t)
    for r in out:
        want = plain_pii(by[r["doc_id"]][0])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) or not want
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(w.startswith(k) for w in want) for k in ("email", "ip", "card", "phone")]
    last = next(r for r in out if r["doc_id"] == 403)
    assert "iban:0:27" in last["spans"] and "ssn:" in last["spans"] and last["spans"].count("local_phone") == 1


# --- 2: quality ----------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    out = q.op2_quality(spark, MID).toPandas()
    labels = spark.read.parquet(f"{MID}/labels.parquet").toPandas()
    assert ((out["score"] >= 0) & (out["score"] <= 1)).all() and (out["predicted"] == (out["score"] >= 0.5)).all()
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(out.doc_id, out.held_out, strict=True))
    m = out.merge(labels)
    m = m[m.held_out]
    assert (m.predicted == m.quality).mean() > 0.95


def test_quality_edges(spark):
    docs, labels = frame(spark, EDGE), spark.createDataFrame([(6, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(EDGE) and all(r["score"] == 1.0 for r in out)
    assert quality.classify(docs, labels.where("false")).first()["score"] == 0.5
    assert quality.classify(docs.where("false"), labels).count() == 0


def test_discriminant_matches_densities():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, quality._DIM))
    a = rng.normal(size=(quality._DIM, quality._DIM))
    cov = a @ a.T + np.eye(quality._DIM)
    low = np.linalg.inv(np.linalg.cholesky(cov))
    model = quality.Discriminant(0.3, [np.zeros(quality._DIM), np.ones(quality._DIM)], [np.eye(quality._DIM), low], [0.0, float(np.linalg.slogdet(cov)[1])])
    d = 0.3 + 0.5 * (x**2).sum(1) - 0.5 * np.array([v @ np.linalg.solve(cov, v) for v in x - 1]) - 0.5 * np.linalg.slogdet(cov)[1]
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-d / quality._DIM)))


# --- 3: fingerprints --------------------------------------------------------------


def terms(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def likeness(a, b):
    a, b = terms(a), terms(b)
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def check_edits(out, texts):
    order = sorted(((i, t or "") for i, t in texts), key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    after = {order[k][0]: (order[k][1], order[(k + 1) % len(order)][1]) for k in range(len(order))}
    errors = []
    for r in out:
        text, follows = after[r["doc_id"]]
        k = len(text) // 3
        edited = text[: len(text) - k] + follows[:k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"] == r["edited_fingerprint"]) <= (r["near_edited"] == 1.0)
        errors += [abs(r["near_edited"] - likeness(text, edited)), abs(r["near_next"] - likeness(text, follows))]
    return errors


def test_fingerprints_follow_weighted_jaccard(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{MID}/documents.parquet").collect()]
    out = q.op3_fingerprints(spark, MID).collect()
    assert len(out) == len(texts)
    errors = check_edits(out, texts)
    assert np.mean(errors) < 0.05 and np.quantile(errors, 0.99) < 0.24
    of = dict(texts)
    prints = collections.defaultdict(set)
    for r in out:
        prints[of[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def plain_samples(text):
    """The weighted samples of a text, draw by draw."""
    import math
    import struct

    import xxhash

    def hashed(*longs_and_int):
        h = 42
        for x, kind in longs_and_int:
            h = xxhash.xxh64_intdigest(struct.pack(kind, x), seed=h)
        return h

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    weights = collections.Counter()
    for i in range(max(1, len(words) - 4)):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<q", signed(xxhash.xxh64_intdigest(w.encode(), seed=42))), seed=h)
        weights[signed(h)] += 1
    unit = lambda bits, shift, width: ((bits >> shift & (1 << width) - 1) + 0.5) / (1 << width)
    out = []
    for k in range(fingerprints.SAMPLES):
        best = None
        for term, w in weights.items():
            draw = lambda i: hashed((term, "<q"), (i, "<i"))  # noqa: B023, E731
            gamma = lambda x: -math.log(unit(x, 0, 32) * unit(x, 32, 32))
            r, c = gamma(draw(k % 16)), gamma(draw(16 + (k // 16 + k) % 16))
            beta = unit(draw(32 + k // 4), 16 * (k % 4), 16)
            t = math.floor(math.log(w) / r + beta)
            own = (math.floor((math.log(c) - r * (t - beta + 1) + 64) * (1 << 18)), (term ^ t) & (1 << 38) - 1)
            best = own if best is None else min(best, own)
        out.append(f"{best[1]:010x}")
    return out


def test_weights_enter_the_draws(spark):
    """Against plain draws, and the rate of collisions against generalised Jaccard similarity on skewed counts."""
    rng = random.Random(12)
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(5)) for _ in range(12)]
    bag = lambda: ". ".join(x for x in lines[: rng.randint(4, 12)] for _ in range(int(rng.paretovariate(0.7)) % 60 + 1))
    texts = [(i, bag()) for i in range(120)]
    out = {r["doc_id"]: r for r in fingerprints.compare_edits(frame(spark, texts)).collect()}
    for i in range(0, 120, 30):
        own = out[i]["fingerprint"]
        assert np.mean([a == own[10 * k : 10 * k + 10] for k, a in enumerate(plain_samples(texts[i][1]))]) > 0.98
    pairs = [(likeness(texts[i][1], texts[i - 1][1]), out[i]["near_next"]) for i in range(1, 120)]
    errors = np.array([got - want for want, got in pairs])
    assert np.std([w for w, _ in pairs]) > 0.1 and abs(errors.mean()) < 0.025 and np.sqrt((errors**2).mean()) < 0.1
    counted = lambda a, b: len(set(terms(a)) & set(terms(b))) / len(set(terms(a)) | set(terms(b)))
    assert np.mean([abs(counted(texts[i][1], texts[i - 1][1]) - out[i]["near_next"]) for i in range(1, 120)]) > 2 * np.abs(errors).mean()


def test_terms_of_both_texts_are_sampled_once(spark):
    """Fingerprints from shared and own terms are those of the whole texts; a term that both texts hold once is one row."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = [(i, t) for i, t in dict(EDGE).items() if i is not None] + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 90)))) for i in range(60)]
    texts += [(200 + i, "again and again the same line stands here. " * i + f"end {i}") for i in range(1, 9)]
    pairs = spark.createDataFrame([(i, t or "", u or "") for (i, t), (_, u) in zip(texts, [(i, (t or "")[: 2 * len(t or "") // 3] + " x y") for i, t in texts], strict=True)], "id int, a string, b string")
    parts = collections.defaultdict(dict)
    for r in fingerprints._sampled(fingerprints.with_terms_of_two(pairs, "a", "b"), ["id", "_in"], "f").collect():
        parts[r["id"]][r["_in"]] = r["f"]
    least = lambda x, y: [min((v for v in p if v is not None), default=None) for p in zip(x, y, strict=True)]
    for text, own in (("a", fingerprints.OWN), ("b", fingerprints.OTHER)):
        whole = {r["id"]: r["f"] for r in fingerprints.fingerprints(pairs, ["id"], text, "f").collect()}
        assert len(whole) == len(texts) and all(least(parts[i][fingerprints.BOTH], parts[i][own]) == f for i, f in whole.items())
    long = spark.createDataFrame([(" ".join(words), " ".join(words[:200]))], "a string, b string")
    assert fingerprints.with_terms_of_two(long, "a", "b").where("_term is not null").count() == 296


def test_rows_without_id_and_wide_ids(spark):
    texts = [(None, f"row without id {i}") for i in range(40)] + [((1 << 50) - 7 * i, f"wide {i}") for i in range(30)] + [(-(1 << 50) + i, f"low {i}") for i in range(30)]
    d = frame(spark, texts, extra=False).select("doc_id", "text").withColumn("_tie", __import__("pyspark.sql.functions", fromlist=["xxhash64"]).xxhash64("text"))
    rows = fingerprints.in_ranges(d, 7).collect()
    parts = collections.defaultdict(list)
    for r in rows:
        parts[r["_part"]].append(r)
    assert sum(r["_guest"] == 0 for r in rows) == 100 and len(parts) > 10
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["_tie"]) for r in rows if not r["_guest"]), reverse=True)
    after = dict(zip(want, want[1:] + want[:1], strict=True))
    for own in parts.values():
        own.sort(key=lambda r: r["_place"])
        keys = [(r["doc_id"] is not None, r["doc_id"] or 0, r["_tie"]) for r in own]
        assert all(after[a] == b for a, b in zip(keys, keys[1:])) and own[-1]["_guest"] == 1


def test_fingerprint_edges(spark, tmp_path):
    texts = [(i, t) for i, t in dict(EDGE).items()] + [(-5, "x " * 400)]
    out = fingerprints.compare_edits(frame(spark, texts)).collect()
    assert len(out) == len(texts)
    check_edits(out, texts)
    assert fingerprints.compare_edits(frame(spark, texts[:0])).count() == 0
    assert fingerprints.compare_edits(frame(spark, [(3, "a b c")])).first()["near_next"] == 1.0
    many = [(i, f"text number {i} of these") for i in range(1200)]
    assert len(check_edits(fingerprints.compare_edits(frame(spark, many)).collect(), many)) == 2400


# --- 4: near duplicates ----------------------------------------------------------


def plain_classes(texts, threshold=0.8):
    def grams(t):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        return (frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))), tuple(w)) if w else (None, t if (t or "").strip() else None)

    own = {i: grams(t) for i, t in texts if i is not None}
    first, parent, links = {}, {i: i for i in own}, collections.Counter()
    for i in sorted(own):
        if own[i][1] is not None:
            first.setdefault(own[i][1], i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    reps = [i for i in first.values() if own[i][0]]
    where = collections.defaultdict(list)
    for i in reps:
        for g in own[i][0]:
            where[g].append(i)
    shared = collections.Counter(p for ids in where.values() for k, a in enumerate(ids) for p in ((a, b) for b in ids[k + 1 :]))
    for (a, b), c in shared.items():
        if c >= threshold * (len(own[a][0]) + len(own[b][0]) - c) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    rep = {i: first.get(own[i][1], i) for i in own}
    return {i: (find(rep[i]), rep[i], links[rep[i]]) for i in own}


def near_copies(n=260, seed=4):
    """A large group of near copies, several smaller ones, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base, out = [word() for _ in range(150)], []
    for i in range(n):
        w = base[:]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        out.append((i, " ".join(w)))
    for g in range(20):
        own = [word() for _ in range(60)]
        out += [(1000 + 10 * g + k, " ".join(own[: 60 - 3 * k] + [word() for _ in range(3 * k)])) for k in range(4)]
    return out + [(2000 + k, " ".join(word() for _ in range(80))) for k in range(60)] + [(3000 + k, out[0][1].upper()) for k in range(30)]


@pytest.mark.parametrize("params", [ngram_join.JaccardParams(), ngram_join.JaccardParams(block_texts=40), ngram_join.JaccardParams(block_texts=3)])
def test_near_duplicates_match_brute_force(spark, params):
    texts = near_copies() + [(9000, None), (9001, ""), (9002, "!!"), (9003, "!!"), (9004, "one two"), (9005, "One Two"), (9006, "one")]
    out = ngram_join.ngram_jaccard_join(frame(spark, texts), params).collect()
    want = plain_classes(texts)
    assert len(out) == len(texts)
    assert {r["doc_id"]: (r["class_id"], r["copy_of"], r["n_links"]) for r in out} == want


def test_a_chain_of_texts_costs_its_buckets(spark, monkeypatch):
    """5,000 texts in one component, alike from one to the next only: far fewer than all pairs are verified, no link is lost."""
    rng = random.Random(21)
    stream = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(5 * 5000 + 120)]
    texts = [(i, " ".join(stream[5 * i : 5 * i + 120])) for i in range(5000)]  # 5 words on: 111 of 121 five-grams; 10 on: 106 of 126
    params = ngram_join.JaccardParams(n=5, threshold=0.9, recall=0.9999, block_texts=64)
    sent = []
    monkeypatch.setattr(ngram_join, "_verify", lambda frame, p, own=ngram_join._verify: (sent.append(frame.groupBy("task").count().agg({"count": "sum"}).first()[0]), own(frame, p))[1])
    out = ngram_join.ngram_jaccard_join(frame(spark, texts, extra=False), params).collect()
    assert {r["class_id"] for r in out} == {0} and sum(r["n_links"] for r in out) == 2 * 4999
    assert sent[0] < 5000 * 64  # of 5000 * 79 for all pairs of blocks


def test_pairs_in_several_buckets_count_once(monkeypatch):
    sets = [np.arange(k, k + 50) for k in range(12)]
    earlier = [np.array([1, 2]), np.array([2]), *[np.zeros(0, np.int64)] * 10]
    met = ngram_join._met_before(earlier)
    assert met[0, 1] and not met[0, 2] and not met[1, 2]
    all_links, edges = ngram_join._link_block(sets, np.full(12, 2), 0.8)
    fewer, _ = ngram_join._link_block(sets, np.full(12, 2), 0.8, met)
    assert (all_links - fewer).tolist() == [1, 1] + [0] * 10 and len(edges) == 11
    few, _ = ngram_join._link_block(sets[:4], np.full(4, 2), 0.8, met[:4, :4])
    assert few.tolist() == [2, 2, 3, 3]


def test_near_duplicates_of_driver_rows_and_edges(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    out = q.op4_ngram_jaccard_join(spark, DATA).collect()
    assert {r["doc_id"]: (r["class_id"], r["copy_of"], r["n_links"]) for r in out} == plain_classes(texts)
    edge = ngram_join.ngram_jaccard_join(frame(spark, EDGE)).collect()
    assert len(edge) == len(EDGE) and {r["class_id"] for r in edge if r["doc_id"] in (6, 7)} == {6} and {r["class_id"] for r in edge if r["doc_id"] in (4, 5)} == {4}
    assert ngram_join.ngram_jaccard_join(frame(spark, [])).count() == 0
    kept = ngram_join.keep_one(frame(spark, EDGE))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 6, 8, 9, 10] and kept.columns == frame(spark, EDGE).columns


def test_band_counts_reach_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        bands, rows = ngram_join.JaccardParams(recall=recall).bands()
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 192


# --- 5: languages -----------------------------------------------------------------


def test_languages_of_held_out_rows(spark):
    out = q.op5_language_id(spark, MID).toPandas()
    docs = spark.read.parquet(f"{MID}/documents.parquet").toPandas()
    m = out.merge(docs[["doc_id", "lang"]])
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(out.doc_id, out.held_out, strict=True))
    assert (m[m.held_out].lang == m[m.held_out].lang_pred).mean() > 0.97 and ((out.score >= 0) & (out.score <= 1)).all()


def test_language_edges(spark):
    out = langid.identify(frame(spark, EDGE))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}
    assert got[1] == got[2] == got[4] == ("und", 0.0) and got[6][0] == "en"
    assert langid.identify(frame(spark, [])).count() == 0
    none = frame(spark, EDGE).withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(none).collect()} == {"und"}


# --- 6 and 7: secrets, addresses -----------------------------------------------------


def test_forest_in_sql_equals_the_trees(spark):
    from pyspark.sql import functions as F

    found = secrets.labelled_findings(150, 77)
    trees = secrets.default_forest()
    x = np.array([secrets._row(t, b) for t, b, _ in found])
    want = sum(t.apply(x) for t in trees) / len(trees)
    df = spark.createDataFrame([(k, t, b) for k, (t, b, _) in enumerate(found)], "k int, t string, b string").withColumn("f", secrets._features(F.col("t"), F.col("b")))
    got = np.array([r[0] for r in df.orderBy("k").select(secrets.forest_score(F.col("f"), trees)).collect()])
    assert np.allclose(got, want, atol=1e-5)
    assert ((want >= 0.5) == np.array([y for *_, y in found])).mean() > 0.97


def test_secrets_in_texts(spark, tmp_path):
    texts = EDGE + [(50, 'le token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" la'), (51, "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 of"), (52, "see http://a.example.com/the/index.html and internationalisation")]
    out = {r["doc_id"]: r for r in q.op6_secrets(spark, save(frame(spark, texts), tmp_path)).collect()}
    assert out[50]["spans"] == "12:52" and out[51]["n_secrets"] == out[52]["n_secrets"] == out[1]["n_secrets"] == 0
    assert secrets.find_secrets(frame(spark, [])).count() == 0


def test_secrets_of_unquoted_assignments(spark):
    key, sha = "f3ef04dbebab91ab85687d33eeaaf9ac699e1188", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"
    hidden = {
        f"API_TOKEN={key}": key, f"[db]\npassword={sha}\nport=1": sha, f"GET /v1/items?page=2&access_token={key}&limit=5 HTTP": key, f"client.secret={key}": key, f"run --token={key} x": key, f"/x/token={key}": key, f"opts=auth={key}": key,
        "export DB_PASSWORD=x7!Kq#92vL@p then": "x7!Kq#92vL@p", 'password: "T9$wq!z4Rk"': "T9$wq!z4Rk", "?api_key=Zq81LmX0pT47&user=anna": "Zq81LmX0pT47",
        "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKQ8dT==": "wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKQ8dT==",
    }
    plain = [f"commit={key}", "src=/the/user/static/image/index.html", "the password: instructions follow", "key: example.config-name", "a secret ingredient, the key=user_name_default_test", "uuid=04dbebab-91ab-8568-7d33-eeaaf9ac699e"]
    texts = [*hidden, *plain]
    out = {r["doc_id"]: [(x["start"], x["text"]) for x in r["secrets"]] for r in secrets.find_secrets(frame(spark, list(enumerate(texts)))).collect()}
    assert [out[k] for k in range(len(texts))] == [[(t.index(v), v)] for t, v in hidden.items()] + [[] for _ in plain]


def test_url_rules_and_trees(spark, tmp_path):
    given = [None, "no scheme", "http://Www.Example.com/en/x", "http://a.www.example.com/en/", "https://EXAMPLE.com/en/1?x", "http://x.example.com/fr", "http://a.net/es/", "http://anet/es/", "http://a.net/es", "http://b.net?x", "http://cheap-pills.example.org/buy/1?aff=2&ref=3", "http://library.example.org/en/5", "http://İ.com/", "", "http://x7f3.9ab2.q1z8k3v5w2m9t4.example.top/go/a8f3e9b2c7d1?id=1&k=99&s=c8d7&u=%2F%41%20%3D"]
    spark.createDataFrame([(i, u, "<html>", "h") for i, u in enumerate(given)], "page_id long, url string, html string, host string").write.parquet(str(tmp_path / "pages.parquet"))
    out = {r["page_id"]: r for r in q.op7_url_filter(spark, str(tmp_path)).collect()}
    assert [out[i]["rule"] for i in range(len(given))] == [None, None, "www.example.com/en/", "www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None, None, None, "com/", None, None]
    assert (out[1]["host"], out[1]["path"]) == ("", "") and (out[4]["host"], out[4]["path"]) == ("example.com", "/en/1") and (out[9]["host"], out[9]["path"]) == ("b.net", "")
    assert [out[i]["verdict"] for i in (2, 4, 5, 6, 10, 11, 14)] == ["allow", "block", "allow", "block", "allow", "allow", "block"]  # a hyphen is no sign
    rows = urls.labelled_urls()
    cut = [k % 5 == 0 for k in range(len(rows))]
    model = urls.train([r for r, c in zip(rows, cut, strict=True) if not c])
    held = [r for r, c in zip(rows, cut, strict=True) if c]
    assert ((model.scores([u for u, _ in held]) >= 0.5) == np.array([y for _, y in held])).mean() > 0.9


def test_urls_and_findings_of_other_words(spark):
    """Models judge names, hosts and words that are in no training row; labelled rows may come from tables."""
    other = ("cro", "nen", "fy", "dol", "hap", "wim", "gor", "tes", "quil", "jan", "rep", "stu", "lin", "mec")
    rows = urls.labelled_urls(1000, 99, other)
    y, said = np.array([x for _, x in rows]), urls.default_model().scores([u for u, _ in rows]) >= 0.5
    assert (said & (y == 1)).sum() / said.sum() > 0.85 and said[y == 1].mean() > 0.95
    table = spark.createDataFrame([*rows, (None, 1), ("x", 7)], "url string, label int")
    assert sorted(urls.urls_of(table)) == sorted(rows) and 50 < len(urls.urls_of(table, 100)) < 200
    rng = random.Random(5)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: "".join(rng.choice(other) for _ in range(rng.randint(2, 4)))
    hidden = [(f"{word()} {rng.choice(('password', 'api_key', 'AUTH_TOKEN', 'secret'))}{rng.choice(('=', ': ', ' = '))}", pick(*rng.choice(((hexa, 40), (alnum, 32), (alnum, 24))))) for _ in range(150)]
    plain = [(f"{word()} ", rng.choice((f"{word()}{word()}{word()}{word()}"[:40].ljust(16, "a"), f"{word()}/{word()}/{word()}/{word()}", f"{word()}_{word()}_{word()}_{word()}", f"{word().title()}{word().title()}{word().title()}abc"))) for _ in range(150)]
    docs = frame(spark, [(k, f"{before}{value}, {word()}") for k, (before, value) in enumerate(hidden + plain)])
    got = {r["doc_id"]: [x["text"] for x in r["secrets"]] for r in secrets.find_secrets(docs).collect()}
    right = sum(got[k] == [v] for k, (_, v) in enumerate(hidden))
    wrong = sum(bool(got[len(hidden) + k]) for k in range(len(plain)))
    assert right >= 0.95 * len(hidden) and wrong <= 0.05 * len(plain)
    found = spark.createDataFrame([*secrets.labelled_findings(30, 3), ("only", None, None)], "candidate string, before string, label int")
    assert len(secrets.findings_of(found)) == 60 and secrets.train(secrets.findings_of(found))


# --- 8: benchmark leaks -----------------------------------------------------------------


def test_leaks_full_paraphrased_and_none(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    bench = spark.read.parquet(f"{MID}/benchmark.parquet")
    plain = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())) + " "
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    texts = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}
    want = {(d, i) for i, t in items.items() for d, x in texts.items() if plain(t) in x}
    rng, made = random.Random(8), []
    for i, t in items.items():
        w = t.split()
        for k in rng.sample(range(len(w) - 4), len(w) // 6):
            w[k] = "zzz"
        made.append((100_000 + i, f"{'lorem ipsum dolor ' * 20}{' '.join(w)}{' sit amet' * 30}", "en", "s", 1))
    all_docs = docs.unionByName(spark.createDataFrame(made + [(None, None, None, None, None)], DOCS))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(all_docs, bench).collect()}
    assert len(want - got) <= 0.02 * len(want)
    assert {d for d, _ in got if d < 100_000} <= {d for d, _ in want}
    assert sum((100_000 + i, i) in got for i in items) >= 0.95 * len(items)
    kept = decontam.clean(all_docs, bench)
    assert kept.columns == docs.columns and kept.count() == all_docs.count() - len({d for d, _ in got})
    assert decontam.find_leaks(docs.where("false"), bench).count() == 0 and decontam.find_leaks(docs, bench.where("false")).count() == 0
    assert decontam.find_leaks(frame(spark, EDGE), bench).count() == 0


def test_short_items_in_long_documents(spark):
    rng = random.Random(3)
    begin, end = ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki"), ("lan", "mer", "nis", "pot", "rud", "sal")
    vocabulary = [a + b + c + d for a in begin for b in end for c in begin for d in end]
    said = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = {100 * n + j: said(n) for n in range(1, 16) for j in range(4)}
    docs = [(k, " ".join(said(150))) for k in range(60)]
    for i, w in items.items():  # whole copies at all places against the windows, the ends too
        for at in (0, 37, 43, 150):
            text = said(150)
            docs.append((1000 * len(docs) + i, " ".join(text[:at] + [", ".join(w)] + text[at:])))
    held = lambda w, text: f" {' '.join(w)} " in f" {text.replace(',', '')} "
    want = {(d, i) for d, text in docs for i, w in items.items() if held(w, text)}
    near = [(5_000_000 + i, " ".join(said(70) + w[:3] + ["zzz"] + w[4:] + said(70))) for i, w in items.items() if len(w) >= 8]
    scattered = [(6_000_000 + i, " ".join(said(40) + w[:2] + ["zzz"] + w[2:] + said(40))) for i, w in items.items() if len(w) in (4, 5)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["share"] for r in decontam.find_leaks(frame(spark, docs + near + scattered), bench).collect()}
    assert want <= set(found) and all(found[x] == 1 for x in want)
    assert {(d, d - 5_000_000) for d, _ in near} <= set(found)
    assert not {(d, d - 6_000_000) for d, _ in scattered} & set(found)


def test_leaks_do_not_depend_on_the_blocks_of_items(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    found = lambda p: {(r["doc_id"], r["item_id"]): (r["share"], r["cosine"]) for r in decontam.find_leaks(docs, bench, p).collect()}
    one, many = found(decontam.LeakParams()), found(decontam.LeakParams(items_block=9))
    assert one and set(one) == set(many)
    assert np.allclose([one[k] for k in one], [many[k] for k in one], atol=1e-3)


def test_rows_without_an_id_are_filtered_like_others(spark):
    rng = random.Random(6)
    said = lambda k: " ".join(f"w{rng.randrange(3000)}" for _ in range(k))
    twin, lone, item = said(60), said(60), said(30)
    texts = [(1, twin), (None, twin), (None, twin + " more"), (None, lone), (None, lone), (2, said(60)), (None, f"{said(40)} {item} {said(40)}"), (3, f"{said(40)} {item} {said(40)}")]
    docs = frame(spark, texts)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted([texts[k] for k in (0, 3, 5, 6, 7)], key=repr)
    clean = decontam.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted([(r["doc_id"], r["text"]) for r in clean.collect()], key=repr) == sorted(texts[:6], key=repr)


def test_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 30)), rng.integers(0, 5, rng.integers(1, 30))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontam._lcs(a, b) == t[-1, -1]


# --- 9: token ids ---------------------------------------------------------------------------


def check_tokens(out, texts):
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(q.tokenizer_path()), 0
    by = sorted(out, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"]))
    of = collections.defaultdict(list)
    for i, x in texts:
        of[i].append(x or "")
    for r in by:
        assert r["start"] == at
        at += r["n_tokens"]
        found = [(len(e), zlib.crc32(np.array(e, "<u4").tobytes())) for e in (t.encode(x, add_special_tokens=False).ids + [2] for x in of[r["doc_id"]])]
        assert (r["n_tokens"], r["ids_crc32"]) in found


def test_token_ids_round_trip(spark, tmp_path):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    check_tokens(q.op9_token_ids(spark, DATA).collect(), texts)
    odd = EDGE + [(20, "a<|endoftext|>b <|startoftext|>"), (21, "it's I'LL\x85x\x1cy z"), (22, "É é ﬁ Ａ ΑΣ İ ß ÿ Ÿ"), (-3, "minus")]
    path = str(tmp_path / "ids")
    out = tokens.tokenize(frame(spark, odd), q.tokenizer_path(), path).collect()
    assert len(out) == len(odd)
    check_tokens(out, odd)
    assert tokens.read_tokens(spark, path, 21).count() == 1
    assert tokens.tokenize(frame(spark, []), q.tokenizer_path()).count() == 0


# --- 10: mixing ------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, left = {s: k % 3 + 1 for k, s in enumerate(names)}, sum(sizes.values()), set(names)
    target = {}
    while left:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            left.remove(s)
    return target


def test_mixing_targets_epochs_and_reruns(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * (0 if rng.random() < 0.05 else rng.randint(1, 60))), None, s, 0) for i, s in enumerate(rng.choices(["a", "b", "é", None, "zz", "tiny"], [300, 20, 20, 5, 50, 2], k=900))]
    df = spark.createDataFrame([*rows, (5000, None, None, "a", 0), (5001, "x", None, "only", 0)], DOCS)
    out = mixing.mix(df).collect()
    assert len(out) == df.count() and sorted(map(tuple, mixing.mix(df.repartition(13)).collect())) == sorted(map(tuple, out))
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    sizes, taken, target, largest = collections.Counter(), collections.Counter(), {}, collections.Counter()
    for r in out:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    assert all(r["source_size"] == sizes[source[r["doc_id"]]] for r in out)
    want = plain_targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    copies = mixing.mixed_documents(df)
    got = collections.Counter(r["doc_id"] for r in copies.collect())
    assert copies.columns == df.columns and all(got[r["doc_id"]] * r["size"] == r["taken"] for r in out)
    assert mixing.mix(df.where("false")).count() == 0 and mixing.mix(df.where("doc_id = 5000")).first()["taken"] == 0


def test_mixing_prefers_higher_weights(spark):
    df = spark.createDataFrame([(i, ("good words here " if i % 2 else "## $$ && %% !! ") * 5, None, "abc"[i % 3], 0) for i in range(3000)], DOCS)
    out = mixing.mix(df).toPandas()
    share = out.assign(odd=out.doc_id % 2, got=out.taken > out["size"] * (out.target // out.source_size)).groupby("odd").got.mean()
    assert share[1] > 3 * share[0]


# --- shared parts ----------------------------------------------------------------------------


def test_words_and_shingles_across_rows():
    import pyarrow as pa

    w = shared.Words(pa.array(["Ab cd", None, "", "ab", "CD ef gh ij kl mn", "é-é"]).slice(0))
    assert np.diff(w.offsets).tolist() == [2, 0, 0, 1, 6, 2] and w.hashes[0] == w.hashes[2] and w.hashes[1] == w.hashes[3] and w.hashes[-1] == w.hashes[-2]
    assert np.diff(w.shingles(5)[1]).tolist() == [1, 0, 0, 1, 2, 1]
    part = shared.Words(pa.array(["zz", "Ab cd", "x"]).slice(1))
    assert part.hashes[:2].tolist() == w.hashes[:2].tolist()


def test_slices_by_rows_and_bytes():
    import pyarrow as pa

    texts = ["a" * k for k in (1, 2, 50, 3, 0, 4, 200, 5, 5, 5)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(11)), pa.array(texts)], ["i", "t"])
    parts = [p.column(0).to_pylist() for p in shared.slices(batch.slice(1), 1, 3, 60)]
    assert parts == [[1, 2, 3], [4, 5], [6], [7, 8, 9], [10]] and list(shared.slices(batch.slice(0, 0), 1, 3)) == []


def test_ranges(spark):
    df = spark.createDataFrame([(i * i - 50,) for i in range(1000)] + [(None,)], "doc_id long")
    bounds = shared.range_bounds(df.where("doc_id is not null"), "doc_id", 7)
    got = {r["doc_id"]: r["r"] for r in df.withColumn("r", shared.range_of("doc_id", bounds)).collect()}
    assert got[None] == -1 and all(got[v] == sum(b < v for b in bounds) for v in got if v is not None) and len(set(got.values())) > 100
