"""Plain versions of what SQL cannot express: URL features and scores, quality statistics and class sums, candidates of secrets, leaks."""

from __future__ import annotations

import collections
import math
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.llm import decontam, quality, secrets, urls

DATA = "/root/testdata/sf0.001"

# --- addresses ----------------------------------------------------------------------


def plain_entropy(text):
    b = text.encode()
    return -sum(c / len(b) * math.log2(c / len(b)) for c in collections.Counter(b).values()) if b else 0.0


def plain_features(url, model):
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.split("[/?#]", rest)[0].lower()
    tail = rest[len(host) :] if "://" in url else url
    path = re.split("[?#]", tail)[0]
    labels = host.split(".")
    rate = model.two.get(".".join(labels[-2:]), model.one.get(labels[-1], model.prior)) if len(labels) > 1 else model.one.get(host, model.prior)
    digits = lambda t: sum(c in string.digits for c in t)
    letters = sum(c in string.ascii_lowercase for c in host)
    return [
        len(url), len(host), len(tail), host.count("."), path.count("/"), digits(url) / max(1, len(url)), digits(host), digits(host) / max(1, len(host)), plain_entropy(host), plain_entropy(tail),
        tail.count("=") + tail.count("&"), tail.count("%"), digits(path) / max(1, len(path)), max(len(x.encode()) for x in labels), max(len(x.encode()) for x in path.split("/")), sum(host.count(c) for c in "aeiou") / max(1, letters), rate,
    ]


def plain_score(x, model):
    total = model.base
    for t in model.trees:
        k = 0
        while t.feature[k] >= 0:
            k = t.left[k] if x[t.feature[k]] <= t.cut[k] else t.right[k]
        total += t.value[k]
    return 1 / (1 + math.exp(-total))


ODD = ["", "x", "no scheme/at all?a=1", "http://", "https://a", "https://A.B.co.uk/x/y?z=%20#f", "http://é.example/ü/ß?q=ä", "a://b://c/d", "https://h.com?x=1&y=2", "http://1.2.3.4:80/", "http://h.top/\nnew\nline", "http://" + "long." * 500 + "com/" + "part/" * 20_000]


def test_url_features_and_scores_by_plain_versions(spark):
    model = urls.default_model()
    given = ODD + [u for u, _ in urls.labelled_urls(150, 12)] + [r["url"] for r in spark.read.parquet(f"{DATA}/pages.parquet").select("url").collect()]
    want = np.array([plain_features(u, model) for u in given])
    column = pa.array(given, pa.large_string())
    hosts = urls._hosts(column)
    assert np.allclose(urls.features(column, hosts, model.rates(hosts)), want)
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([*given, None])], "page_id long, url string")
    scores = {r["page_id"]: r["score"] for r in urls.judge(pages).collect()}
    assert np.allclose([scores[k] for k in range(len(given))], [plain_score(x, model) for x in want])
    assert scores[len(given)] == scores[0] and urls.judge(pages.where("false")).count() == 0


def test_urls_of_another_generator():
    """Whole words, usual endings and forms of sites that the training rows do not have; hyphens on both sides."""
    r = random.Random(4)
    words = "river garden market travel music health school history planet kitchen weather science sports local daily news energy paper window bridge forest doctor family summer winter coffee camera village design report".split()
    word, some = lambda: r.choice(words), lambda k, by: by.join(r.sample(words, k))
    drawn = lambda a, b: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(a, b)))

    def plain():
        host = f"{r.choice(('www.', '', '', 'news.', 'shop.'))}{some(r.randint(1, 3), r.choice(('', '-')))}.{r.choice(('com', 'org', 'net', 'edu', 'de', 'co.uk', 'fr', 'nl'))}"
        tails = ("", f"{word()}/{word()}", f"questions/{r.randint(1000, 9_999_999)}/{some(6, '-')}", f"{r.randint(2000, 2025)}/{r.randint(1, 12)}/{some(5, '-')}.html", f"search?q={some(2, '+')}", f"item/{r.randint(1, 99_999)}?ref={word()}&page=2", f"wiki/{some(2, '_')}", f"en/{r.randint(1, 99)}")
        return f"https://{host}/{r.choice(tails)}"

    def spam():
        kinds = (
            f"http://{drawn(4, 6)}.{drawn(4, 6)}.{drawn(4, 6)}.{some(2, '-')}.{r.choice(('top', 'xyz', 'click', 'com'))}/{drawn(16, 32)}",
            f"http://{word()}{r.randint(10_000, 9_999_999)}.{r.choice(('biz', 'info', 'top', 'com'))}/go.php?" + "&".join(f"{word()}={drawn(4, 20)}" for _ in range(r.randint(5, 9))),
            f"http://{'.'.join(str(r.randint(1, 255)) for _ in range(4))}/{word()}/login.php?id={drawn(20, 40)}&s={drawn(4, 8)}&t={r.randint(1, 10**9)}",
            f"https://{drawn(14, 22)}.{r.choice(('xyz', 'top', 'net', 'com'))}/r?u=http%3A%2F%2F{word()}.com%2F{word()}%3Fa%3D{r.randint(1, 999)}&k={drawn(8, 16)}&c=1&d=2",
            f"http://secure.login.{word()}.{drawn(6, 9)}.{word()}.{r.choice(('com', 'info', 'click'))}/{drawn(8, 20)}/{drawn(8, 20)}/index.html",
        )
        return r.choice(kinds)

    model = urls.default_model()
    wrong, right = (int((model.scores([make() for _ in range(1000)]) >= 0.5).sum()) for make in (plain, spam))
    assert right >= 900 and right / (right + wrong) >= 0.9
    allowed = ["http://my-local-school.edu/en/12", "http://well-known-news.com/en/1", "https://stackoverflow.com/questions/11227809/why-is-processing-a-sorted-array-faster-than-processing-an-unsorted-array", "https://en.wikipedia.org/wiki/Similarity_join"]
    assert (model.scores(allowed) < 0.5).all()
    # a hyphen alone moves no score far
    pairs = [(f"https://{a}{b}.com/en/3", f"https://{a}-{b}.com/en/3") for a, b in zip(words[::2], words[1::2], strict=True)]
    assert (np.array([model.scores(list(p)) for p in pairs]) < 0.5).all()


# --- quality --------------------------------------------------------------------------


def plain_statistics(text):
    t = text or ""
    b = t.encode()
    count = lambda chars: sum(b.count(c.encode()) for c in chars)
    words = [w for w in re.findall(rb"[0-9a-z\x80-\xff]+", t.lower().encode())]
    grams = [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
    n, upper, letters = len(b), count(string.ascii_uppercase), count(string.ascii_letters)
    ratio = lambda k, by: math.log((k + 1) / by)
    return [
        math.log(len(words) + 1), ratio(upper, letters + 20), ratio(count(string.digits), n + 100), ratio(count("#$%&*@^~<>{}[]\\/=+_`"), n + 100), ratio(count("!"), n + 100), ratio(count("|"), n + 100), ratio(count(".,;:?"), n + 50),
        math.log((sum(map(len, words)) + 5) / (len(words) + 1)), math.log((len(set(words)) + 5) / (len(words) + 5)), ratio(len(grams) - len(set(grams)), len(grams) + 20), ratio(count("\n"), n + 200), ratio(count(" \t"), n + 20), ratio(sum(c >= 128 for c in b), n + 100),
    ]


def test_quality_by_plain_statistics_sums_and_densities(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    x = {i: np.array(plain_statistics(t)) for i, t in texts.items()}
    got = {r["doc_id"]: r["x"] for r in quality.statistics(docs).collect()}
    assert got.keys() == x.keys() and all(np.allclose(got[i], x[i]) for i in x)
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in x}
    known = [(x[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in x and r["quality"] in (0, 1) and not held[r["doc_id"]]]
    parts = [np.array([v for v, y in known if y == label]) for label in (0, 1)]
    covs = [np.cov(p, rowvar=False, bias=True) for p in parts]
    both = sum(c * len(p) for c, p in zip(covs, parts, strict=True)) / len(known)
    dense = []
    for c, p in zip(covs, parts, strict=True):
        c = 0.8 * c + 0.2 * both
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        dense.append((p.mean(axis=0), np.linalg.inv(c), np.linalg.slogdet(c)[1]))
    out = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert out.keys() == x.keys()
    for i, v in x.items():
        d = math.log(len(parts[1]) / len(parts[0]))
        for sign, (mean, inverse, det) in zip((-1, 1), dense, strict=True):
            d -= sign * 0.5 * ((v - mean) @ inverse @ (v - mean) + det)
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, d / len(v)))))
        assert abs(out[i]["score"] - want) < 1e-6 and out[i]["predicted"] == (out[i]["score"] >= 0.5) and out[i]["held_out"] == held[i]


# --- secrets --------------------------------------------------------------------------

SPACE, QUOTES, KEYS = " \t\n\x0b\f\r", "\"'`<>", string.ascii_letters + string.digits + "_+/-"


def plain_candidates(text):
    at = lambda k: text[k] if 0 <= k < len(text) else ""
    word = string.ascii_letters + string.digits + "_"

    def named(k):  # a word and = stand here
        e = k
        while at(e) and at(e) in word:
            e += 1
        return e > k and at(e) == "="

    def value(k):  # up to a space, a quote or &, without signs at its end
        e = k
        while at(e) and at(e) not in SPACE + QUOTES + "&":
            e += 1
        while e > k and text[e - 1] in ",;.:?)]}":
            e -= 1
        return e

    def told(k):
        if not at(k - 1) or at(k - 1) not in SPACE + "\"'=:>" or not any(text[:j].lower().endswith(secrets.TELLING) and not re.search("[A-Za-z]", text[j:k]) for j in range(max(0, k - 6), k)):
            return None
        if not at(k) or at(k) in SPACE + QUOTES + "=:":
            return None
        whole = len(text) >= k + 8 and not any(c in SPACE + QUOTES + "&" for c in text[k + 1 : k + 8])
        if not whole:
            e = k
            while at(e) and at(e) not in SPACE + QUOTES + "=:&":
                e += 1
            if not (e > k and at(e) == "&" and not named(e + 1) and len(text) >= e + 7 and not any(c in SPACE + QUOTES for c in text[e + 1 : e + 7])):
                return None
        e = value(k)
        if e == k:
            return None
        while at(e) == "&" and not named(e + 1) and value(e + 1) > e + 1:
            e = value(e + 1)
        return e

    def run(k):
        own = KEYS + "=."
        if at(k - 1) and at(k - 1) in own and not (at(k - 1) == "=" and at(k - 2) and at(k - 2) in KEYS + "."):
            return None
        if len(text) < k + 16 or any(c not in own for c in text[k : k + 16]):
            return None
        e = k
        while at(e) and at(e) in KEYS + ".":
            e += 1
        if at(e) == "=" and at(e + 1) and at(e + 1) in KEYS + ".":
            return None
        e = k
        while at(e) and at(e) in own:
            e += 1
        while text[e - 1] == ".":
            e -= 1
        return e if e > k else None

    out, k = [], 0
    while k < len(text):
        e = told(k) or run(k)
        if e:
            out.append((k, e))
        k = e or k + 1
    return out


def test_candidates_of_secrets_by_a_plain_scan(spark):
    r = random.Random(16)
    bits = ["token", "password", "my_key", "AUTH", "=", ": ", " = ", "'", '"', "&", "&x=", "==", ".", "...", "/", "-", " ", "\n", "é", "😀", "<", "value", "AKIA" + "Q7" * 8, "a1B2c3D4" * 3, "p@ss!", "word", "9" * 15, "name=", "(", ")", ","]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(1500)]
    texts += [r_["text"] or "" for r_ in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    out = {r_["doc_id"]: [(s["start"], s["end"]) for s in r_["secrets"]] for r_ in secrets.find_secrets(docs, threshold=-1.0).collect()}
    wrong = [(texts[k], out[k], plain_candidates(texts[k])) for k in range(len(texts)) if out[k] != plain_candidates(texts[k])]
    assert not wrong, wrong[:3]
    assert sum(map(len, out.values())) > 500


# --- leaks ----------------------------------------------------------------------------


def test_the_inverted_list_by_plain_sets():
    r = np.random.default_rng(3)
    words = [r.integers(0, 2**64, 400, np.uint64)[r.integers(0, 400, n)] for n in (1, 6, 16, 40, 90)] + [np.arange(1, 30, dtype=np.uint64) << np.uint64(50)] * 2
    weight = np.append(np.ones(1 << decontam.BITS, np.float32), np.float32(0))
    index = decontam._index(list(range(len(words))), words, r.standard_normal((1 << decontam.SPACE_BITS, 8)).astype(np.float32), weight, decontam.LeakParams())
    sets = [set(decontam._buckets(w).tolist()) for w in words]
    asked = np.array([[*r.permutation(decontam._buckets(np.concatenate(words)))[:3], 1 << decontam.BITS] for _ in range(200)])
    want = {(k, i) for k, row in enumerate(asked.tolist()) for i, own in enumerate(sets) if own & set(row)}
    for most in (1, 7, 1 << 18):
        got = [(a, b) for w, k in index.holders(asked, most) for a, b in zip(w.tolist(), k.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want
    items = r.integers(0, len(words), len(asked))
    assert (index.holds(items, asked) == np.array([[b in sets[i] for b in row] for i, row in zip(items, asked.tolist(), strict=True)])).all()


def changed(form, w, vocabulary, r):
    if form == "whole":
        return w
    if form == "dropped":
        return [x for k, x in enumerate(w) if k % 5 != 4]
    if form == "substituted":
        return [r.choice(vocabulary) if k % 5 == 4 else x for k, x in enumerate(w)]
    return [w[k + 1] if k % 5 == 0 and k + 1 < len(w) else w[k - 1] if k % 5 == 1 else x for k, x in enumerate(w)]


@pytest.mark.parametrize("blocks", [1, 3])
def test_recall_of_leaks_by_length_and_form(spark, blocks):
    """Items of 6 to 120 words of the corpus in documents of its words: nearly all found, and nothing whose words are not there in order."""
    r = random.Random(88)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    vocabulary = sorted({w for t in docs.collect() for w in re.findall("[a-z]+", (t["text"] or "").lower())})
    said = lambda k: [r.choice(vocabulary) for _ in range(k)]
    lengths = (6, 8, 10, 13, 16, 20, 30, 50, 120)
    items = {100 * n + j: said(n) for n in lengths for j in range(20)}
    made, want = [], {}
    for form in ("whole", "dropped", "substituted", "swapped"):
        for i, w in items.items():
            d = 1_000_000 + len(made)
            made.append((d, " ".join(said(r.randint(0, 90)) + changed(form, w, vocabulary, r) + said(r.randint(0, 90)))))
            want[d] = (form, i)
    clean = [(2_000_000 + k, " ".join(said(150))) for k in range(100)]
    every = docs.unionByName(spark.createDataFrame(made + clean, "doc_id long, text string"))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]): x["share"] for x in decontam.find_leaks(every, bench, decontam.LeakParams(items_block=-(-len(items) // blocks))).collect()}
    hits = collections.Counter((f, i // 100) for d, (f, i) in want.items() if (d, i) in found)
    assert all(hits[f, n] >= 18 for f in ("whole", "dropped", "substituted", "swapped") for n in lengths), hits
    assert all(hits["whole", n] == 20 for n in lengths)
    texts = dict(made + clean)
    for d, i in found:
        if d in texts:
            assert want.get(d, (0, 0))[1] == i
    assert not any(d >= 2_000_000 for d, _ in found)


def test_leaks_of_no_and_equal_items(spark):
    w = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, None), (3, ""), (4, " ".join(w[:5])), (None, " ".join(w))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(w)), (7, " ".join(w)), (8, " ".join(w)), (9, ""), (10, None), (None, " ".join(w))], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()) == [(0, 7), (0, 8), (1, 7), (1, 8)]
    assert decontam.find_leaks(docs, bench.where(F.col("item_id") > 8)).count() == 0
