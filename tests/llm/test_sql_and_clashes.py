"""SQL of the training-data queries, stages under clashing column names and missing ids, files and bins."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from kinweave.llm import decontam, langid, mixing, ngram_join, pii, shared, tokens
from kinweave.llm import queries as q

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Every name that an operator gives to a column of its own.
INTERNAL = (
    "_row _row_key _text _size _hash _key _weight _times _source _bin _range _sum _base _part _tie _guest _place _to _term _w _h _at "
    "score lang_pred rid comp nb blk other side task class_id bh hub gone key_hi key_lo bands target source_size epochs cut below low high rest base "
    "upto bin bin_size bin_rows docs col size start tie ids n_tokens ids_crc32 item_id share cosine count rank w cap level capped"
).split()


def norm(v):
    return v if v is None or isinstance(v, (bool, str)) else round(float(v), 9) + 0.0


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = q.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(q.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols and got == sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


def documents(spark):
    d = shared.table(spark, DATA, "documents").limit(150)  # a fixture
    odd = spark.createDataFrame([(None, "a document without any id that stands alone here", "en", "s", 0), (None, None, None, None, 0), (None, "", "en", "s", 0), (10**6, "😀 " * 3000 + "and words after it", "en", None, 0)], DOCS)
    copies = odd.where("doc_id is null and length(text) > 5")
    return d.select("doc_id", "text", "lang", "source", d["n_chars"].cast("long").alias("n_chars")).unionByName(odd).unionByName(copies)


def test_stages_keep_columns_of_any_name(spark):
    plain = shared.materialize(documents(spark), "plain")
    wide = shared.materialize(plain.selectExpr("*", *[f"concat('{c}', coalesce(doc_id, 0)) as `{c}`" for c in INTERNAL]), "wide")
    for name, stage in corpus_pipeline.STAGES:
        a, b = stage(spark, plain, DATA), stage(spark, wide, DATA)
        key = lambda d: collections.Counter(tuple(r) for r in d.select(*(plain.columns if name != "token_ids" else d.columns)).collect())  # noqa: B023, E731
        assert key(a) == key(b), name
        if name != "token_ids":
            assert b.columns == wide.columns
            assert b.where(" or ".join(f"`{c}` <> concat('{c}', coalesce(doc_id, 0))" for c in INTERNAL)).count() == 0


def test_stages_judge_rows_without_id_by_their_texts(spark):
    docs = documents(spark)
    assert langid.accepted(docs).where("doc_id is null and length(text) > 5").count() == 2
    kept = ngram_join.keep_one(docs)
    assert kept.where("doc_id is null and length(text) > 5").count() == 1
    item = spark.createDataFrame([(1, "a document without any id that stands alone here")], "item_id long, text string")
    assert decontam.clean(docs, item).where("doc_id is null and length(text) > 5").count() == 0
    mixed = mixing.mix(docs)
    assert mixed.count() == docs.count() and mixed.where("doc_id is null and taken > 3 * size").count() == 0


def plain_mix(rows, seed=10):
    """taken by (doc_id, text), for whole epochs and a prefix of each source, in order of the keys."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    weigh = lambda t: 0.05 if t is None else max(0.05, 1 - 2 * len(re.sub(r"[^\W\d_]|\s", "", t)) / max(1, len(t)))
    total = sum(size(t) for _, t, _ in rows)
    by = collections.defaultdict(list)
    for i, t, s in rows:
        u = (int(hashlib.md5(f"{'' if i is None else i}:{seed}:{t or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by[s].append((-math.log(u) / weigh(t), size(t), i, t))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight, left, target = {s: k % 3 + 1 for k, s in enumerate(names)}, set(names), {}
    whole = {s: sum(x[1] for x in own) for s, own in by.items()}
    while left:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * whole[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * whole[s]
            left.remove(s)
    out = {}
    for s, own in by.items():
        epochs = min(3, int(target[s] // whole[s])) if whole[s] else 0
        rest, upto = target[s] - epochs * whole[s], 0
        groups = collections.defaultdict(list)
        for x in own:
            groups[x[0]].append(x)
        taking = rest > 0
        for key in sorted(groups):
            g = sum(x[1] for x in groups[key])
            taking = taking and (upto + g <= rest or upto < rest and upto + g - rest <= rest - upto)
            for x in groups[key]:
                out[x[2], x[3]] = x[1] * (epochs + taking)
            upto += g
    return out


@pytest.mark.parametrize("most", [20_000, 5])
def test_mixing_by_brute_force_with_refined_bins(spark, monkeypatch, most):
    """Low weights put most keys into one bin; it is parted until few rows are left."""
    monkeypatch.setattr(mixing, "SORTED_ROWS", most)
    rng = random.Random(7)
    text = lambda: rng.choice(["#$ %& !! ", "1234 56 ", "plain words of it ", "mixed 12 ## words "]) * rng.randint(1, 6) + "".join(rng.choice("abcdef") for _ in range(6))
    rows = [(i if i % 9 else None, text(), rng.choice("aaaaaaabcd")) for i in range(1500)] + [(7, "same text " * 3, "a")] * 40
    out = mixing.mix(spark.createDataFrame([(i, t, None, s, 0) for i, t, s in rows], DOCS).withColumn("bin", F.lit(1)))
    want = plain_mix(rows)
    got = sorted((r["size"], r["taken"]) for r in out.collect())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert got == sorted((size(t), want[i, t]) for i, t, _ in rows)


def test_files_hold_indexes_and_bloom_filters(spark, tmp_path):
    path = str(tmp_path / "orc")
    docs = spark.range(30_000).selectExpr("id as doc_id", "concat('words of document ', id, repeat(' and more of them', 20)) as text")
    tokens.write_tokens(docs.coalesce(1), q.tokenizer_path(), path)
    jvm, stripes, rows = spark._jvm, 0, 0
    files = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect() if r["path"].endswith(".orc")]
    options = jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration())
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), options)
        assert reader.getRowIndexStride() == 1000
        footer = reader.getFileTail().getFooter()
        for k in range(footer.getStripesCount()):
            own = footer.getStripes(k)
            assert own.getIndexLength() > 2000  # row indexes of each column, and the filter of doc_id
        stripes, rows = stripes + footer.getStripesCount(), rows + reader.getNumberOfRows()
    assert rows == 30_000 and stripes >= 1
    assert tokens.read_tokens(spark, path, 17).select("doc_id").collect()[0][0] == 17 and tokens.read_tokens(spark, path, 99_999).count() == 0


def test_account_numbers_among_capital_words_and_scores_by_context(spark):
    texts = {1: "iban ES91 2100 0418 4502 0005 1332 BIC X", 2: "ES9121000418450200051332 EUR 20", 3: "GB82 WEST 1234 5698 7654 32", 4: "ES91 2100 0418 4502 0005 1333", 5: "call +1 555 555 1234 or see +1 555 555 1234 there", 6: "XX12"}
    d = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"], round(s["score"], 2)) for s in r["pii"]] for r in pii.find_pii(d).collect()}
    assert [x[:3] for x in got[1]] == [("iban", 5, 34)] and [x[:3] for x in got[2]] == [("iban", 0, 24)] and [x[:3] for x in got[3]] == [("iban", 0, 27)]
    assert not got[4] and not got[6] and got[1][0][3] > got[2][0][3]
    phones = [x for x in got[5] if x[0] == "phone"]
    assert len(phones) == 2 and phones[0][3] > phones[1][3]
