"""The jobs: growing input, reruns, repeated batches, command lines, SQL."""

from __future__ import annotations

import json
import random

import duckdb
import pytest

from jobs import common, new_hits, shared_clusters
from jobs import queries as jobs

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string"


def made_rows(seed: int, n: int, first: int = 0):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    base = [" ".join(random.Random(k).choices(words, k=60)) for k in range(12)]
    rows = []
    for k in range(first, first + n):
        t = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 2, 8))):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((k, " ".join(t), rng.choice(["g1", "g2", "g3"]), rng.choice(["x", "y", None])))
    return rows


def sets_of(rows):
    own = {}
    for i, t, *_ in rows:
        if i is not None and (t or "").count(" ") >= 4:
            w = t.split(" ")
            own[str(i)] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    return own


def links(rows):
    """All pairs of 80 % or more, copies too."""
    own = sets_of(rows)
    return {(a, b) for a in own for b in own if a < b and 10 * len(own[a] & own[b]) >= 8 * len(own[a] | own[b])}


def expanded(rows):
    """The pairs that hits between first records and copies stand for."""
    first = {}
    for r in rows:
        if r["kind"] == "copy":
            first[r["query"]], first[r["target"]] = first.get(r["query"], set()) | {r["target"]}, first.get(r["target"], set()) | {r["query"]}
    out = {(r["query"], r["target"]) for r in rows}
    near = {(r["query"], r["target"]) for r in rows if r["kind"] == "near"}
    same = lambda x: {x} | first.get(x, set())
    for x in first:
        out |= {(a, b) for a in same(x) for b in same(x) if a < b and len(first[x]) > 1}
    for a, b in near:
        out |= {(min(x, y), max(x, y)) for x in same(a) for y in same(b)}
    return out


def add(spark, rows, folder):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(folder)


def test_new_hits_of_a_growing_folder(spark, tmp_path):
    records, out, mark = (str(tmp_path / x) for x in ("records", "out", "mark"))
    first, second = made_rows(1, 80), made_rows(2, 60, 80)
    second += [(3, "an id that is known already", "g9", "z"), (None, "no id at all is on this row", "g1", "x"), (900, None, "g1", "x"), (901, "too short", "g1", "x"), (902, first[0][1], "g3", "y"), (902, first[0][1] + " z", "g3", "y")]
    add(spark, first, records)
    assert new_hits.run(spark, records, out, mark) == 80
    one = new_hits.hits(spark, out).collect()
    assert expanded(one) == links(first)
    assert new_hits.run(spark, records, out, mark) == 0  # nothing is new
    assert sorted(new_hits.hits(spark, out).collect()) == sorted(one)
    add(spark, second, records)
    assert new_hits.run(spark, records, out, mark) == len(second)
    both = new_hits.hits(spark, out).collect()
    assert [r for r in both if r["batch"] == 0] and sorted(r for r in both if r["batch"] == 0) == sorted(one)  # what stood there stays
    known = {i: t for i, t, *_ in first} | {i: t for i, t, *_ in second if i is not None and i not in {x[0] for x in first}} | {902: first[0][1]}
    assert expanded(both) == links(list(known.items()))
    assert len({(r["query"], r["target"]) for r in both}) == len(both)
    genome = {str(r[0]): r[2:] for r in reversed(second + first) if r[0] is not None}
    for r in both:
        assert (r["query_genome"], r["query_taxon"]) == genome[r["query"]] and r["query"] < r["target"]
        assert r["taxon_pair"] == ("-".join(sorted((r["query_taxon"], r["target_taxon"]))) if r["query_taxon"] and r["target_taxon"] else None)


def test_a_batch_that_is_run_again_gives_the_same_files(spark, tmp_path):
    records, out = str(tmp_path / "records"), str(tmp_path / "out")
    add(spark, made_rows(3, 60), records)
    rows = spark.read.parquet(records)
    new_hits.take(rows.where("doc_id < 40"), 0, out, new_hits.Config())
    new_hits.take(rows.where("doc_id >= 40"), 1, out, new_hits.Config())
    want = sorted(map(str, new_hits.hits(spark, out).collect()))
    new_hits.take(rows.where("doc_id >= 40"), 1, out, new_hits.Config())  # as after a failure before the commit
    assert sorted(map(str, new_hits.hits(spark, out).collect())) == want
    new_hits.take(rows, 0, out, new_hits.Config())  # a new checkpoint starts anew
    assert expanded(new_hits.hits(spark, out).collect()) == links(made_rows(3, 60))


def test_shared_clusters_replace_what_was_there(spark, tmp_path):
    records, out = str(tmp_path / "records"), str(tmp_path / "out")
    rows = [r for r in made_rows(4, 90)] + [(500, None, "g1", "x"), (501, "a b c d e f g", None, "x"), (None, "a b c d e f g", "g1", "x")]
    add(spark, rows, records)
    known = [r for r in rows if r[0] is not None and r[2] and r[3]]
    near = {}
    for a, b in links(known):
        near.setdefault(a, {a}).add(b), near.setdefault(b, {b}).add(a)
    classes = []
    for x in near:
        own, todo = set(), {x}
        while todo:
            own |= todo
            todo = set().union(*[near[y] for y in todo]) - own
        classes.append(frozenset(own))
    of = {str(r[0]): r[2:] for r in known}
    for least in (2, 3, 2):
        written = shared_clusters.run(spark, records, out, shared_clusters.Config(min_genomes=least))
        members = spark.read.parquet(f"{out}/members").collect()
        assert written["members"] == len(members)
        want = {c for c in classes if len({of[x][0] for x in c}) >= least}
        got = {}
        for r in members:
            got.setdefault(r["chg_id"], set()).add(r["protein_id"])
            assert (r["genome"], r["taxon"]) == of[r["protein_id"]]
        assert set(map(frozenset, got.values())) == want
        assert {(r["n_proteins"], r["n_genomes"], r["n_taxa"]) for r in members} == {(len(c), len({of[x][0] for x in c}), len({of[x][1] for x in c})) for c in want}
        edges = spark.read.parquet(f"{out}/edges").collect()
        assert sum(r["weight"] for r in edges) == len(members)
        for r in spark.read.parquet(f"{out}/transfers").collect():
            assert r["query_genome"] != r["target_genome"] and r["pident"] >= 80


@pytest.mark.parametrize("name", sorted(jobs.queries()))
def test_matches_sql(spark, name):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    df = jobs.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{DATA}/documents.parquet')")
    cur = con.execute(jobs.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr) and got
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


def test_command_lines_and_config_files(monkeypatch, tmp_path):
    calls = []

    class Session:
        def stop(self):
            calls.append("stop")

    monkeypatch.setattr("kinweave.runtime.session", lambda *_: Session())
    run = lambda spark, *rest: calls.append(rest)
    own = tmp_path / "own.json"
    own.write_text(json.dumps({"min_pident": 70.0, "words": 4}))
    assert common.main("x", new_hits.Config, own, {"records": "", "output": "", "checkpoint": ""}, run, ["a", "b", "c", "--words", "3"]) == 0
    assert calls == [("a", "b", "c", new_hits.Config(min_pident=70.0, words=3)), "stop"]
    own.write_text(json.dumps({"colour": 1}))
    assert common.main("x", new_hits.Config, own, {"records": ""}, run, ["a"]) == 1
    for job in (new_hits, shared_clusters):
        assert common.config_of(job.Config, job.__file__.replace(".py", ".json")) == job.Config()


def test_sets_are_made_where_the_text_is(spark):
    """The sets of ``feature_sets``, frequent features last, without a shuffle of all features; copies by keys alone."""
    from pyspark.sql import functions as F

    from kinweave.operators.similarity import distinct_sets, feature_sets, frequent_last, hashed_sets, shingles
    from kinweave.runtime import materialize

    texts = [("a", "one two three four five six one two three four five"), ("b", "one two three four five"), ("c", "one two three four five"), ("d", "short"), ("e", None), ("f", "six seven eight nine ten one two three four five")]
    docs = spark.createDataFrame([(k, t, k * 2) for k, t in texts], "id string, body string, note string")
    features = shingles(docs, "id", "body")
    often = materialize(features.groupBy(F.xxhash64("shingle").alias("h")).agg(F.count("*").alias("df")).where("df > 1"), "often")
    hashed = hashed_sets(docs, "id", "body", keep=("note",))
    assert "Exchange" not in hashed._jdf.queryExecution().executedPlan().toString()
    sets = materialize(frequent_last(hashed, often), "sets")
    assert sorted(map(tuple, sets.select("name", "size", "s").collect())) == sorted(map(tuple, feature_sets(features, often).collect()))
    own, copies = distinct_sets(sets)
    assert sorted((r["name"], r["note"]) for r in own.collect()) == [("a", "aa"), ("b", "bb"), ("f", "ff")] and [tuple(r) for r in copies.collect()] == [("c", "b")]


def test_no_job_writes_or_shuffles_whole_texts(spark, tmp_path, monkeypatch):
    """Texts stay where they are read; of rows with one id the least text counts."""
    from pyspark.sql import functions as F

    tables = []
    for job in (new_hits, shared_clusters):
        monkeypatch.setattr(job, "materialize", lambda df, tag, own=job.materialize: tables.append((tag, df.columns)) or own(df, tag))
    records = str(tmp_path / "records")
    add(spark, made_rows(5, 40) + [(3, "a b c d e f g", "g1", "x")], records)
    new_hits.take(spark.read.parquet(records), 0, str(tmp_path / "hits"), new_hits.Config())
    shared_clusters.run(spark, records, str(tmp_path / "clusters"))
    assert len(tables) > 6 and not [t for t in tables if "text" in t[1]]
    rows = spark.createDataFrame([(1, "b", "g"), (1, "a", "h"), (2, "c", None)], "id long, text string, genome string")
    assert sorted(map(tuple, common.one_of_each(rows, F.col("id").cast("string"), F.struct("text", "genome")).collect())) == [("1", "a", "h"), ("2", "c", None)]


def test_frequent_features_are_counted_exactly(spark, monkeypatch):
    from kinweave.operators import similarity

    monkeypatch.setattr(similarity, "BUCKET_BITS", 3)  # buckets that hold several features
    sets = spark.createDataFrame([(k, [h * (1 << 58) + k + 100 for h in range(8)] + [7, -9][: 1 + k % 2]) for k in range(20)], "name int, s array<bigint>")
    assert sorted(map(tuple, similarity.frequent_features(sets, 5).collect())) == [(-9, 10), (7, 20)]


def test_transfers_are_of_all_records(spark, tmp_path):
    """Copies count too: a pair of taxa that only copies have, and links whose first records are of one genome."""
    same, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(59)) + " end"
    rows = [(10, same, "g1", "a"), (11, same, "g2", "b"), (12, same, "g3", "c"), (13, same, "g1", "d"), (20, other, "g1", "e"), (21, other, "g1", "f")]
    add(spark, rows, str(tmp_path / "records"))
    shared_clusters.run(spark, str(tmp_path / "records"), str(tmp_path / "out"))
    got = {r["taxon_pair"]: (r["query"], r["target"], round(r["pident"], 3)) for r in spark.read.parquet(str(tmp_path / "out/transfers")).collect()}
    of, own = {str(r[0]): r for r in rows}, sets_of(rows)
    want = {}
    for a, b in sorted(links(rows), key=lambda p: (-len(own[p[0]] & own[p[1]]) / len(own[p[0]] | own[p[1]]), p)):
        if of[a][2] != of[b][2]:
            want.setdefault("-".join(sorted((of[a][3], of[b][3]))), (a, b, round(100 * len(own[a] & own[b]) / len(own[a] | own[b]), 3)))
    assert got == want and {"b-c", "b-e", "c-f"} <= set(got)
