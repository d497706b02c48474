"""Flat files of many records: read in splits, whole records in each."""

from __future__ import annotations

from kinweave.sources import files


def record(k):
    gap = "\n" + " " * 21
    bases = "".join("acgt"[(k * 7 + j * j) % 4] for j in range(60 + k % 50))
    lines = "".join(f"\n{j + 1:>9} " + " ".join(bases[j + i : j + i + 10] for i in range(0, 60, 10) if j + i < len(bases)) for j in range(0, len(bases), 60))
    return f"LOCUS       A{k}\nDEFINITION  see http://x.org//y\nACCESSION   A{k}\nFEATURES             Location/Qualifiers\n     CDS             complement(join(1..9,{gap}13..18)){gap}/note=\"a//b{gap}c\"{gap}/protein_id=\"P{k}\"\nORIGIN{lines}\n//\n", bases


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    made = [record(k) for k in range(3000)]
    path = tmp_path / "all.gbk"
    path.write_text("".join(r for r, _ in made) + "\n")
    (tmp_path / "none.gbk").write_text("\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        d = files.read_genbank(spark, str(tmp_path))
        assert d.rdd.getNumPartitions() > 20
        got = {r["accession"]: r for r in d.collect()}
        proteins = {r["protein_id"]: r["sequence"] for r in files.genbank_proteins(d).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 3000 and all(got[f"A{k}"]["sequence"] == b for k, (_, b) in enumerate(made))
    assert all(r["features"][0]["location"] == "complement(join(1..9,13..18))" and r["features"][0]["qualifiers"]["note"] == "a//b c" for r in got.values())
    for k, (_, bases) in enumerate(made):
        dna = (bases[:9] + bases[12:18])[::-1].translate(str.maketrans("acgt", "tgca"))
        assert proteins[f"P{k}"] == files.translate_dna(dna)


def test_first_hits_are_those_of_the_first_file(spark, tmp_path):
    """A reader takes larger files first; the first rows are those of the first name."""
    from kinweave.sources.files import read_hits

    for k, n in enumerate((2, 50, 400)):
        (tmp_path / f"part-0000{k}.csv").write_text("query\ttarget\tpident\talnlen\tevalue\tbits\n" + "".join(f"q{k}{i:04d}\tt\t90.0\t1\t0.0\t5.0\n" for i in range(n)))
    assert [r["query"] for r in read_hits(spark, str(tmp_path), max_rows=4).collect()] == ["q00000", "q00001", "q10000", "q10001"]
