"""Sessions without settings, as a fresh installation has them."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
from kinweave.runtime import drop_scratch, materialize, session, shared_folder
spark = session("fresh", spark__ui__enabled="false", spark__master="local[2]", spark__sql__shuffle__partitions="2")
assert spark.conf.get("spark.checkpoint.dir", None) is None
t = materialize(spark.range(5), "x")
assert t.count() == 5 and shared_folder(spark) == shared_folder(spark) and shared_folder(spark) in t.inputFiles()[0]
drop_scratch(t)
from kinweave.plans import cli
sys.exit(cli.main([sys.argv[1], "--min_identity", "0.3"]))
"""


def test_a_fresh_installation_runs_an_analysis(tmp_path):
    data = tmp_path / "set"
    (data / "00_input").mkdir(parents=True)
    base = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVKALPDAQFEVVHSLAKWKRQTLGQHDFSAGEGLYTHMKALRPDEDRLSPLHSVYVDQWDWERVMG"
    names = ["Aa bb", "Cc dd", "Ee ff", "Gg hh"]
    rows = [f"{n.replace(' ', '_')} {base[:k] + 'W' * k + base[2 * k :]}" for k, n in enumerate(names, 1)]
    (data / "00_input" / "inputfile").write_text(f"{len(rows)} {len(base)}\n" + "\n".join(rows) + "\n")
    names = [r.split()[0] for r in rows]
    (data / "00_input" / "tree.newick").write_text(f"(({names[0]}:1,{names[1]}:1):1,({names[2]}:1,{names[3]}:1):1);")
    empty = tmp_path / "conf"
    empty.mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_SUBMIT")} | {"SPARK_CONF_DIR": str(empty), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(data)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stdout[-2000:] + done.stderr[-3000:]
    assert (data / "06_hgt" / "hgt_scores").exists()


def folders(spark):
    from kinweave.runtime import shared_folder

    root = Path(shared_folder(spark).removeprefix("file:"))
    return {p.name for p in root.iterdir() if p.name.startswith("kinweave-")} if root.exists() else set()


def test_scopes_delete_what_no_result_reads(spark):
    import pytest

    from kinweave.runtime import drop_scratch, materialize, scratch_scope

    before = folders(spark)
    with scratch_scope() as outer:
        with scratch_scope() as inner:
            a, b = materialize(spark.range(5), "a"), materialize(spark.range(7), "b")
            got = inner.keep(a.join(a.select("id"), "id").where("id > 1"))
            assert b.count() == 7
        assert len(folders(spark) - before) == 1 and got.count() == 3
        more = outer.keep(got.union(materialize(spark.range(2), "c")))
    assert len(folders(spark) - before) == 2 and more.count() == 5
    drop_scratch(more)
    assert folders(spark) == before
    with pytest.raises(ZeroDivisionError), scratch_scope() as scratch:
        scratch.keep(materialize(spark.range(3), "d"))
        raise ZeroDivisionError
    assert folders(spark) == before
    assert materialize(spark.range(3), "free").count() == 3 and len(folders(spark) - before) == 1


def test_no_table_is_left_after_a_query(spark):
    from kinweave.plans import queries as network
    from kinweave.runtime import drop_scratch

    before = folders(spark)
    for name in ("gra_04_reduced_nodes", "agg_15_describe", "sta_02_bootstrap_quantile", "aln_04_jaccard_join", "sco_07_ranking_th"):
        df = network.queries()[name](spark, "/root/testdata/sf0.001")
        assert df.collect()
        drop_scratch(df)
        assert folders(spark) == before, name
