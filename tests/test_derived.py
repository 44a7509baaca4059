import os
import shutil
import time

import pytest

from tidewire.plans import QUERIES
from tidewire.sources import derived as dv

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_changed_tables_give_new_rows_in_the_same_session(spark, tmp_path):
    for t in ("lineitem", "orders", "nation"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    calls = lambda: sum(r[1] for r in QUERIES["a01_calls_per_stop"](spark, str(tmp_path)).select("stop_id", "calls").collect())
    first = calls()
    assert calls() == first
    half = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey % 2 = 0").toPandas()
    os.remove(tmp_path / "lineitem.parquet")
    half.to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    after = calls()
    assert 0 < after < first


def test_reuse_by_version_scope_sources_extent_and_age(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("1")
    made = []

    def make():
        made.append(1)
        return spark.range(len(made), len(made) + 1)

    def ask(**more):
        table, there = dv.derived(spark, "numbers", [str(source)], make, **more)
        return table.first()[0], there

    assert ask() == (1, False) and ask() == (1, True)
    assert ask(version="2") == (2, False) and ask(scope="x") == (3, False) and ask() == (1, True)
    assert ask(scope="a", extent=(0, 0, 9, 9)) == (4, False)
    assert ask(scope="a", extent=(1, 1, 9, 9)) == (4, True) and ask(scope="a", extent=(1, 1, 10, 9)) == (5, False) and ask(scope="a") == (6, False)
    assert ask(scope="a", extent=(-5, 0, 1, 1)) == (6, True)
    time.sleep(0.3)
    assert ask(most_age_s=0.2) == (7, False) and ask(most_age_s=60) == (7, True)
    dv._known.clear()  # as another session would find them
    assert ask(scope="x") == (3, True)
    source.write_text("12")
    assert ask(scope="x") == (8, False) and ask(scope="x") == (8, True)
    assert {r.scope for r in dv.superseded(dv.entries(spark).where("name = 'numbers'")).collect()} == {"x"}
    for (*_, scope, _, _, _), (place, _) in list(dv._known.items()):
        if scope == "x":
            shutil.rmtree(place.removeprefix("file:"))
    assert ask(scope="x") == (9, False)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_a_search_reads_one_part_of_the_index_a_word(spark):
    from pyspark.sql import functions as F

    from tidewire.operators import search
    from tidewire.plans.search_queries import _index, _parts

    stored, parts = _index(spark, SF), _parts(spark, SF)
    plain = search.tokens(parts, "p_partkey", "p_name")
    for typed in ("small", "smlal bo", "idg", "w", "bolt cold", "zzz", "3", "é"):
        found = search.search_stops(stored, parts, "p_partkey", typed, "p_size")
        assert found.collect() == search.search_stops(plain, parts, "p_partkey", typed, "p_size").collect(), typed
    plan = search.search_stops(stored, parts, "p_partkey", "smlal bo", "p_size")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(letter") >= 2
    one = stored.where(F.col("letter") == "b")
    assert {f.split("letter=")[1][0] for f in (r[0] for r in one.select(F.input_file_name()).distinct().collect())} == {"b"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_bucketed_tables_meet_without_a_shuffle(spark):
    from tidewire.plans.more_queries import _bucketed_calls

    plan = _bucketed_calls(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
