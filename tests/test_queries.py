import pytest

import __spark_entry__ as entry
from oracle import compare, connect

ROOT = "/root/testdata/sf0.001"
FAST = [n for n in entry.oracle_sql() if n[0] in "befghiknqr" and not n.startswith(("r06", "r08", "r11", "q03"))]


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", FAST + ["d01_label_components_8", "d17_false_indications", "c01_gaussian", "s01_stroke_labels", "s03_live_counters"])
def test_query_matches_its_sql(spark, con, name):
    problem, _ = compare(entry.queries()[name](spark, ROOT), con, entry.oracle_sql()[name])
    assert problem is None, problem


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    from rasterloom.sources import tables as T

    text = plan(T.scores(spark, ROOT).filter("pa > 0.5").select("image_id"))
    assert "text:string" not in text
    li = plan(T.table(spark, ROOT, "lineitem").filter("l_quantity > 40").select("l_suppkey"))
    assert "GreaterThan(l_quantity,40.0)" in li and "l_extendedprice" not in li.split("ReadSchema")[1]


def test_no_cartesian_products_in_normalisation(spark):
    for name in ("b01_robust_normalize", "b05_stretch_u8"):
        text = plan(entry.queries()[name](spark, ROOT))
        assert "Exchange" not in text and "Cartesian" not in text
