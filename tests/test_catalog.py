"""Every registered query against its SQL on the smallest sample, and the shape of plans."""

import os

import pytest
from conftest import dicts

import __spark_entry__ as entry
from annalist.operators import activity, ownership, stability
from catalog import check
from catalog.views import AS_OF, history

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")


@pytest.fixture(scope="module")
def db():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    verdict, _, _ = check.compare(spark, db, name, SF)
    assert verdict in ("ok", "no check")


def test_only_text_similarity_lacks_a_check():
    from catalog import registry

    assert sorted(set(registry.QUERIES) - set(registry.CHECKS)) == ["extracted_changes", "extracted_renames"]


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hotspots_read_only_what_they_need(spark):
    h = history(spark, SF, "function_changes")
    text = plan(activity.hotspots(h))
    assert "TakeOrderedAndProject" in text
    assert "l_extendedprice" not in text and "l_tax" not in text and "l_quantity" not in text


def test_filters_reach_the_scan(spark, tmp_path):
    h = history(spark, SF, "function_changes")
    h.function_changes.write.parquet(str(tmp_path / "c"))
    stored = h.with_tables(function_changes=spark.read.parquet(str(tmp_path / "c")))
    text = plan(activity.hotspots(stored, author="dev_1", since=AS_OF - 86400 * 100))
    assert "PushedFilters: [IsNotNull(author), IsNotNull(timestamp), EqualTo(author,dev_1)" in text
    assert "message" not in text.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("make", [
    lambda h: activity.untested_changes(h), lambda h: activity.deleted_functions(h),
    lambda h: ownership.blame_by_definition(h), lambda h: activity.coauthorship(h),
])
def test_no_pair_products(spark, make):
    h = history(spark, SF, "function_changes", "functions", "blame_lines")
    text = plan(make(h))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_only_one_row_is_joined_without_a_key(spark):
    h = history(spark, SF, "function_changes", "functions")
    text = plan(stability.scores(h, AS_OF))
    assert text.count("BroadcastNestedLoopJoin") == 1


def test_results_do_not_depend_on_partitions(spark):
    h = history(spark, SF, "function_changes")
    wide = h.with_tables(function_changes=h.function_changes.repartition(13))
    for operator in (activity.hotspots, activity.authors, activity.coauthorship, activity.untested_changes):
        assert dicts(operator(h)) == dicts(operator(wide))


def test_search_documents_are_made_in_many_tasks(spark):
    """The sample is one row group, which one task would read and make all texts of."""
    from pyspark.sql import functions as F

    from catalog.views import VIEWS

    docs = VIEWS["search_index"](spark, SF)
    for kind in ("commit", "change"):
        words = docs.filter(F.col("type") == kind).select(F.explode(F.split("content", " ")))
        assert words.rdd.getNumPartitions() >= 32
