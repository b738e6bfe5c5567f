"""Reports go through the changes once."""

import pytest

from annalist.operators import reports

AS_OF = 1_767_225_600


@pytest.fixture
def counted(spark, make_history):
    """A history of eight changes, and how many rows of them were read."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    changes = [
        ("f", "a.py", f"c{i}", "modified" if i else "added", 2, 1, "Ada" if i % 2 else "Bob", AS_OF - i * 86400 * 40, "m") for i in range(8)
    ]
    h = make_history(
        commits=[(f"c{i}", "Ada", AS_OF - i * 86400 * 40, "m", 1) for i in range(8)],
        functions=[("f", "a.py", "python", 1, 5, "function", "def f():", "")],
        function_changes=changes,
        blame_entries=[("f", "a.py", "Ada", 3, 60.0, "c1"), ("f", "a.py", "Bob", 2, 40.0, "c2")],
    )
    rows = h.function_changes
    return h.with_tables(function_changes=rows.mapInPandas(count, rows.schema)), read


def test_executive_facts_read_the_changes_once(counted):
    h, read = counted
    row = reports.executive_facts(h, AS_OF).first()
    assert (row["functions"], row["commits"], row["changes"], row["fragile"], row["contributors"]) == (1, 8, 8, 1, 2)
    assert read.value == 8


def test_executive_facts_leave_blame_alone(counted):
    h, _ = counted
    assert reports.executive_facts(h.with_tables(blame_entries=None), AS_OF).first()["changes"] == 8


def test_summary_reads_the_changes_once(counted):
    h, read = counted
    sections = {name: rows.collect() for name, rows in reports.summary(h, AS_OF).items()}
    assert [r["changes"] for r in sections["hotspots"]] == [8]
    assert sections["stats"][0]["blame_entries"] == 2
    assert read.value == 8


def test_report_data_reads_the_changes_once(counted):
    h, read = counted
    sections = {name: rows.collect() for name, rows in reports.report_data(h, AS_OF).items()}
    assert [r["change_count"] for r in sections["fragile_zones"]] == [8]
    assert sections["executive_facts"][0]["fragile"] == 1
    assert read.value == 8
