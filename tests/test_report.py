"""The report: five parts that appear together, or the last one stays."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from folioframe.sources import report as R
from folioframe.sources.manifests import Conflict, Manifests


def tables(spark, n=3):
    tasks = spark.createDataFrame([(i, f"t{i}", 1, date(2024, 3, i + 1), "x", 50.0, "w", "f", 1.5) for i in range(n)], "id long, title string, assigned_to_id long, deadline date, status string, progress double, workspace_name string, field string, point double")
    staff = spark.createDataFrame([(1, "p1"), (2, "p2")], "id long, full_name string")
    updates = spark.createDataFrame([(7, 0, datetime(2024, 3, 1), 10.0), (8, 99, datetime(2024, 3, 2), 20.0)], "update_id long, task_id long, ts timestamp, progress double")
    files = spark.createDataFrame([(1, "a.txt"), (99, "b.txt")], "task_id long, file_name string")
    log = spark.createDataFrame([], "at timestamp, what string")
    return R.parts(tasks, staff, updates, files, log, F.lit("2024-03-10").cast("date"))


def counts(report):
    return {name: df.count() for name, df in report.items()}


@pytest.mark.parametrize("form", ["parquet", "csv"])
def test_five_parts(spark, tmp_path, form):
    folder = str(tmp_path / "r")
    assert R.read(spark, folder) == {}
    parts = tables(spark)
    assert R.export(spark, parts, folder, form, "first") == 1
    back = R.read(spark, folder)
    assert tuple(back) == R.PARTS and counts(back) == {"tasks": 3, "kpi": 2, "timeline": 1, "evidence": 1, "audit": 0}
    for name, df in parts.items():
        assert back[name].columns == df.columns and sorted(map(tuple, back[name].collect())) == sorted(map(tuple, df.collect())), name


def test_a_failing_part_leaves_the_report_before(spark, tmp_path):
    folder = str(tmp_path / "r")
    R.export(spark, tables(spark), folder)
    broken = {**tables(spark, 5), "evidence": spark.range(2).select(F.raise_error(F.lit("boom")).cast("string").alias("x"))}
    with pytest.raises(Exception, match="boom"):
        R.export(spark, broken, folder)
    assert counts(R.read(spark, folder))["tasks"] == 3 and Manifests(spark, folder).versions() == [1]
    assert R.export(spark, tables(spark, 5), folder) == 2
    assert counts(R.read(spark, folder))["tasks"] == 5 and counts(R.read(spark, folder, 1))["tasks"] == 3
    # The failed export's parts and the first report go; the last is whole.
    assert R.vacuum(spark, folder) == 2 and counts(R.read(spark, folder))["tasks"] == 5 and R.vacuum(spark, folder) == 0


def test_a_number_is_given_once(spark, tmp_path):
    held = Manifests(spark, str(tmp_path / "r"))
    held.commit(1, {"a": "ü"})
    with pytest.raises(Conflict):
        held.commit(1, {"a": "other"})
    assert held.read(1) == {"a": "ü"} and held.versions() == [1]
    with pytest.raises(ValueError, match="not xlsx"):
        R.export(spark, {}, str(tmp_path / "r"), "xlsx")
