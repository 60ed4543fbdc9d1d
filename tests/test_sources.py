"""Round trips of survey files and project stores."""

import pytest
from pyspark.sql import functions as F

from strataframe.sources import surveys


def test_delimited(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("# survey\nx ;y; value\n1;2;3.5\n4;5;\n")
    d = surveys.read_delimited(spark, str(p))
    assert d.columns == ["x", "y", "value", "survey"]
    assert [(r.x, r.y, r.value) for r in d.orderBy("x").collect()] == [(1, 2, 3.5), (4, 5, None)]
    (tmp_path / "empty.csv").write_text("\n")
    for bad in ("empty.csv", "a.shp"):
        with pytest.raises(ValueError):
            surveys.read_delimited(spark, str(tmp_path / bad))


def test_las_wrapped_or_not(spark, tmp_path):
    head = "~Version\nVERS. 2.0 :\n~Well\nNULL. -999.25 : null value\n~Curve\nDEPT.M : depth\nGR.API : gamma\n~A\n"
    (tmp_path / "a.las").write_text(head + "1.0 50\n2.0 -999.25\n")
    (tmp_path / "b.las").write_text(head + "1.0\n50\n2.0\n-999.25\n")
    got = surveys.read_las(spark, str(tmp_path)).withColumn("well", F.element_at(F.split("well", "/"), -1))
    for well in ("a.las", "b.las"):
        rows = {(r.seq, r.curve): r.value for r in got.filter(F.col("well") == well).collect()}
        assert rows == {(0, "DEPT"): 1.0, (0, "GR"): 50.0, (1, "DEPT"): 2.0, (1, "GR"): None}


def test_traces(spark, tmp_path):
    (tmp_path / "s.txt").write_text("1,2\n3,4\n5,6\n")
    got = {r.trace: (r.x, r.amp) for r in surveys.read_traces(spark, str(tmp_path), 0.004, 10.0).collect()}
    assert got == {0: (0.0, [1.0, 3.0, 5.0]), 1: (10.0, [2.0, 4.0, 6.0])}


def test_project_and_history(spark, tmp_path):
    cells = spark.createDataFrame([("g", 0, 0, 0.0, 0.0, 2.0), ("g", 0, 1, 1.0, 0.0, 4.0)], "grid_id string, i int, j int, x double, y double, value double")
    surveys.save_project({"layers": cells}, str(tmp_path / "p"))
    back = surveys.load_project(spark, str(tmp_path / "p"), ["layers"])["layers"]
    assert sorted(back.collect()) == sorted(cells.collect())
    surveys.append_history(surveys.history_entry(cells, "upward", "raw", "g", {"height": 5}, 1.5), str(tmp_path / "h"))
    surveys.append_history(surveys.history_entry(cells, "flip", "g", "f", {}, 0.1), str(tmp_path / "h"))
    report = surveys.layer_report(cells, spark.read.parquet(str(tmp_path / "h"))).first()
    assert (report.n, report.mean, report.method) == (2, 3.0, "upward")
    names = spark.createDataFrame([("a",), ("a (2)",), ("b",)], "name string")
    assert [surveys.unique_name(names, n) for n in ("a", "b", "c")] == ["a (3)", "b (2)", "c"]
    surveys.write_grid(cells, str(tmp_path / "g"), "raw", "nT")
    assert surveys.section_table(spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "trace int, k int, amp double"), [0, 1], 0.004).first().asDict() == {"tr0": 1.0, "tr1": 2.0, "time": 0.0}
