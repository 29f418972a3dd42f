import pytest
from conftest import rows

from spanwise.operators import reshape as R
from spanwise.sources import tables as IO

LONG = "who string, label string, value double"


def test_pivot(table):
    df = table(LONG, ("bob", "age", 10.0), ("alice", "age", 12.0), ("bob", "height", 150.0), ("alice", "height", 160.0))
    expected = [("alice", 12.0, 160.0), ("bob", 10.0, 150.0)]
    assert rows(R.pivot_long(df, "label", "value"), "who", "age", "height") == expected
    assert rows(R.pivot_long(df, "label", "value", labels=["age", "height"]), "who", "age", "height") == expected


def test_pivot_adds_and_leaves_absent_cells_null(table):
    df = table(LONG, ("bob", "sex=1", 10.0), ("bob", "sex=1", 5.0), ("alice", "a b", 1.0))
    assert rows(R.pivot_long(df, "label", "value"), "who", "sex=1", "a b") == [("alice", None, 1.0), ("bob", 15.0, None)]
    with pytest.raises(ValueError):
        R.pivot_long(df, "label", "value", "median")


def test_union_keeps_copies_and_matches_by_name(table):
    a, b = table("x int, y int", (1, 2), (1, 2)), table("y int, x int, z int", (2, 1, 9))
    assert rows(R.union_all(a, b, ["x", "y"])) == [(1, 2)] * 3
    with pytest.raises(ValueError, match="z"):
        R.union_all(a, b, ["z"])


def test_collapse_indicators(table):
    df = table("id int, v_a int, v_b int, v_c int", (1, 1, 0, 0), (2, 0, 1, 2), (3, 0, 0, 2))
    assert rows(R.collapse_indicators(df, "v_", [1, 2], label="v"), "id", "v") == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(R.collapse_indicators(df, "v_", [1]), "id", "v_")[2] == (3, None)
    with pytest.warns(UserWarning):
        assert R.collapse_indicators(df, "nothing", [1]).columns == df.columns
    with pytest.raises(ValueError):
        R.collapse_indicators(df, "v_", [])


def test_write_append_read(spark, table, tmp_path):
    path = str(tmp_path / "t")
    df = table("number int, day date, text string", (1, "2001-01-01", "a"), (2, "2001-01-02", None), (3, "2001-01-03", "c"))
    IO.write_table(df.limit(0), path)
    assert IO.read_table(spark, path).count() == 0
    assert IO.append_table(df.select("text", "day", "number"), path, df.columns).count() == 3
    assert rows(IO.read_table(spark, path)) == rows(df)
    with pytest.raises(Exception, match="exist|EXISTS"):
        IO.write_table(df, path)
    assert IO.write_table(df.limit(1), path + "2", overwrite=True).count() == 1
    with pytest.raises(ValueError, match="missing_col"):
        IO.append_table(df, path, ["missing_col"])
    with pytest.raises(ValueError, match="no_such_table"):
        IO.read_table(spark, "no_such_table")


def test_scratch_follows_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert IO.scratch_path(spark, "x").startswith(shared)
    stored = IO.materialise(spark.range(10), "id")
    assert stored.count() == 10
    assert stored.inputFiles()[0].startswith("file://" + shared)


def test_view_sample_report(spark, table, tmp_path):
    df = table("id int, v int", *[(i, i) for i in range(300)])
    assert IO.create_view(df, "some_view", overwrite=True).count() == 300
    assert rows(IO.dev_sample(df, "id"), "id") == [(0,), (100,), (200,)]
    IO.write_report(df, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 300
