import pytest

from spanwise.operators import checks as C


@pytest.fixture()
def gaps(table):
    return table("a int, b int", (1, None), (2, 2), (None, 3), (None, 4), (None, None))


def test_missing(gaps, table):
    assert C.num_missing(gaps, "a") == 3
    assert C.num_missing(gaps, "b") == 2
    assert C.num_missing(gaps, ["a", "b"]) == 5
    assert C.num_missing(gaps.filter("a > 99"), ["a", "b"]) == 0
    assert C.check_size_missing(gaps, "a", ">", 2)
    assert not C.check_size_missing(gaps, ["a", "b"], "==", 4)
    with pytest.raises(AssertionError, match="missing"):
        C.assert_size_missing(gaps, "a", "==", 0)


def test_sizes(gaps):
    assert C.num_rows(gaps) == 5
    for direction, size, holds in (("==", 5, True), ("<", 5, False), (">", 4, True), ("<=", 5, True), (">=", 6, False), ("!=", 1, True)):
        assert C.check_size(gaps, direction, size) is holds
    assert C.check_size_comparison(gaps, ">", gaps.filter("a = 1"))
    with pytest.raises(AssertionError, match="rows"):
        C.assert_size(gaps, ">", 1000)
    with pytest.raises(AssertionError, match="rows"):
        C.assert_size_comparison(gaps, "!=", gaps)
    with pytest.raises(ValueError):
        C.check_size(gaps, "=>", 5)


def test_uniques(table):
    df = table("uu int, vv string", (1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "c"), (6, "b"))
    assert C.num_unique(df, "uu") == 6
    assert C.num_unique(df, "vv") == 3
    assert C.check_all_unique(df, "uu")
    assert not C.check_all_unique(df, "vv")
    assert C.check_all_unique(df, ["uu", "vv"])
    assert C.check_size_uniques(df, "vv", "==", 3)
    with pytest.raises(AssertionError, match="unique"):
        C.assert_all_unique(df, "vv")
    with pytest.raises(AssertionError, match="unique"):
        C.assert_size_uniques(df, "vv", ">", 3)
    with pytest.raises(ValueError, match="zz"):
        C.num_unique(df, "zz")


def test_null_is_a_value(gaps):
    assert C.num_unique(gaps, "a") == 3


def test_join_covered(table):
    df1 = table("a int, b int", (1, 1), (2, 2), (3, 3), (4, 1), (5, 2))
    df2 = table("a int, z int", (1, 3), (2, 3), (3, 2), (4, 3), (4, 2))
    assert C.check_join_covered(df2, df1, "a")
    assert not C.check_join_covered(df1, df2, "a")
    assert C.check_join_covered(df2, df1, {"z": "b"})
    assert not C.check_join_covered(df1, df2, {"b": "z"})
    with pytest.raises(AssertionError, match="covered"):
        C.assert_join_covered(df1, df2, "a")


def test_join_covered_two_keys(table):
    df1 = table("a int, b int, a2 int", (1, 1, 3), (2, 2, 3), (3, 3, 2), (4, 1, 3), (5, 2, 2), (4, 2, 2))
    df2 = table("y int, z int", (1, 3), (2, 3), (3, 2), (4, 3), (4, 2))
    assert C.check_join_covered(df2, df1, {"y": "a", "z": "a2"})
    assert not C.check_join_covered(df1, df2, {"a": "y", "b": "z"})


SPANS = "id int, s date, e date, extra string"


def test_overlap_depends_on_group(table):
    df = table(
        SPANS,
        (1, "2010-01-01", "2010-06-06", "a"),
        (1, "2011-01-01", "2015-01-01", "b"),
        (2, "2013-01-01", "2013-06-06", "d"),
        (2, "2014-01-01", "2014-06-06", "b"),
    )
    assert not C.check_no_date_overlap(df, "s", "e")
    assert not C.check_no_date_overlap(df, "s", "e", "extra")
    assert C.check_no_date_overlap(df, "s", "e", "id")
    assert C.check_no_date_overlap(df, "s", "e", ["id", "extra"])
    with pytest.raises(AssertionError, match="overlap"):
        C.assert_no_date_overlap(df, "s", "e")


def test_equal_and_touching_spells_overlap(table):
    same = table(SPANS, (1, "2010-01-01", "2010-06-06", ""), (2, "2010-01-01", "2010-06-06", ""))
    assert not C.check_no_date_overlap(same, "s", "e")
    assert C.check_no_date_overlap(same, "s", "e", "id")
    touching = table(SPANS, (1, "2010-01-01", "2010-06-06", ""), (1, "2010-06-06", "2011-01-01", ""))
    assert not C.check_no_date_overlap(touching, "s", "e")
    adjacent = table(SPANS, (1, "2010-01-01", "2010-06-06", ""), (1, "2010-06-07", "2011-01-01", ""))
    assert C.check_no_date_overlap(adjacent, "s", "e")


def test_long_spell_is_remembered_past_a_short_one(table):
    df = table(
        SPANS, (1, "2010-01-01", "2012-01-01", ""), (1, "2010-02-01", "2010-02-05", ""), (1, "2011-01-01", "2011-02-01", "")
    )
    assert C.date_overlaps(df, "s", "e", "id").count() == 2
