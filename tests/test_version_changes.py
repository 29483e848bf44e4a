"""What versions change, field by field."""

from quillstack.operators import memory


def test_changes_with_nulls_and_first_versions(spark):
    rows = [("a", 1, "x", None), ("a", 2, "x", 5), ("a", 3, "y", None), ("b", 1, None, None), ("b", 2, None, 1)]
    got = memory.version_changes(spark.createDataFrame(rows, "lineage string, version int, title string, level int"), ["title", "level"]).collect()
    assert sorted(map(tuple, got), key=str) == [
        ("a", 1, "title", None, "x"),
        ("a", 2, "level", None, "5"),
        ("a", 3, "level", "5", None),
        ("a", 3, "title", "x", "y"),
        ("b", 2, "level", None, "1"),
    ]
