"""Tables of versions: one step from old rows to new ones, columns that come later, scopes that are emptied."""

import pytest

from millrace.operators import versions as V

BY = ["dept", "kind"]


def rows(spark, path, **scope):
    df = V.current(spark, path, scope)
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_replacement_is_one_step(spark, tmp_path):
    path = f"{tmp_path}/t"
    old = spark.createDataFrame([(1, "a", "web"), (2, "a", "catalog"), (3, None, "web"), (4, 'b "x"/é', "web")], "id long, dept string, kind string")
    assert V.publish(old, path, BY) == 1
    assert [r[0] for r in rows(spark, path)] == [1, 2, 3, 4]
    assert rows(spark, path, dept="a", kind="web") == [(1, "a", "web")] and rows(spark, path, dept=None) == [(3, None, "web")] and rows(spark, path, dept='b "x"/é') == [(4, 'b "x"/é', "web")]
    new = spark.createDataFrame([(9, "a", "web", "n")], "id long, dept string, kind string, note string")
    staged = V.stage(new, path, BY)  # a writer lost here leaves the old rows
    assert [r[0] for r in rows(spark, path)] == [1, 2, 3, 4] and "note" not in V.current(spark, path).columns
    V.switch(new, path, BY, staged)
    assert rows(spark, path) == [(2, "a", "catalog", None), (3, None, "web", None), (4, 'b "x"/é', "web", None), (9, "a", "web", "n")]


def test_scopes_are_emptied_and_forgotten(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([(1, "a", "web"), (2, "a", "catalog")], "id long, dept string, kind string")
    V.publish(df, path, BY)
    V.publish(df.limit(0), path, BY, {"dept": "a", "kind": "web"})
    assert rows(spark, path) == [(2, "a", "catalog")] and rows(spark, path, dept="a", kind="web") == []
    before = len(V.children(spark, f"{path}/data"))
    V.forget(spark, path)
    assert rows(spark, path) == [(2, "a", "catalog")] and len(V.children(spark, f"{path}/data")) < before
    with pytest.raises(ValueError):
        V.publish(df.withColumn("id", df["dept"]), path, BY)
    with pytest.raises(ValueError):
        V.publish(df, path, ["dept"])


def test_a_torn_manifest_is_passed_over(spark, tmp_path):
    path = f"{tmp_path}/t"
    V.publish(spark.createDataFrame([(1, "a", "web")], "id long, dept string, kind string"), path, BY)
    (tmp_path / "t" / "manifest-000000000002.json").write_text('{"number": 2, "by"')
    assert rows(spark, path) == [(1, "a", "web")]
    V.publish(spark.createDataFrame([(2, "b", "web")], "id long, dept string, kind string"), path, BY)
    assert [r[0] for r in rows(spark, path)] == [1, 2]
