"""Views in the order their SQL asks for, and tables of which only changed partitions are rewritten."""

import os

import pytest
from pyspark.sql import functions as F

from concord.sources import datasets as S

pytestmark = pytest.mark.usefixtures("interpreted")


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        ("SELECT * FROM a", {"a"}),
        ("select x from a, b c, `d e` join f using (x), g where x in (select y from h) and z = 'from i'", {"a", "b", "d e", "f", "g", "h"}),
        ("WITH t AS (SELECT * FROM a), u AS (SELECT * FROM t) SELECT * FROM t JOIN u ON t.x = u.x", {"a"}),
        ("SELECT a.x, b FROM db.a -- FROM b\n JOIN /* c */ d ON a.x = d.x GROUP BY a.x, b ORDER BY e", {"db.a", "d"}),
        ("SELECT max(x, y) FROM (SELECT x, y FROM a UNION ALL SELECT x, y FROM b), c", {"a", "b", "c"}),
        ("SELECT 'it''s FROM x', \"FROM y\" FROM A LEFT JOIN LATERAL (SELECT 1)", {"a"}),
        ("SELECT 1", set()),
    ],
)
def test_relations(sql, expected):
    assert S.relations(sql) == expected


def test_views_in_any_order(spark):
    views = {
        "v_top": "SELECT n * 10 AS n FROM v_middle, v_base WHERE n = k",
        "v_middle": "SELECT k + 0 AS n FROM V_BASE",
        "v_base": "SELECT id AS k FROM range(4)",
    }
    try:
        assert S.materialize_views(spark, views) == ["v_base", "v_middle", "v_top"]
        assert sorted(r.n for r in spark.table("v_top").collect()) == [0, 10, 20, 30]
        # a second refresh reads the new v_base, not the one that is stored
        views["v_base"] = "SELECT id + 100 AS k FROM range(1)"
        S.materialize_views(spark, views)
        assert [r.n for r in spark.table("v_top").collect()] == [1000]
    finally:
        for name in views:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_circles_are_named():
    with pytest.raises(ValueError, match="a -> b -> c -> a|b -> c -> a -> b|c -> a -> b -> c"):
        S.view_order({"a": "SELECT * FROM b", "b": "SELECT * FROM c", "c": "SELECT * FROM a", "d": "SELECT * FROM a"})


def table_of(spark, path, n=200, buckets=50):
    rows = spark.range(n).select(F.col("id").alias("k"), F.lit("old").alias("v"), (F.col("id") % buckets).cast("int").alias("bucket"))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(path)


def stored(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_one_changed_key_rewrites_one_of_fifty_files(spark, tmp_path):
    path = str(tmp_path / "t")
    table_of(spark, path)
    before = stored(path)
    new = spark.createDataFrame([(7, "new", 7, 1), (7, "newer", 7, 2), (1007, "added", 7, 1)], "k bigint, v string, bucket int, at int")
    with pytest.raises(Exception):  # noqa: B017, PT011
        S.upsert_partitions(spark, path, new, ["k"], ["at"], ["bucket"])  # the order column is none of the table's
    S.upsert_partitions(spark, path, new.withColumn("v", F.concat("v", F.lit("!"))), ["k"], ["v"], ["bucket"])
    after = stored(path)
    assert len(before) == 50 and len(set(before.items()) - set(after.items())) == 1
    rows = {r.k: r.v for r in spark.read.parquet(path).collect()}
    assert len(rows) == 201 and rows[7] == "newer!" and rows[1007] == "added!" and rows[57] == "old"


def test_registering_rewrites_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    table_of(spark, path)
    before = stored(path)
    new = spark.createDataFrame([(7, "taken", 7), (1007, "b", 7), (1007, "a", 7), (2, "taken", 2)], "k bigint, v string, bucket int")
    S.register_partitions(spark, path, new, ["k"], ["v"], ["bucket"])
    assert set(before.items()) <= set(stored(path).items())
    rows = {r.k: r.v for r in spark.read.parquet(path).collect()}
    assert len(rows) == 201 and rows[1007] == "a" and rows[7] == "old"


def test_several_partition_columns_and_nulls(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, "a", "x", 1), (2, "b", None, 1), (3, "c", "y", 2)]
    schema = "k int, v string, p string, q int"
    spark.createDataFrame(rows, schema).write.partitionBy("p", "q").parquet(path)
    new = spark.createDataFrame([(2, "B", None, 1), (4, "D", "z", 9)], schema)
    S.upsert_partitions(spark, path, new, ["k"], ["v"], ["p", "q"])
    found = sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v", "p", "q").collect())
    assert found == [(1, "a", "x", 1), (2, "B", None, 1), (3, "c", "y", 2), (4, "D", "z", 9)]
