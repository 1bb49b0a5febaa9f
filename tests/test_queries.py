"""Every document query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sylva import queries as q
from sylva.operators.select import select
from sylva.operators.transform import transform
from sylva.operators.validate import validate

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def rows(frame):
    return sorted(repr([None if x is None or x != x else x.item() if hasattr(x, "item") else x for x in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query(spark, duck, name):
    got, want = q.QUERIES[name](spark, DATA).toPandas(), duck.execute(q.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_filters_reach_the_scan(spark):
    df = select(spark.read.parquet(f"{DATA}/events.parquet"), {"event_type": "view", "user_id": {"`$GT`": 5}})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,view)" in plan
    assert "GreaterThan(user_id,5)" in plan


def test_template_prunes_columns(spark):
    plan = transform(spark.read.parquet(f"{DATA}/events.parquet"), {"x": "`user_id`"})._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint>" in plan


def test_null_and_absent(spark):
    df = spark.createDataFrame([(1, '{"a":null}'), (2, '{"a":1}'), (3, "{}")], "i int, j string").select("i", F.parse_json("j").alias("d"))
    ids = lambda x: sorted(r.i for r in select(df, {"d": x}).collect())
    assert ids({"a": None}) == [1, 3]
    assert ids({"`$NOT`": {"a": 1}}) == [1, 3]
    assert ids({"a": {"`$GT`": 0}}) == [2]
    assert ids({}) == [1, 2, 3]


def test_strict_validation_raises(spark):
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(Exception, match="Expected field a to be integer, but found string: x"):
        validate(df, {"a": 1}, strict=True).collect()


def test_streams(spark, tmp_path):
    from sylva.streaming.select import pipeline, to_memory

    src = spark.read.parquet(f"{DATA}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    out = pipeline(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), {"event_type": "view"}, {"id": "`event_id`"})
    to_memory(out, "seen")
    assert spark.table("seen").count() == src.where("event_type = 'view'").count()
