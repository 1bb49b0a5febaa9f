from sylva.operators.walk import leaves, walk


def test_walk_has_no_limit_of_rows(spark):
    docs = spark.range(260_000).selectExpr("id", "parse_json('{\"a\":1,\"b\":[2,3]}') AS v")
    assert walk(docs, "v", ["id"]).count() == 5 * 260_000
    assert leaves(docs, "v", ["id"]).count() == 3 * 260_000
