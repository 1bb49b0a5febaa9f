from sylva.llm import quality


def test_training_sees_whole_texts(spark, monkeypatch):
    bags = []
    monkeypatch.setattr(quality, "fit", lambda x, y: bags.extend(x))
    text = " ".join(["plain words"] * 5000) + " " + "||| " * 200
    docs = spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string")
    quality.train(docs, spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, quality int"))
    assert bags
    assert all(len(x) == -(-10_200 // quality.PASSAGE) for x in bags)
    assert all(x[-1, 7] == 1 for x in bags)
