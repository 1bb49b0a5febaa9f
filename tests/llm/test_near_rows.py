from collections import Counter

from sylva.llm import neardup


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{n}{i}" for i in range(30)) for n in "abc")
    rows = [(7, a), (7, a), (7, a), (None, b), (None, b), (3, c), (9, c), (9, "other text that is clean and long enough"), (None, c), (5, None), (6, None), (8, ""), (1, "one"), (1, "two")]
    kept = neardup.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(7, a), (None, b), (3, c), (9, rows[7][1]), (5, None), (6, None), (8, ""), (1, "one"), (1, "two")]
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(want)
