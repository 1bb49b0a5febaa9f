import numpy as np

from sylva.llm import langid

SAMPLE = [("en", "some plain words of this language"), ("de", "einige schlichte Wörter der Sprache")]


def test_texts_without_a_letter_are_und(spark):
    texts = ["12 – 34 €", "“…”", " 5 6", "😀 👍🏽", "१२", "12 ä", "слово", "語"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred != "und" for r in langid.identify(docs, SAMPLE).collect()}
    assert got == {0: False, 1: False, 2: False, 3: False, 4: False, 5: True, 6: True, 7: True}
    assert sorted(r.doc_id for r in langid.keep_identified(docs).collect()) == [5, 6, 7]


def test_symbols_tell_scripts_apart():
    texts = ["а", "ذ", "क", "ɰ", "ΰ", "語", "é", "e"]
    found = set()
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        found.add(langid.symbols(raw, np.array([0, len(raw)]))[0].tobytes())
    assert len(found) == len(texts)
    plain = np.frombuffer("a – b".encode(), np.uint8)
    assert langid.symbols(plain, np.array([0, len(plain)]))[0].tolist() == [1, 0, 2]
