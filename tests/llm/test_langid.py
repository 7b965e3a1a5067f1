"""Languages of texts whose letters lie beyond U+FFFF."""

from __future__ import annotations

from lawframe.llm.langid import predict, prototypes, trigrams


def test_letters_beyond_u_ffff(spark):
    gothic, han, adlam = "\U00010330\U00010331\U00010332", "\U00020000\U00020001", "\U0001e922\U0001e923"
    model = prototypes(spark.createDataFrame([(f"{gothic} {gothic[::-1]}", "got"), ("the quick brown fox", "en")], "text string, lang string"))
    texts = [gothic, han, adlam, "\U0001f600 \U0001f601", "12 \u2603"]
    got = predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] != "und" for r in got] == [True, True, True, False, False] and got[0]["lang_pred"] == "got"
    assert [len(trigrams(x)[0]) > 0 for x in texts] == [True, True, True, False, False]
