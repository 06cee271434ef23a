"""Names in texts by the words of a text: no text meets its candidates by a shuffle."""

from siltstone.operators import graph

TEXTS = [(1, "The catalyst; CATS and dogs\ncat"), (2, "İs a ß zif-8 film"), (3, "new york city"), (4, "newyork"), (4, "york"), (5, None), (6, ""), (None, "cat"), (7, "x" * 300 + "cat")]


def named(spark, names):
    got = graph.named_in(spark.createDataFrame(TEXTS, "k long, t string"), "k", "t", spark.createDataFrame([(n,) for n in names], "name string"), "name")
    return got, sorted(tuple(r) for r in got.collect())


def test_words_and_phrases(spark):
    names = ["Cat", "cat", "a", "ß", "İs", "york", "New York", "s\nc", "dogs\ncat", None, "", "none"]
    want = sorted({(k, n) for k, t in TEXTS if k and t for n in names if n and n.lower() in t.lower()})
    assert named(spark, names)[1] == want


def test_texts_stay_where_they_are(spark):
    got, rows = named(spark, ["cat", "york"])
    assert (7, "cat") in rows and (4, "york") in rows
    assert "contains(_text" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
