"""Titles are normalised once, and only earlier ones are compared."""

from test_titles import titles

from siltstone.operators import resolve


def test_titles_are_normalised_once(spark, monkeypatch):
    rows = [(i, t or "", f"10.1/{i % 7}" if i % 5 == 0 else None) for i, t in titles(2, 60)]
    plans, plain = [], resolve.cut
    monkeypatch.setattr(resolve, "cut", lambda frame: plans.append(frame._jdf.queryExecution().optimizedPlan().toString()) or plain(frame))
    got = resolve.dedupe_papers(spark.createDataFrame(rows, "ord long, title string, doi string"))
    plans.append(got._jdf.queryExecution().optimizedPlan().toString())
    assert got.count() == len(rows)
    assert "regexp_replace" in plans[0] and not any("regexp_replace" in p for p in plans[1:])  # before, again for every gram and every step


def test_earlier_pairs_are_all_pairs_with_a_lesser_id(spark):
    for least in (0.9, 0.5):
        frame = spark.createDataFrame(titles(8, 120), "id long, title string")
        every = {tuple(r) for r in resolve.similar_titles(frame, frame, least).collect()}
        got = [tuple(r) for r in resolve.similar_titles(frame, frame, least, 3, True).collect()]
        assert set(got) == {r for r in every if r[1] < r[0]} and len(got) == len(set(got)) > 20


def test_titles_that_are_not_near_enough_are_not_scored(spark):
    import random

    rng = random.Random(6)
    base = "".join(rng.choices("abcdefghij ", k=80))
    rows = []
    for i in range(400):
        t = list(base)
        for k in rng.sample(range(80), 5):
            t[k] = rng.choice("klmnop")
        rows.append((i, "".join(t)))
    frame = spark.createDataFrame(rows, "id long, title string")
    sets = frame.select("id", resolve.ngrams("title", 3).alias("g"))
    a, b = sets.withColumnRenamed("id", "a"), sets.withColumnRenamed("id", "b")
    shared = resolve._parted(a, "a", 0.9).select("a", "level", "part", "mark").join(resolve._parted(b, "b", 0.9).select("b", "level", "part", "mark"), ["level", "part", "mark"])
    near = resolve.similar_titles(frame, frame, 0.9).count()
    met, before = resolve._met(a, b, 0.9).distinct().count(), shared.select("a", "b").distinct().count()
    assert near <= met < near + 20 and before > 2 * met
