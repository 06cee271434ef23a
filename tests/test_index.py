"""Phrase search against brute force; an index in segments against one built anew."""

import random

import pytest

from siltstone.operators import index_store, passages, retrieval

WORDS = ["zeo", "water", "band", "gap", "the1", "cage", "x2"]


def words(text):
    import re

    return re.findall("[a-z0-9]+", (text or "").lower())


def test_phrases_against_brute_force(spark):
    rng = random.Random(2)
    line = lambda: rng.choice([" ", ", ", "  "]).join(rng.choices(WORDS, k=rng.randint(0, 9)))
    docs = [(i, "\n".join(line() for _ in range(rng.randint(1, 4)))) for i in range(60)] + [(99, None), (98, ""), (97, "Zeo WATER zeo water zeo")]
    phrases = [(k, rng.choices(WORDS, k=rng.randint(1, 3))) for k in range(12)] + [(50, ["zeo", "nowhere"]), (51, ["zeo", "water", "zeo"]), (52, [])]
    frame = passages.passages(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    wanted = spark.createDataFrame(phrases, "query long, words array<string>")
    got = sorted(tuple(r) for r in passages.phrase_places(frame, wanted).collect())
    want = []
    for q, p in phrases:
        for i, t in docs:
            for c, part in enumerate((t or "").split("\n")):
                w = words(part)
                want += [(q, i, c, at) for at in range(len(w) - len(p) + 1) if p and w[at : at + len(p)] == p]
    assert got == sorted(want) and len(want) > 50
    best = passages.search(frame, wanted, most=1).where("query = 51").collect()
    assert len(best) == 1 and best[0]["hits"] >= 1
    assert passages.search(frame.limit(0), wanted).count() == 0


def test_metadata(spark):
    rows = spark.createDataFrame([(1, "Blue Plate", "home", 5.0), (2, "blue", None, 7.0), (3, "plate", "blue home", None), (4, None, None, 6.0)], "id long, name string, kind string, size double")
    ids = lambda *a: sorted(r["id"] for r in passages.metadata_search(rows, ["name", "kind"], *a).collect())
    assert ids("blue", "size") == [1, 2, 3] and ids("Blue home", "size") == [1, 3] and ids("blue", "size", 5, 6) == [1] and ids("", "size", None, 6.5) == [1, 4]


def test_segments_equal_an_index_built_anew(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "epsilon"], k=rng.randint(0, 6)))
    now, path = {}, str(tmp_path / "index")
    for segment in range(5):
        batch = {rng.randint(0, 30): rng.choice([text(), text(), "", None]) for _ in range(15)}
        now |= batch
        frame = spark.createDataFrame([*batch.items(), (None, "alpha")], "id long, text string")
        for _ in range(2 if segment == 3 else 1):  # a refresh that is run again
            index_store.write_segment(frame, "id", "text", path, segment)
    anew = {(r["term"], r["doc"]) for r in retrieval.postings(spark.createDataFrame([*now.items()], "id long, text string"), "id", "text").collect()}
    rows = [(r["term"], r["doc"]) for r in index_store.read_index(spark, path).collect()]
    assert set(rows) == anew and len(rows) == len(anew)
    assert {(r["term"], r["doc"]) for r in index_store.lookup(spark, path, "beta nothing").collect()} == {x for x in anew if x[0] == "beta"}
    index_store.compacted(spark, path, str(tmp_path / "one"))
    assert {(r["term"], r["doc"]) for r in index_store.read_index(spark, str(tmp_path / "one")).collect()} == anew
    index_store.write_segment(spark.createDataFrame([(0, None)], "id long, text string"), "id", "text", str(tmp_path / "one"), 1)
    assert index_store.read_index(spark, str(tmp_path / "one")).where("doc = 0").count() == 0


def test_only_sound_tables_are_installed(spark, tmp_path):
    sound = [("a", 1), ("b", 1), ("a", 2)]
    spark.createDataFrame(sound, "term string, doc long").write.parquet(str(tmp_path / "sound"))
    index_store.install(spark, str(tmp_path / "sound"), str(tmp_path / "index"))
    assert sorted((r["term"], r["doc"]) for r in index_store.read_index(spark, str(tmp_path / "index")).collect()) == sorted(sound)
    for name, rows in (("twice", [("a", 1), ("a", 1)]), ("broken", [("", 1)]), ("null", [("a", None)])):
        spark.createDataFrame(rows, "term string, doc long").write.parquet(str(tmp_path / name))
        with pytest.raises(ValueError, match="postings"):
            index_store.install(spark, str(tmp_path / name), str(tmp_path / "bad"))
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="columns"):
        index_store.install(spark, str(tmp_path / "other"), str(tmp_path / "bad"))
