"""Near-equal titles: every pair that a comparison of all pairs finds, and survivors as one pass in order finds them."""

import random

import pytest

from siltstone.operators import resolve


def grams(title, n=3):
    return {title[i : i + n] for i in range(len(title) - n + 1)}


def plain_pairs(rows, least):
    sets = {i: grams(t or "") for i, t in rows}
    out = {}
    for a in sets:
        for b in sets:
            union = sets[a] | sets[b]
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(union) >= least:
                out[a, b] = len(sets[a] & sets[b]) / len(union)
    return out


def titles(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcde ", k=rng.randint(3, 90))) for _ in range(n // 6)] + ["unique title number " + "".join(rng.choices("0123456789abcdef", k=64)) for _ in range(n // 6)]
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            t[rng.randrange(len(t))] = rng.choice("abcdefxyz")
        if rng.random() < 0.2:
            t.insert(rng.randrange(len(t)), "q")
        out.append("".join(t))
    return [*enumerate(out), (n, None), (n + 1, ""), (n + 2, "ab"), (n + 3, "aaaaaaaa"), (n + 4, "aaaa")]


@pytest.mark.parametrize("least", [0.9, 0.8, 0.95, 0.3])
def test_no_pair_is_missed(spark, least):
    rows = titles(int(least * 100), 240)
    frame = spark.createDataFrame(rows, "id long, title string")
    got = {(r["a"], r["b"]): r["similarity"] for r in resolve.similar_titles(frame, frame, least).collect()}
    want = plain_pairs(rows, least)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) >= 250


def plain_survivors(rows, least=0.9):
    seen, by_doi, into = [], {}, {}
    for i, title, doi in rows:
        if doi:
            into[i] = by_doi.setdefault(doi, i)
            if into[i] == i:
                seen.append((i, grams(title)))
            continue
        mine = grams(title)
        hit = next((j for j, g in seen if mine and g and len(mine & g) / len(mine | g) > least), None)
        into[i] = i if hit is None else hit
        if hit is None:
            seen.append((i, mine))
    return into


def test_survivors_equal_one_pass(spark):
    rng = random.Random(1)
    rows = [(i, t or "", rng.choice([None, None, None, f"10.1/{rng.randint(1, 20)}"])) for i, t in titles(4, 300)]
    got = {r["id"]: r["into"] for r in resolve.dedupe_papers(spark.createDataFrame(rows, "ord long, title string, doi string")).collect()}
    from siltstone.functions.text import normalize_title

    clean = {r["ord"]: r["t"] for r in spark.createDataFrame(rows, "ord long, title string, doi string").select("ord", normalize_title("title").alias("t")).collect()}
    assert got == plain_survivors([(i, clean[i], d) for i, _, d in rows])
    assert len(set(got.values())) < len(got) - 50


def test_candidates_of_one_template_stay_few(spark):
    rng = random.Random(3)
    rows = [(i, "unique title number " + "".join(rng.choices("0123456789abcdef", k=64))) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, title string").select("id", resolve.ngrams("title", 3).alias("g"))
    marks = resolve._parted(frame, "id", 0.9)
    assert marks.join(marks.withColumnRenamed("id", "other"), ["level", "part", "mark"]).where("id < other").select("id", "other").distinct().count() < 3000


def test_copies_of_a_title_do_not_meet_in_pairs(spark, monkeypatch):
    rng, rows = random.Random(9), []
    base = ["".join(rng.choices("abcdefghij ", k=60)) for _ in range(3)]
    for i in range(240):
        t = rng.choice(base) if i % 4 else "no"
        rows.append((i, t if rng.random() < 0.9 else t[:-1] + "z", f"10.1/{rng.randint(1, 9)}" if rng.random() < 0.2 else None))
    made, plain = [], resolve.similar_titles
    monkeypatch.setattr(resolve, "similar_titles", lambda *a: made.append(plain(*a)) or made[-1])
    from siltstone.functions.text import normalize_title

    frame = spark.createDataFrame(rows, "ord long, title string, doi string")
    clean = {r["ord"]: r["t"] for r in frame.select("ord", normalize_title("title").alias("t")).collect()}
    got = resolve.dedupe_papers(frame.unionByName(spark.createDataFrame([(None, base[0], None)], frame.schema))).collect()
    assert {r["id"]: r["into"] for r in got if r["id"] is not None} == plain_survivors([(i, clean[i], d) for i, _, d in rows])
    assert len(got) == len(rows) + 1 and made[0].count() < 100
