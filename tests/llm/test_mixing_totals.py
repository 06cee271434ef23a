"""Totals of the copies that mixing deals."""

import numpy as np
import pytest

from siltstone.llm import mixing


@pytest.mark.parametrize("poor, toxic", [(0.18, 0.03)])
def test_copies_meet_targets(spark, poor, toxic):
    """Domains whose rates lie below a quarter, or above three, are cut to their share, not dropped or kept."""
    rng = np.random.default_rng(8)
    words = {0: ["calm", "clear", "plain", "river"], 1: ["zzz", "qqq", "|"], 2: ["foul", "vile"]}
    kinds = [2 if i % 7 == 0 else 1 if i % 5 == 0 else 0 for i in range(4000)]
    rows = [(i, " ".join(rng.choice(words[k] + ["and", "the"], size=20))) for i, k in enumerate(kinds)]
    docs = spark.createDataFrame([*rows, (9000, None), (9001, " ")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k != 1), int(k == 2)) for i, k in enumerate(kinds) if i < 1500], "doc_id long, quality int, toxic int")
    weights = {"good": 0.8, "poor": poor, "toxic": toxic}
    got = mixing.mix_rates(docs, labels, weights).collect()
    every, copies = (np.array([sum((r["copies"] if c else 1) * r["n_tokens"] * r["p_" + d] for r in got) for d in mixing.DOMAINS]) for c in (0, 1))
    aim = mixing.targets(every, weights)
    assert aim[1] < every[1] and aim[2] < 0.25 * every[2]
    assert np.abs(copies / aim - 1).max() <= 0.03, (copies, aim)
    report = {r["domain"]: r for r in mixing.mix_report(docs, labels, weights).collect()}
    assert np.allclose([report[d]["by_copies"] for d in mixing.DOMAINS], copies, rtol=1e-4) and np.allclose([report[d]["target"] for d in mixing.DOMAINS], aim, rtol=1e-3)
    assert all(r["copies"] == 1 for r in got if r["doc_id"] >= 9000 or kinds[r["doc_id"]] == 0)


def test_fit_against_brute_force(spark):
    """Projected-gradient rates against a plain search of the same objective, row by row."""
    rng = np.random.default_rng(3)
    n = rng.integers(1, 400, 60)
    p = rng.dirichlet([0.4, 0.3, 0.3], 60)
    rows = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(60)], "_id long, n_tokens long, p array<double>")
    weights = {"good": 0.9, "poor": 0.06, "toxic": 0.04}
    rate, reached, aim = mixing.fit_rates(rows, weights, iterations=30, tolerance=1e-5)
    fitted = np.array([r["r"] for r in rows.orderBy("_id").select(rate.alias("r")).collect()])
    assert np.allclose((fitted * n) @ p, reached, rtol=1e-6)
    solve = np.linalg.inv((p * n[:, None]).T @ p)
    loss = lambda r: 0.5 * ((r * n) @ p - aim) @ solve @ ((r * n) @ p - aim) + 0.5e-3 * (n * (r - 1) ** 2).sum()
    plain = np.ones(60)
    for _ in range(300):  # one rate at a time, to its exact minimum in [0, 1]
        for i in range(60):
            rest = (plain * n) @ p - aim - plain[i] * n[i] * p[i]
            a, b = n[i] ** 2 * p[i] @ solve @ p[i] + 1e-3 * n[i], n[i] * p[i] @ solve @ rest - 1e-3 * n[i]
            plain[i] = min(1.0, max(0.0, -b / a))
    assert fitted.min() >= 0 and fitted.max() <= 1 and loss(fitted) <= loss(plain) * 1.05 + 1e-3 * aim.sum()


def test_copies_of_odd_rows(spark):
    """Empty domains, null ids, long texts and rows that repeat an id."""
    docs = spark.createDataFrame([(None, "calm river"), (1, ""), (1, "calm"), (2, "foul " * 200_000), (2, "foul " * 200_000), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 0, 1)], "doc_id long, quality int, toxic int")
    got = mixing.mix_rates(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["copies"] <= 1 and abs(r["copies"] - r["rate"]) < 1 for r in got)
    assert mixing.mix_rates(docs.limit(0), labels).count() == 0 and {r["tokens"] for r in mixing.mix_report(docs.limit(0), labels).collect()} == {0.0}
