"""License scans and mixing."""

import numpy as np
import pytest

from siltstone.llm import license_scan, mixing

DOC = "doc_id long, text string, lang string, label int, digest string"


def test_licenses(spark):
    mit = license_scan.MIT
    texts = [
        None, "", "...", mit, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,"), "MIT LICENCE\n(c) 2001 X\n" + mit,
        "prose\nReleased under the MIT Licence!\nmore\nlicensed under CC-BY-NC 4.0", "about the MIT license in general", "Released under the MIT License. And more.",
    ]
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in enumerate(texts)] + [(None, texts[3], None, None, None)], DOC)
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan_licenses(docs).collect()}
    assert [got[i][0] for i in range(9)] == [None, None, None, "MIT", "MIT", "MIT", None, None, None] and got[None][0] == "MIT"
    assert got[6] == (None, "CC-BY-NC-4.0,MIT", 2) and got[7] == got[8] == (None, "", 0)
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0
    assert {r["n_license_lines"] for r in license_scan.scan_licenses(docs, known=[]).collect()} == {0}


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(4)
    words = {0: ["calm", "clear", "plain", "river"], 1: ["zzz", "qqq", "|"], 2: ["foul", "vile"]}
    rows = []
    for i in range(600):
        kind = 2 if i % 7 == 0 else 1 if i % 5 == 0 else 0
        rows.append((i, " ".join(rng.choice(words[kind] + ["and", "the"], size=40)), "en", kind, ""))
    docs = spark.createDataFrame([*rows, (1000, None, "en", 0, ""), (None, "calm river and", "en", 0, "")], DOC)
    labels = spark.createDataFrame([(r[0], int(r[3] != 1), int(r[3] == 2)) for r in rows if r[0] < 400], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_rates_meet_targets(mixed):
    rows, docs, labels = mixed
    got = {r["doc_id"]: r for r in mixing.mix_rates(docs, labels).collect()}
    assert len(got) == 602 and got[1000]["rate"] == 1.0
    held = [r for r in rows if r[0] >= 400]
    right = sum(max(range(3), key=lambda k: got[r[0]]["p_" + mixing.DOMAINS[k]]) == r[3] for r in held)
    assert right >= 0.97 * len(held)  # held-out accuracy
    total = [sum(g["rate"] * g["n_tokens"] * g["p_" + d] for g in got.values()) for d in mixing.DOMAINS]
    every = np.array([sum(g["n_tokens"] * g["p_" + d] for g in got.values()) for d in mixing.DOMAINS])
    aim = mixing.targets(every, mixing.WEIGHTS)
    assert np.abs(np.array(total) - aim).sum() <= 0.02 * aim.sum()
    assert all(got[r[0]]["copies"] == 1 for r in rows if r[3] == 0)


def test_mix_keeps_columns(mixed, spark):
    rows, docs, labels = mixed
    out = mixing.mix_sources(docs, labels)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert {r[0] for r in rows if r[3] == 0} <= set(ids) and sum(i is not None and i < 600 and rows[i][3] == 2 for i in ids) < 20
    assert mixing.mix_sources(docs.limit(0), labels).count() == 0
    assert mixing.mix_sources(docs, labels.limit(0)).count() == docs.count()
