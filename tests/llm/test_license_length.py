"""Licences whose raw text is far longer than their canonical form, whole licences, catalogues of any size."""

import os

import pytest

from siltstone.llm import license_scan


def test_long_texts_and_lines(spark):
    holders = "".join(f"Copyright (c) {1900 + k % 100} Contributor number {k} of the project\n" for k in range(400))
    framed = "\n".join("*" * 90 + "\n* " + line + " *" for line in license_scan.MIT.replace(". ", ".\n").split("\n"))
    padded = "Released under the" + " " * 9000 + "MIT License."
    texts = [holders + license_scan.MIT, framed + "\n" + "*" * 5000, "prose\n" + padded + "\nprose", holders + "no licence", padded]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan_licenses(docs).collect()}
    assert [got[i][0] for i in range(5)] == ["MIT", "MIT", None, None, "MIT"]
    assert got[2] == (None, "MIT", 1) and got[3] == (None, "", 0) and got[4] == ("MIT", "MIT", 1)


def test_known_tables_of_any_size(spark):
    """Beyond MAX_KNOWN the digests are not broadcast; rows that repeat an id keep their own lines."""
    known = [(f"L{k:05d}", f"license number {k}") for k in range(license_scan.MAX_KNOWN + 5)]
    rows = [(1, "License number 7!", 0), (1, "x\nlicence NUMBER 8\nlicense number 9\nlicence number 9", 1), (2, None, 2), (None, "license number 7\nlicense number 7", 3), (None, "", 4), (3, "x\nlicense number 8", 5), (3, "x\nlicense number 8", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license int")
    found = license_scan.scan_licenses(docs, known)
    assert "Broadcast" not in found._jdf.queryExecution().optimizedPlan().toString().split("ResolvedHint")[0]
    got = sorted(map(tuple, found.collect()), key=str)
    want = [(1, "L00007", "L00007", 1), (1, None, "L00008,L00009", 3), (2, None, "", 0), (None, None, "L00007", 2), (None, None, "", 0), (3, None, "L00008", 1), (3, None, "L00008", 1)]
    assert got == sorted(want, key=str)


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts on this machine")
def test_whole_licences(spark):
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    rows = []
    for k, name in enumerate(names):
        with open(f"/usr/share/common-licenses/{name}") as f:
            rows.append((k, "/*\n" + "\n".join(" * " + x.upper().replace("LICENSE", "LICENCE") for x in f.read().split("\n")) + "\n */"))
    got = {r["doc_id"]: r["license"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(names))] == list(names.values())
