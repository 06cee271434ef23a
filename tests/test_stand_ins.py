"""Stand-ins of materials: names are settled before ids."""

import re

from siltstone.plans import discovery


def test_ids_are_not_multiplied_by_names(spark):
    hyps = [(i, ["ring" if i % 2 else "Hot-Bolt", "nut"]) for i in range(20)] + [(20, []), (21, ["", None])]
    names = [(f"ring {k}", f"p{k % 3}") for k in range(30)] + [("bolt", "b"), ("n", "x"), ("", "y"), (None, "z"), ("ring", None)]
    out = discovery.proxies_of(spark.createDataFrame(hyps, "id long, materials array<string>"), spark.createDataFrame(names, "name string, proxy string"))
    spelled = lambda s: (s or "").replace(" ", "").replace("-", "").lower()
    want = {(i, p) for i, ms in hyps for m in map(spelled, ms) for n, p in names if m and spelled(n) and (m in spelled(n) or spelled(n) in m)}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert re.search(r"Aggregate \[m#\d+, proxy#\d+\]", out._jdf.queryExecution().optimizedPlan().toString())
