"""Gates against plain loops."""

import random
from datetime import date, timedelta

import pytest

from tidemark.operators.gates import after_change, after_gap, chained


@pytest.mark.parametrize("gap", [1, 5, 28])
def test_gates_equal_a_loop(spark, gap):
    rng, start = random.Random(gap), date(2024, 1, 1)
    rows = [(k, start + timedelta(days=d), rng.choice(["a", "b", None])) for k in range(4) for d in sorted(rng.sample(range(400), [1, 40, 200, 399][k]))]
    df = spark.createDataFrame([*rows, (None, start, "a"), (9, None, "a")], "k int, day date, state string").repartition(3)
    fixed, changed = {}, {}
    for k in range(4):
        for out, state in ((fixed, False), (changed, True)):
            last = None
            for _, day, s in (r for r in rows if r[0] == k):
                if last is None or (day - last[0]).days >= gap and (not state or s != last[1]):
                    out.setdefault(k, []).append(day)
                    last = (day, s)
    for pointers, want in ((after_gap(df, ["k"], "day", gap), fixed), (after_change(df, ["k"], "day", "state", gap), changed)):
        got = chained(pointers, ["k"], "day", gap).collect()
        assert sorted((r["k"], r["day"]) for r in got) == sorted((k, d) for k, days in want.items() for d in days)


def test_empty(spark):
    df = spark.createDataFrame([], "k int, day date")
    assert chained(after_gap(df, ["k"], "day", 3), ["k"], "day", 3).count() == 0


def test_chains_grow_no_plan(spark):
    """One exchange and no join, however long the chains; columns come along."""
    rows = spark.createDataFrame([(k, date(2020, 1, 1) + timedelta(days=d), f"{k}-{d // 3 % 2}") for k in range(3) for d in range(0, 1500, 1 + k)], "k int, day date, state string")
    got = chained(after_change(rows, ["k"], "day", "state", 1), ["k"], "day", 1, ("state",))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan and plan.count("Aggregate") == 1
    found = [(r["k"], (r["day"] - date(2020, 1, 1)).days, r["state"]) for r in got.orderBy("k", "day").collect()]
    assert [x for x in found if x[0] == 0] == [(0, d, f"0-{d // 3 % 2}") for d in range(0, 1500, 3)] and all(state == f"{k}-{d // 3 % 2}" for k, d, state in found)
