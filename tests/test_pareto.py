"""Pareto fronts against brute force."""

import random

import pytest

from tidemark.operators.pareto import pareto_fronts
from tidemark.plans import population

DATA = "/root/testdata/sf0.001"


def plain_fronts(points):
    left, out, k = dict(points), {}, 0
    while left:
        top = [i for i, p in left.items() if not any(all(a >= b for a, b in zip(q, p, strict=True)) and q != p for q in left.values())]
        out |= dict.fromkeys(top, k)
        left, k = {i: p for i, p in left.items() if i not in top}, k + 1
    return out


@pytest.mark.parametrize("block", [20, 4096])
def test_fronts_equal_brute_force(spark, block):
    rng = random.Random(block)
    points = {i: (float(rng.randrange(12)), float(rng.randrange(12)), rng.choice([-0.5, 0.25, 3.0])) for i in range(150)}
    points |= {200 + i: points[i] for i in range(20)}
    rows = [(i, *p, "x") for i, p in points.items()] + [(900, None, 1.0, 1.0, "x"), (901, float("nan"), 99.0, 99.0, "x")]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, note string").repartition(5)
    got = {r["id"]: r["front"] for r in pareto_fronts(df, ["a", "b", "c"], block).collect()}
    assert got == plain_fronts(points) | {900: None, 901: None} and max(plain_fronts(points).values()) > 4


def test_opposed_objectives_are_one_front_larger_than_a_block(spark):
    df = spark.createDataFrame([(float(i), float(-i)) for i in range(100)], "a double, b double").repartition(3)
    assert [r["front"] for r in pareto_fronts(df, ["a", "b"], 16).collect()] == [0] * 100


def test_first_front_only_and_empty(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 0.0, 5.0)], "id long, a double, b double")
    assert {r["id"]: r["front"] for r in pareto_fronts(df, ["a", "b"], most=1).collect()} == {1: None, 2: 0, 3: 0}
    assert {r["id"]: r["front"] for r in pareto_fronts(df, ["a", "b"], 1, most=1).collect()} == {1: None, 2: 0, 3: 0}
    assert pareto_fronts(df.limit(0), ["a", "b"]).count() == 0


def test_no_nested_loops(spark):
    for name in ("join_pareto", "sel_fronts"):
        plan = population.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
