"""Periods and gaps against a plain sweep in Python."""

import random

import pytest

from turnloom.operators.periods import periods_and_gaps


def brute(rows, max_gap):
    out = set()
    for who in {r[0] for r in rows}:
        spans = sorted((s, t) for w, s, t in rows if w == who and s is not None and t is not None and t > s)
        periods = []
        for s, t in spans:
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(t, periods[-1][1])
            else:
                periods.append([s, t])
        out |= {(who, "period", s, t) for s, t in periods}
        out |= {(who, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:]) if max_gap is None or b[0] - a[1] <= max_gap}
    return out


@pytest.mark.parametrize("seed,chunk,max_gap", [(1, 50, 40), (2, 7, 5), (3, 1000, None), (4, 20, 100)])
def test_against_a_sweep(spark, seed, chunk, max_gap):
    r = random.Random(seed)
    rows = []
    for _ in range(300):
        s = r.randrange(-200, 1500)
        rows.append((r.choice("ab"), s, s + r.choice([0, 1, 3, 10, 40, 300 if r.random() < 0.1 else 5])))
    rows += [("a", None, 5), ("a", 5, None), (None, 1, 4), (None, 4, 6), ("c", 10, 5), ("d", 3, 9), ("d", 3, 9)]
    df = spark.createDataFrame(rows, "kind string, s bigint, t bigint")
    got = [tuple(x) for x in periods_and_gaps(df.withColumnRenamed("kind", "who"), ["who"], "s", "t", max_gap, chunk).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, max_gap)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "who string, s bigint, t bigint, start string, __c int")
    assert periods_and_gaps(df, ["who"], "s", "t", 5).collect() == []
    one = spark.createDataFrame([("x", 1, 2, "y", 3)], "who string, s bigint, t bigint, start string, __c int")
    assert [tuple(r) for r in periods_and_gaps(one, ["who"], "s", "t").collect()] == [("x", "period", 1, 2)]
