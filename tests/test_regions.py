"""The spatial join against every box compared with every other."""

import itertools
import random

from marginalia.operators import regions as G

BOXES = "paper string, slug string, page int, key int, box struct<x0:double,y0:double,x1:double,y1:double>"


def boxes(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y = rng.choice([-6000, -5, 0, 119.5, 120, 240, 600, 9000]), rng.choice([0, 60, 120, 700])
        w, h = rng.choice([-3, 0, 1, 120, 121, 500, 20_000]), rng.choice([0, 12, 130])
        side = None if rng.random() < 0.05 else x + w
        out.append((rng.choice("pq"), "s", rng.choice([1, 2]), k, (float(x), float(y), None if side is None else float(side), float(y + h))))
    return out


def brute(one, other):
    found = []
    for (*p, a, (ax0, ay0, ax1, ay1)), (*q, b, (bx0, by0, bx1, by1)) in itertools.product(one, other):
        if p != q or None in (ax1, bx1) or ax0 > ax1 or bx0 > bx1:
            continue
        if ax0 < bx1 and ax1 > bx0 and ay0 < by1 and ay1 > by0:
            found.append((*p, a, b))
    return sorted(found)


def test_as_every_pair(spark):
    one, other = boxes(1, 120), boxes(2, 90)
    found = G.overlaps(spark.createDataFrame(one, BOXES), spark.createDataFrame(other, BOXES))
    wanted = brute(one, other)
    assert sorted(map(tuple, found.collect())) == wanted and len(wanted) > 100
    itself = G.overlaps(*[spark.createDataFrame(one, BOXES)] * 2).where("a < b")
    assert sorted(map(tuple, itself.collect())) == [x for x in brute(one, one) if x[3] < x[4]]


def test_no_nested_loop(spark):
    rows = spark.createDataFrame(boxes(1, 10), BOXES)
    plan = G.overlaps(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty(spark):
    rows = spark.createDataFrame([], BOXES)
    assert G.overlaps(rows, rows).count() == 0
