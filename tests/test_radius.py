"""Pairs within a radius: hot places, odd rows, and no side of the join on the driver."""

import math
import re
from collections import Counter

import pytest

from marchland.operators import neighbors

ROWS = [(i, 2.0, 3.0) for i in range(90)] + [(i, float(i % 7), float(i % 3)) for i in range(90, 120)]
ODD = [(5, 2.0, 3.0), (5, 2.5, 3.0), (None, 2.0, 3.0), (200, None, 3.0), (201, 2.0, None), (202, math.nan, 3.0), (203, -0.0, 0.0), (204, 0.0, -1.0), (205, -1.0, 0.0), (206, -0.6, -0.7), (207, 1e6, -1e6), (208, 1e6, -1e6)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double")


def brute(queries, base, radius, strict):
    found = Counter()
    for i, x, y in queries:
        for j, bx, by in base:
            if None not in (i, x, y, j, bx, by) and i != j:
                d2 = (x - bx) * (x - bx) + (y - by) * (y - by)
                if d2 < radius * radius or not strict and d2 == radius * radius:
                    found[i, j, d2] += 1
    return found


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("asks", [1, 40, 16_384])
def test_pairs_equal_brute_force_however_crowded_cells_are_shared_out(spark, monkeypatch, asks, strict):
    monkeypatch.setattr(neighbors, "CELL_ASKS", asks)
    p, some = ROWS + ODD, ROWS[80:100] + ODD[:8]
    got = neighbors.radius_pairs(frame(spark, p), frame(spark, p), 1.0, strict=strict)
    assert got.columns == ["id", "nbr", "d2"]
    assert Counter(map(tuple, got.collect())) == brute(p, p, 1.0, strict)
    assert Counter(map(tuple, neighbors.radius_pairs(frame(spark, some), frame(spark, p), 1.3, strict=strict).collect())) == brute(some, p, 1.3, strict)


def test_rows_are_shuffled_not_broadcast(spark, tmp_path):
    # as a broadcast, the rows of a large table whose size the planner takes for small end the driver
    frame(spark, ROWS).write.parquet(f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    plan = neighbors.radius_pairs(p, p, 1.0, strict=True)._jdf.queryExecution().sparkPlan().toString()
    assert re.findall(r"(\w+Join) \[cx.*(Inner|LeftOuter)", plan).count(("SortMergeJoin", "Inner")) == 1
    assert not re.search(r"(BroadcastHashJoin|BroadcastNestedLoopJoin|CartesianProduct)(?!.*LeftOuter)", plan)
