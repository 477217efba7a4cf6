"""Draws by hash against a plain sort."""

import hashlib
import re

import pytest

from logloom.operators import windows


def order(k):
    return ("", 0) if k is None else (hashlib.md5(f"42|{k}".encode()).hexdigest(), k)


@pytest.mark.parametrize("n", [0, 1, 2, 777, 3000, 3002, 9000])
def test_lowest_hashes(spark, n):
    keys = [*range(3000), None, 5]
    got = windows.lowest_hashes(spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(3), n, 42, "k")
    assert sorted((r["k"] for r in got.collect()), key=order) == sorted(keys, key=order)[:n]
    assert windows.lowest_hashes(got.limit(0), n, 42, "k").count() == 0


def test_draw_ranks_few_rows(spark):
    got = windows.lowest_hashes(spark.range(20_000), 10_000, 42, "id")
    limits = re.findall(r"GlobalLimit (\d+)", got._jdf.queryExecution().optimizedPlan().toString())
    assert got.count() == 10_000 and all(int(x) < 100 for x in limits)


def test_balanced_keeps_all_attacks(spark):
    rows = spark.range(1000).selectExpr("id", "int(id % 5 = 0) AS y")
    got = windows.balanced(rows.filter("y = 0"), rows.filter("y = 1"), "id").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {0: 400, 1: 200}
