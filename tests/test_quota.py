"""The quota of keys without a pause: blocks walk at once, and their beginnings are repaired."""

import datetime as dt
import random

import pytest

from paperlens.operators import quota as module
from paperlens.operators.quota import block_ends, quota
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def brute(rows, limit, window):
    out, queues = {}, {}
    for i, who, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        q = [a for a in queues.get(who, []) if t - a <= window]
        out[i] = len(q) < limit
        queues[who] = [*q, t] if out[i] else q
    return out


def check(spark, rows, limit, window):
    df = spark.createDataFrame([(i, who, T0 + dt.timedelta(seconds=t), "x") for i, who, t in rows], "id bigint, who string, ts timestamp, allowed_before string")
    got = quota(df, "who", "ts", "id", limit, window)
    assert got.columns == [*df.columns, "allowed"]
    assert {r.id: r.allowed for r in got.collect()} == brute(rows, limit, window)


@pytest.mark.parametrize("limit,window,gap", [(1, 60, 20), (2, 60, 9), (5, 30, 4), (10, 60, 8), (3, 60, 59), (0, 60, 20)])
def test_hot_key_without_a_pause(spark, limit, window, gap):
    rnd, t, rows = random.Random(limit), 0.0, []
    while len(rows) < 3000:
        t += rnd.expovariate(1 / gap) % window
        rows.append((len(rows), "hot" if rnd.random() < 0.6 else rnd.choice("abc"), int(t)))
    check(spark, rows, limit, window)


@pytest.mark.parametrize("rounds", [6, 1, 0])
def test_steady_beat(spark, monkeypatch, rounds):
    """Walks from different queues never meet, so repair goes from block to block, or the key walks on in one stream."""
    monkeypatch.setattr(module, "ROUNDS", rounds)
    monkeypatch.setattr(module, "BLOCK_WINDOWS", 3)
    check(spark, [(i, "k", 7 * i) for i in range(600)] + [(1000 + i, "m", 100 * i + 3) for i in range(60)], 2, 60)


def test_equal_times_and_few_rows(spark):
    check(spark, [(i, "k", i // 7) for i in range(400)], 3, 10)
    check(spark, [(1, "k", 5)], 1, 60)
    none = spark.createDataFrame([], "id bigint, who string, ts timestamp_ntz")
    assert quota(none, "who", "ts", "id", 1, 60).count() == 0


def test_a_hot_key_is_spread(spark):
    rows = [(0, "hot", 10 * i) for i in range(4000)]
    df = spark.createDataFrame([(who, t * 1_000_000) for _, who, t in rows], "_key string, _t bigint")
    blocks = df.withColumn("_block", F.floor(F.col("_t") / (60_000_000 * module.BLOCK_WINDOWS))).withColumn("_run", F.col("_block"))
    ends = block_ends(blocks, None, 2, 60_000_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ends.count() == 11 and ends.select(F.spark_partition_id()).distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = ends._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_key" in plan and "_run" in plan.split("hashpartitioning(")[1].split(")")[0]


def test_light_traffic_settles_every_block(spark):
    """Where no window holds more requests than the limit, one round is enough."""
    df = spark.createDataFrame([("k", 50_000_000 * i) for i in range(600)], "_key string, _t bigint")
    blocks = df.withColumn("_block", F.floor(F.col("_t") / (60_000_000 * module.BLOCK_WINDOWS))).withColumn("_run", F.col("_block"))
    assert block_ends(blocks, None, 2, 60_000_000).filter("NOT _settled").count() == 0
