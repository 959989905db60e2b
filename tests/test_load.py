"""Percentiles, wall time, job logs and histograms against brute force."""

import datetime as dt
import json
import random

import pytest

from paperlens import packs
from paperlens.functions.ranks import nearest_rank
from paperlens.operators import evaluate, lifecycle


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_percentiles_with_an_outlier(spark, accuracy):
    rnd = random.Random(accuracy)
    data = [("hot", rnd.gauss(0, 1)) for _ in range(4000)] + [("hot", 1e12), ("hot", -1e12), ("b", 3.0), (None, 1.0), (None, 2.0), (None, None)] + [("ties", float(i % 3)) for i in range(500)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {(r.g, r.pct): r.v for r in nearest_rank(df, "g", "v", [0, 5, 50, 95, 100], accuracy).collect()}
    for g in ("hot", "b", None, "ties"):
        s = sorted(v for k, v in data if k == g and v is not None)
        for p in (0, 5, 50, 95, 100):
            assert got.pop((g, float(p))) == s[round(p / 100 * (len(s) - 1))]
    assert not got and nearest_rank(df.limit(0), "g", "v", [50]).count() == 0


def test_only_what_lies_between_is_ordered(spark):
    df = spark.range(200_000).selectExpr("'k' AS g", "CASE WHEN id = 0 THEN 1e12 ELSE id END AS v")
    kept = nearest_rank(df, "g", "v", [50])
    assert kept.first().v == 100_001  # place 100,000 of 1..199999 and the outlier
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window [sum(n") :]
    assert "Aggregate [" in window and plan.count("Window [") == 1  # over values counted before, not over the rows


def brute_busy(spans):
    marks = sorted({t for s, e in spans for t in (s, e)})
    open_at = lambda t: sum(s <= t < e for s, e in spans)
    return sum(b - a for a, b in zip(marks, marks[1:]) if open_at(a)), max(map(open_at, marks), default=0)


@pytest.mark.parametrize("block", [3_600_000_000, 7])
def test_busy_time(spark, block):
    rnd, rows = random.Random(block), []
    for _ in range(300):
        s = rnd.randint(0, 400)
        rows.append((rnd.choice(["a", "a", None]), rnd.randint(0, 1), s, s + rnd.choice([0, 1, 2, 3, 30, -4])))
    rows += [("b", 0, 5, None), ("c", 0, 5, 6)]
    df = spark.createDataFrame(rows, "k string, r int, s bigint, e bigint")
    got = {(x.k, x.r): (x.busy_us, x.peak) for x in evaluate.busy_time(df, ["k", "r"], "s", "e", block).collect()}
    spans = {}
    for k, r, s, e in rows:
        if e is not None and e > s:
            spans.setdefault((k, r), []).append((s, e))
    assert got == {k: brute_busy(v) for k, v in spans.items()}


def test_load_report(spark):
    # one request of 2 s a round; then four of 2 s that overlap by halves, in one round of 5 s
    rows = [(1, r, 0, 2_000_000) for r in range(3)] + [(4, 0, i * 1_000_000, i * 1_000_000 + 2_000_000) for i in range(4)]
    got = {r.level: r for r in evaluate.load_report(spark.createDataFrame(rows, "level int, round int, start_us bigint, end_us bigint")).collect()}
    assert (got[1].wall_s, got[1].peak, got[1].speedup, got[1].p95) == (2.0, 1, 1.0, 2000.0)
    assert (got[4].wall_s, got[4].peak, got[4].speedup, got[4].n) == (5.0, 2, 1.6, 4)


def job_log(spark):
    rnd, t0, rows = random.Random(3), dt.datetime(2024, 1, 1), []
    for i in range(600):
        job = "hot" if i % 3 else f"j{rnd.randint(0, 20)}"
        state = rnd.choice(["queued", "running", "succeeded", "failed"])
        body = rnd.choice(['{"kind": "review"}', '{"result": %d}' % i, '{"error": {"code": "x%d"}}' % i, '{"result": null}', "[1]", None, "no json"])
        rows.append((job, state, t0 + dt.timedelta(minutes=rnd.randint(0, 900)), i, body))
    rows += [(None, "queued", t0, 900, None), ("hot", "queued", None, 901, None)]
    return rows, spark.createDataFrame(rows, "job_id string, state string, ts timestamp, event_id int, payload string")


def test_job_steps_and_results(spark):
    rows, log = job_log(spark)
    steps, merged = {}, {}
    for job in {r[0] for r in rows if r[0]}:
        before, state = None, {}
        for _, now, ts, i, body in sorted((r for r in rows if r[0] == job and r[2]), key=lambda r: (r[2], r[3])):
            steps[i] = (job, before, now, (before, now) in packs.JOB_STEPS)
            before = now
            try:
                body = json.loads(body or "")
            except ValueError:
                body = None
            state |= body if isinstance(body, dict) else {}
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"))
        merged[job] = (before, *(text(state.get(f)) for f in packs.JOB_FIELDS))
    got = lifecycle.job_transitions(log).collect()
    assert {r.event_id: (r.job_id, r.from_state, r.state, r.legal) for r in got} == steps and len(got) == len(steps)
    assert {r.job_id: (r.state, r.kind, r.result, r.error) for r in lifecycle.job_results(log).collect()} == merged
    assert lifecycle.job_transitions(log.limit(0)).count() == 0 and lifecycle.job_results(log.limit(0)).count() == 0


def test_severity_histogram(spark):
    rows = [(1, 0, "problem", "high"), (1, 0, "problem", "high"), (1, 1, "problem", "low"), (1, 1, "pass", "low"), (2, 0, "pass", "high")]
    got = evaluate.severity_histogram(spark.createDataFrame(rows, "doc_id int, run int, verdict string, severity string")).collect()
    assert [(r.doc_id, r.severities) for r in got] == [(1, {"0:high": 2, "1:low": 1})]
