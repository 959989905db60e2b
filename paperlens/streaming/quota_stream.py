"""Sliding-window quota on a stream: per-key state is the latest time and the queue of accepted times, at most ``limit`` long.

The stream decides requests that arrive in order of their times.  ``requests_log`` writes all requests beside it, and
``decided`` takes keys with a request out of order from there, by the batch quota.
"""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from paperlens.operators.quota import quota


def quota_stream(events: DataFrame, key: str, ts: str, tie: str, limit: int, window_seconds: int, watermark="10 minutes") -> DataFrame:
    """Rows with ``allowed`` and ``late``: not after all rows of the key that came in earlier batches.  Idle keys time out.

    Rows beyond the watermark, or without a key or a time, are not in it; ``decided`` takes them from the log.
    A key's rows come in Arrow batches, and are taken in order of ``ts`` within one; only one is held at a time.
    """
    span = window_seconds * 1_000_000
    names = [key, ts, tie]

    def step(who, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        accepted, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        for rows in batches:  # never a whole key: what comes behind an earlier batch's times is late
            rows = rows.sort_values([ts, tie])
            flags, late = [], []
            before = last
            for t in map(int, rows[ts].astype("datetime64[us]").astype("int64")):
                ok = sum(0 <= t - a <= span for a in accepted) < limit
                if ok:
                    accepted = sorted([*accepted, t])[-limit:]
                flags.append(ok)
                late.append(before is not None and t <= before)
                last = t if last is None else max(last, t)
            yield rows[names].assign(allowed=flags, late=late)
        accepted = [a for a in accepted if last - a <= span]
        state.update((accepted, last))
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(mark + 1, last // 1000 + window_seconds * 1000 + 1))

    types = {f.name: f.dataType.simpleString() for f in events.schema}
    out = ", ".join(f"{n} {types[n]}" for n in names) + ", allowed boolean, late boolean"
    return (
        events.select(*names)
        .filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
        .withWatermark(ts, watermark)
        .groupBy(key)
        .applyInPandasWithState(step, out, "accepted array<bigint>, last bigint", "append", GroupStateTimeout.EventTimeTimeout)
    )


def requests_log(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Every request, to be written by a query of its own that runs after the one of ``quota_stream``."""
    return events.select(key, ts, tie)


def decided(log: DataFrame, stream: DataFrame, key: str, ts: str, tie: str, limit: int, window_seconds: int) -> DataFrame:
    """Every request of the log with ``allowed``, whatever the micro-batches they came in.

    Where a key has a late request, or one that the stream dropped, its requests are decided again by the batch quota;
    other decisions of the stream stand.  The counts that tell are aggregated map-side to a row per key.
    """
    seen = log.groupBy(key).agg(F.count("*").alias("_asked"))
    told = stream.groupBy(key).agg(F.count("*").alias("_told"), F.count_if("late").alias("_late")).withColumnRenamed(key, "_told_key")
    both = seen.join(told, F.col(key).eqNullSafe(F.col("_told_key")), "left")
    stands = (F.coalesce("_told", F.lit(0)) == F.col("_asked")) & (F.col("_late") == 0)
    both = both.select(F.col(key).alias("_key"), F.coalesce(stands, F.lit(False)).alias("_stands"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    again = log.join(both.filter("NOT _stands"), same, "left_semi")
    kept = stream.join(both.filter("_stands"), same, "left_semi").select(key, ts, tie, "allowed")
    return kept.unionByName(quota(again.select(key, ts, tie), key, ts, tie, limit, window_seconds))
