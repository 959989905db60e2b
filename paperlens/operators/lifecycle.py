"""Retention, orphans, purges, quotas, job states, redaction, curation."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from paperlens import packs
from paperlens.functions.ranks import previous_row
from paperlens.functions.text import redact
from paperlens.operators.quota import quota  # noqa: F401  (one of this group)


def expired_sessions(sessions: DataFrame, jobs: DataFrame, now, ttl_hours=2, retention_hours=2) -> DataFrame:
    """Sessions past their expiry or older than the retention, except those with a running job."""
    ttl, keep = F.expr(f"interval {ttl_hours} hours"), F.expr(f"interval {retention_hours} hours")
    old = ((F.col("created_at") + ttl) < now) | (F.col("created_at") < now - keep)
    return sessions.filter(old).join(jobs.filter(F.col("state") == "running"), "session_id", "left_anti")


def stale_jobs(jobs: DataFrame, now, minutes=30) -> DataFrame:
    """Finished jobs past retention (by update time) and zombies still queued or running (by creation)."""
    cut = now - F.expr(f"interval {minutes} minutes")
    done = F.col("state").isin("succeeded", "failed") & (F.col("updated_at") < cut)
    zombie = F.col("state").isin("queued", "running") & (F.col("created_at") < cut)
    return jobs.filter(done | zombie).withColumn("reason", F.when(done, "finished").otherwise("zombie"))


def orphans(children: DataFrame, parents: DataFrame, keys) -> DataFrame:
    return children.join(parents, keys, "left_anti")


def residue(tables: dict, purged: dict) -> DataFrame:
    """Rows left per table after deleting the purged keys: name -> (frame, key), purged: key -> frame of keys."""
    parts = []
    for name, (df, key) in tables.items():
        left = df.join(purged[key], key, "left_anti")
        parts += [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit(side).alias("side"), "n") for side, d in (("before", df), ("after", left))]
    n = lambda side: F.max(F.when(F.col("side") == side, F.col("n"))).alias(side)
    return reduce(DataFrame.unionByName, parts).groupBy("table_name").agg(n("before"), n("after"))


def latest_job_state(log: DataFrame) -> DataFrame:
    """Last state per job; the aggregation is combined map-side."""
    return log.groupBy("job_id").agg(F.max_by(F.struct("state", "ts"), F.struct("ts", "event_id")).alias("s")).select("job_id", "s.state", F.col("s.ts").alias("updated_at"))


def job_transitions(log: DataFrame, legal=packs.JOB_STEPS) -> DataFrame:
    """Every step of every job: from_state (null for its first entry), state, ts, event_id and whether the step is legal.

    log(job_id, state, ts, event_id) may come in any order; a step leads from the entry before in the order of time.  An
    entry that repeats the state is a step like any other.  Entries without a job or a time cannot be placed and are left
    to the caller.
    """
    placed = log.filter(F.col("job_id").isNotNull() & F.col("ts").isNotNull())
    steps = previous_row(placed, "job_id", "ts", "event_id", "state").withColumnRenamed("previous", "from_state")
    known = reduce(lambda a, b: a | b, [F.col("from_state").eqNullSafe(F.lit(a)) & (F.col("state") == b) for a, b in legal])
    return steps.select("job_id", "from_state", "state", "ts", "event_id", F.coalesce(known, F.lit(False)).alias("legal"))


def job_results(log: DataFrame, fields=packs.JOB_FIELDS) -> DataFrame:
    """Per job: state, created_at, updated_at, and of its payload the fields asked for.

    The payloads (JSON objects) are merged field by field, each from the last entry that has it, null included, as an
    update of a stored payload would.  Aggregated map-side to one row per job; a payload that is no object adds nothing.
    """
    body = F.from_json("payload", "map<string,string>")
    at = F.struct("ts", "event_id")
    has = lambda f: F.coalesce(F.map_contains_key("body", F.lit(f)), F.lit(False))
    last = lambda f: F.max_by(F.struct(F.try_element_at("body", F.lit(f)).alias("v")), F.when(has(f), at))["v"].alias(f)
    placed = log.filter(F.col("job_id").isNotNull() & F.col("ts").isNotNull()).withColumn("body", body)
    return placed.groupBy("job_id").agg(F.max_by("state", at).alias("state"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), *[last(f) for f in fields])


def redacted(documents: DataFrame, patterns=packs.REDACTIONS) -> DataFrame:
    """Whole texts with secrets replaced, and whether anything was."""
    out = documents.select("doc_id", "text", redact(F.col("text"), patterns).alias("clean"))
    return out.select("doc_id", "clean", (F.col("clean") != F.col("text")).alias("changed"))


def mask_keys(fields):
    """Sensitive keys of a map are masked."""
    return F.transform_values(fields, lambda k, v: F.when(k.isin(packs.SENSITIVE_KEYS), packs.REDACTED).otherwise(v))


def fingerprints(df: DataFrame, secret: str) -> DataFrame:
    h = F.sha2(F.col(secret), 256)
    return df.withColumns({"token_hash": h, "fingerprint": F.when(F.coalesce(F.col(secret), F.lit("")) == "", "-").otherwise(F.left(h, F.lit(8)))})


def audit_lines(events: DataFrame, event="event", fields="fields", allowed=packs.AUDIT_EVENTS) -> DataFrame:
    """Only known events; metadata as sorted k=v text."""
    kv = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return events.filter(F.col(event).isin(allowed)).withColumn("line", F.concat(F.lit("audit event="), F.col(event), F.lit(" "), F.array_join(kv, " ")))


def license_ok(text):
    t = F.lower(text)
    return (
        F.when(t.contains("cc0") | t.contains("public domain"), True)
        .when(t.contains("nd") | t.contains("nc"), False)
        .otherwise(t.contains("cc") & t.contains("by"))
    )


def new_sources(candidates: DataFrame, used: DataFrame, key: str, length: str, minimum=packs.EXCERPT_MIN_TOTAL, take=None) -> DataFrame:
    """One candidate per unused source key, long enough, in id order; ``take`` is the caller's top-n.

    Copies of a source are folded by a map-side min_by, so a source with a third of the rows is no hot spot.
    """
    others = [c for c in candidates.columns if c != key]
    fresh = candidates.join(used, key, "left_anti").filter((F.col(key) != "") & (F.col(length) >= minimum))
    one = fresh.groupBy(key).agg(F.min_by(F.struct(*others), others[0]).alias("c")).select(key, "c.*")
    return one.orderBy(others[0]).limit(take) if take else one
