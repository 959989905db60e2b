"""Record-level operators on the events, orders, customer, part, pages and documents tables."""

from pyspark.sql import functions as F

from paperlens import packs as P
from paperlens.catalog import query
from paperlens.catalog.common import docs
from paperlens.functions.text import cs
from paperlens.operators import lifecycle, reports
from paperlens.operators.quota import micros
from paperlens.oracle.sql import inlist, q, sql
from paperlens.catalog.structure import HROWS
from paperlens.sources import sections
from paperlens.sources.intake import read, spread
from paperlens.sources.sinks import report_listing


def events(spark, d):
    return read(spark, d, "events")


# --- report stores ---------------------------------------------------------------------------

@query("src_report_listing", "SELECT event_id, 'doc-' || user_id AS document_name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS total FROM events")
def src_report_listing(spark, d):
    """Stored report JSON (name, counts) read back from a JSON column, newest first."""
    k = F.get_json_object("props", "$.k")
    js = F.to_json(F.struct(F.concat(F.lit("doc-"), F.col("user_id").cast("string")).alias("document_name"), F.struct(k.alias("total")).alias("counts")))
    return report_listing(events(spark, d).select("event_id", "ts", js.alias("report_json")), "report_json", "ts").drop("ts")


@query("rep_name_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(coalesce(p_name, '')), 'ring')")
def rep_name_filter(spark, d):
    return reports.name_filter(read(spark, d, "part"), "p_name", " Ring ").select("p_partkey", "p_name")


@query("rep_scoped_lookup", "SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING')")
def rep_scoped_lookup(spark, d):
    """Orders visible to the owners in one segment."""
    owners = read(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return reports.scoped(read(spark, d, "orders"), owners, "o_custkey").select("o_orderkey", "o_custkey")


# --- lifecycle ----------------------------------------------------------------------------------

NOW = "TIMESTAMP '2024-01-30 12:00:00'"
JOB_STATE = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'click' THEN 'running' ELSE 'failed' END"


def now():
    return F.to_timestamp_ntz(F.lit("2024-01-30 12:00:00"))


def job_state():
    t = F.col("event_type")
    return F.when(t == "view", "queued").when(t.isin("signup", "click"), "running").when(t == "purchase", "succeeded").otherwise("failed")


def jobs(spark, d):
    """Events as jobs: created at ts, updated `value` minutes later."""
    e = events(spark, d)
    return e.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("session_id"), job_state().alias("state"), F.col("ts").alias("created_at"), (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))).alias("updated_at"))


JOBS = f"(SELECT event_id AS job_id, user_id AS session_id, {JOB_STATE} AS state, ts AS created_at, ts + to_minutes(CAST(floor(value) AS BIGINT)) AS updated_at FROM events)"


SESSION_TIME = "1996-01-01 00:00:00"


@query(
    "lif_expired_sessions",
    f"""SELECT s.session_id FROM (SELECT o_custkey AS session_id, min(o_orderdate) AS created_at FROM orders GROUP BY 1) s
     WHERE (created_at + INTERVAL 24 HOURS < TIMESTAMP '{SESSION_TIME}' OR created_at < TIMESTAMP '{SESSION_TIME}' - INTERVAL 700 HOURS) AND NOT EXISTS (SELECT 1 FROM orders j WHERE j.o_custkey = s.session_id AND j.o_orderstatus = 'P')""",
)
def lif_expired_sessions(spark, d):
    """Customers as sessions from their first order; every order is a job of its customer, a partial one is running."""
    o = read(spark, d, "orders")
    s = o.groupBy(F.col("o_custkey").alias("session_id")).agg(F.min("o_orderdate").alias("created_at"))
    state = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "F", "succeeded").otherwise("queued")
    j = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("session_id"), state.alias("state"))
    return lifecycle.expired_sessions(s, j, F.to_timestamp_ntz(F.lit(SESSION_TIME)), ttl_hours=24, retention_hours=700).select("session_id")


@query("lif_stale_jobs", f"SELECT job_id, CASE WHEN state IN ('succeeded', 'failed') THEN 'finished' ELSE 'zombie' END AS reason FROM {JOBS} WHERE (state IN ('succeeded', 'failed') AND updated_at < {NOW} - INTERVAL 30 MINUTES) OR (state IN ('queued', 'running') AND created_at < {NOW} - INTERVAL 30 MINUTES)")
def lif_stale_jobs(spark, d):
    return lifecycle.stale_jobs(jobs(spark, d), now(), 30).select("job_id", "reason")


@query("lif_orphans", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'F')")
def lif_orphans(spark, d):
    """Line items whose order is gone once the finished orders are."""
    live = read(spark, d, "orders").filter(F.col("o_orderstatus") != "F").select(F.col("o_orderkey").alias("l_orderkey"))
    return lifecycle.orphans(read(spark, d, "lineitem"), live, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "lif_purge",
    """WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey FROM orders JOIN c ON o_custkey = c_custkey)
     SELECT 'customer' AS table_name, count(*) AS before, count(*) FILTER (WHERE c_custkey NOT IN (SELECT c_custkey FROM c)) AS after FROM customer
     UNION ALL SELECT 'orders', count(*), count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM c)) FROM orders
     UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)) FROM lineitem""",
)
def lif_purge(spark, d):
    """Customers in debt are purged from all three tables; rows before and after."""
    c, o, li = (read(spark, d, t) for t in ("customer", "orders", "lineitem"))
    gone = c.filter(F.col("c_acctbal") < 0).select("c_custkey")
    gone_o = o.join(gone.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left_semi").select("o_orderkey")
    keys = {"c_custkey": gone, "o_custkey": gone.withColumnRenamed("c_custkey", "o_custkey"), "l_orderkey": gone_o.withColumnRenamed("o_orderkey", "l_orderkey")}
    return lifecycle.residue({"customer": (c, "c_custkey"), "orders": (o, "o_custkey"), "lineitem": (li, "l_orderkey")}, keys)


LIMIT, WINDOW = 2, 6 * 3600
QUOTA = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 walk AS (
  SELECT user_id, event_id, rn, true AS allowed, [ts] AS q FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.rn, len(list_filter(w.q, lambda t: e.ts - t <= INTERVAL {WINDOW} SECONDS)) < {LIMIT},
   CASE WHEN len(list_filter(w.q, lambda t: e.ts - t <= INTERVAL {WINDOW} SECONDS)) < {LIMIT} THEN list_append(list_filter(w.q, lambda t: e.ts - t <= INTERVAL {WINDOW} SECONDS), e.ts) ELSE list_filter(w.q, lambda t: e.ts - t <= INTERVAL {WINDOW} SECONDS) END
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
 SELECT event_id, user_id, allowed FROM walk"""


@query("lif_quota", QUOTA)
def lif_quota(spark, d):
    """At most two accepted events per user in six hours."""
    return lifecycle.quota(events(spark, d).select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", LIMIT, WINDOW).select("event_id", "user_id", "allowed")


@query("lif_job_states", f"SELECT user_id AS job_id, arg_max(state, (ts, event_id)) AS state FROM (SELECT *, {JOB_STATE} AS state FROM events) GROUP BY user_id")
def lif_job_states(spark, d):
    log = events(spark, d).select(F.col("user_id").alias("job_id"), job_state().alias("state"), "ts", "event_id")
    return lifecycle.latest_job_state(log).select("job_id", "state")


def job_log(spark, d):
    """Events as log entries of jobs (one per user), each with the payload that its state brings."""
    t, state, name = F.col("event_type"), job_state(), F.col("event_id").cast("string")
    body = F.struct(
        F.when(state == "queued", t).alias("kind"), F.when(state == "succeeded", F.concat(F.lit("r"), name)).alias("result"), F.when(state == "failed", F.concat(F.lit("e"), name)).alias("error")
    )
    return events(spark, d).select(F.col("user_id").alias("job_id"), state.alias("state"), "ts", "event_id", F.to_json(body).alias("payload"))


JOB_LOG = f"(SELECT user_id AS job_id, {JOB_STATE} AS state, event_type, ts, event_id FROM events)"
_LEGAL = "(from_state IS NULL AND state = 'queued') OR " + " OR ".join(f"(from_state = {q(a)} AND state = {q(b)})" for a, b in P.JOB_STEPS if a)


@query("lif_job_transitions", f"SELECT job_id, event_id, from_state, state FROM (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS from_state FROM {JOB_LOG}) WHERE NOT coalesce({_LEGAL}, false)")
def lif_job_transitions(spark, d):
    """Steps of jobs that the life of a job does not allow."""
    return lifecycle.job_transitions(job_log(spark, d)).filter("NOT legal").select("job_id", "event_id", "from_state", "state")


@query(
    "lif_job_results",
    f"""SELECT job_id, arg_max(state, (ts, event_id)) AS state, CAST(epoch_us(min(ts)) AS BIGINT) AS created_us, CAST(epoch_us(max(ts)) AS BIGINT) AS updated_us, arg_max(event_type, (ts, event_id)) FILTER (WHERE state = 'queued') AS kind,
      'r' || arg_max(event_id, (ts, event_id)) FILTER (WHERE state = 'succeeded') AS result, 'e' || arg_max(event_id, (ts, event_id)) FILTER (WHERE state = 'failed') AS error FROM {JOB_LOG} GROUP BY job_id""",
)
def lif_job_results(spark, d):
    """The state of every job with kind, result and error, merged from the payloads of its log."""
    r = lifecycle.job_results(job_log(spark, d))
    return r.select("job_id", "state", micros(r, "created_at").alias("created_us"), micros(r, "updated_at").alias("updated_us"), "kind", "result", "error")


TOKEN_RULE = r'token\s*=\s*"[^"]*"'


@query(
    "lif_redaction",
    "SELECT doc_id, clean, clean <> text AS changed FROM (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '(sk-[A-Za-z0-9]{8,})', '[REDACTED]', 'g'), '(?i)(authorization|api[_-]?key)\\s*[:=]\\s*\\S+', '[REDACTED]', 'g'), 'token\\s*=\\s*\"[^\"]*\"', '[REDACTED]', 'g') AS clean FROM documents)",
)
def lif_redaction(spark, d):
    """The built-in secret patterns plus a corpus rule for quoted tokens, over whole texts."""
    return lifecycle.redacted(docs(spark, d), [*P.REDACTIONS, TOKEN_RULE])


@query("lif_masked_keys", "SELECT event_id, '[REDACTED]' AS token, CAST(user_id AS VARCHAR) AS who FROM events")
def lif_masked_keys(spark, d):
    m = lifecycle.mask_keys(F.create_map(F.lit("token"), F.col("props"), F.lit("who"), F.col("user_id").cast("string")))
    return events(spark, d).select("event_id", m.alias("m")).select("event_id", F.col("m")["token"].alias("token"), F.col("m")["who"].alias("who"))


@query("lif_fingerprints", "SELECT c_custkey, sha256(c_name) AS token_hash, CASE WHEN coalesce(c_name, '') = '' THEN '-' ELSE left(sha256(c_name), 8) END AS fingerprint FROM customer")
def lif_fingerprints(spark, d):
    return lifecycle.fingerprints(read(spark, d, "customer").select("c_custkey", "c_name"), "c_name").drop("c_name")


@query(
    "lif_audit",
    "SELECT event_id, 'audit event=' || ev || ' scope=' || event_type || ' user=' || user_id AS line FROM (SELECT *, CASE event_type WHEN 'view' THEN 'chat_ask' WHEN 'purchase' THEN 'report_export' WHEN 'signup' THEN 'review_created' ELSE 'other' END AS ev FROM events) WHERE ev <> 'other'",
)
def lif_audit(spark, d):
    t = F.col("event_type")
    name = F.when(t == "view", "chat_ask").when(t == "purchase", "report_export").when(t == "signup", "review_created").otherwise("other")
    e = events(spark, d).select("event_id", name.alias("event"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("scope"), t).alias("fields"))
    return lifecycle.audit_lines(e).select("event_id", "line")


LICENCE = "SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '(?i)licen[sc]e|public domain|cc[ -]by|cc0')"


@query("lif_licence", f"SELECT doc_id, line, CASE WHEN contains(lower(line), 'cc0') OR contains(lower(line), 'public domain') THEN true WHEN contains(lower(line), 'nd') OR contains(lower(line), 'nc') THEN false ELSE contains(lower(line), 'cc') AND contains(lower(line), 'by') END AS ok FROM ({LICENCE})")
def lif_licence(spark, d):
    lines = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike("(?i)licen[sc]e|public domain|cc[ -]by|cc0"))
    return lines.withColumn("ok", lifecycle.license_ok(F.col("line")))


HOST = "regexp_extract(url, '://([^/]+)/', 1)"


@query(
    "lif_new_sources",
    f"SELECT host, min(page_id) AS page_id FROM (SELECT page_id, {HOST} AS host, length(html) AS n FROM pages) WHERE n >= 800 AND host <> '' AND host NOT IN (SELECT {HOST} FROM pages WHERE regexp_matches(url, '/de/')) GROUP BY host",
)
def lif_new_sources(spark, d):
    """One page per host not used yet (hosts with a German page count as used)."""
    p = read(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/]+)/", 1).alias("host"), F.length("html").alias("n"), "url")
    used = p.filter(F.col("url").rlike("/de/")).select("host")
    return lifecycle.new_sources(p.select("page_id", "host", "n"), used, "host", "n").select("host", "page_id")


EXC = f"""WITH r AS MATERIALIZED (SELECT page_id, para_idx, starts_with(style, 'Heading') AS h, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM ({HROWS}) WHERE text <> ''),
 s AS MATERIALIZED (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY para_idx) AS sec FROM r),
 heads AS (SELECT page_id, sec, regexp_matches(lower(t), '({'|'.join(['de', 'th'])})') AS good FROM s WHERE h),
 secs AS (SELECT s.page_id, s.sec, string_agg(t, ' ' ORDER BY para_idx) AS txt FROM s JOIN heads g USING (page_id, sec) WHERE g.good AND NOT h AND length(t) > 40 GROUP BY s.page_id, s.sec),
 picked AS (SELECT page_id, string_agg(txt, chr(10) ORDER BY sec) AS txt FROM secs GROUP BY page_id),
 everything AS (SELECT page_id, string_agg(t, ' ' ORDER BY para_idx) AS txt FROM s WHERE NOT h AND length(t) > 60 GROUP BY page_id)
 SELECT p.page_id, a.txt IS NOT NULL AS from_section, left(coalesce(a.txt, b.txt, ''), 6000) AS excerpt FROM pages p LEFT JOIN picked a USING (page_id) LEFT JOIN everything b USING (page_id)"""


@query("lif_section_excerpts", EXC)
def lif_section_excerpts(spark, d):
    """Excerpts with the title keys of this corpus; the excerpt size is the feature's own limit."""
    return sections.excerpts(spread(read(spark, d, "pages")), keys=["de", "th"]).drop("url")
