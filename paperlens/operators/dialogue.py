"""Dialogue context over (conv_id, turn, role, text)."""

from pyspark.sql import DataFrame, Window, functions as F

from paperlens import packs
from paperlens.functions.text import is_blank


def newest(messages: DataFrame, keep: int) -> DataFrame:
    """Newest ``keep`` messages per conversation; the limit runs in every task before the shuffle."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")


def keep_newest(messages: DataFrame, sessions: DataFrame, keep: int) -> DataFrame:
    """Newest messages of live sessions only."""
    return newest(messages.join(sessions, "conv_id", "left_semi"), keep)


def truncate_history(messages: DataFrame, max_turns=10, max_chars=8000, system_chars=0) -> DataFrame:
    """conv_id, kept (ordered array), truncated.

    At most 2*max_turns newest messages; a leading non-user message goes; then whole user+assistant
    pairs go from the front until the characters fit, but a sole message is never dropped.
    Groups are at most 2*max_turns long when they are collected.
    """
    total = messages.groupBy("conv_id").agg(F.count("*").alias("n_all"))
    recent = newest(messages, max_turns * 2) if max_turns > 0 else messages.limit(0)
    h = recent.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    j = total.join(h, "conv_id", "left").withColumn("h", F.coalesce("h", F.array().cast("array<struct<turn:bigint,role:string,text:string>>")))
    j = j.withColumn("u", F.when((F.size("h") > 0) & (F.get("h", F.lit(0))["role"] != "user"), F.slice("h", F.lit(2), F.greatest(F.size("h") - 1, F.lit(0)))).otherwise(F.col("h")))
    chars = lambda a: F.aggregate(a, F.lit(0), lambda s, m: s + F.length(F.coalesce(m["text"], F.lit(""))))
    rest = lambda k: F.slice(F.col("u"), k + 1, F.greatest(F.size("u") - k, F.lit(0)))
    cuts = F.transform(F.sequence(F.lit(0), F.lit(max(max_turns, 0))), lambda i: i * 2)
    fits = F.filter(cuts, lambda k: (F.size("u") - k <= 1) | (chars(rest(k)) + system_chars <= max_chars))
    j = j.withColumn("cut", F.get(fits, F.lit(0)))
    return j.select("conv_id", rest(F.col("cut")).alias("kept"), (F.greatest(F.size("u") - F.col("cut"), F.lit(0)) < F.col("n_all")).alias("truncated"))


def build_messages(truncated: DataFrame, questions: DataFrame, system_text: str) -> DataFrame:
    """conv_id, pos, role, content: system message, kept history, the current question."""
    m = truncated.join(questions, "conv_id")
    msg = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    rows = F.concat(
        F.array(msg(F.lit("system"), F.lit(system_text))),
        F.transform("kept", lambda x: msg(x["role"], x["text"])),
        F.array(msg(F.lit("user"), F.col("question"))),
    )
    return m.select("conv_id", F.posexplode(rows).alias("pos", "m")).select("conv_id", "pos", "m.*")


def listing(messages: DataFrame) -> DataFrame:
    return messages.select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn")


def question_context(documents: DataFrame, max_chars: int) -> DataFrame:
    """Whole non-blank lines from the start while they fit (length + 1 each); an oversized first line is kept alone."""
    lines = F.filter(F.split("text", "\n"), lambda t: ~is_blank(t))
    d = documents.select("doc_id", lines.alias("lines"))
    state = lambda used, n, full: F.struct(used.alias("used"), n.alias("n"), full.alias("full"))
    walk = F.aggregate(
        "lines",
        state(F.lit(0), F.lit(0), F.lit(False)),
        lambda s, t: F.when(s["full"], s)
        .when(s["used"] + F.length(t) + 1 > max_chars, state(s["used"], F.greatest(s["n"], F.lit(1)), F.lit(True)))
        .otherwise(state(s["used"] + F.length(t) + 1, s["n"] + 1, F.lit(False))),
    )
    d = d.withColumn("w", walk)
    body = F.array_join(F.slice("lines", F.lit(1), F.col("w.n")), "\n")
    return d.select(
        "doc_id",
        F.col("w.n").alias("n_lines"),
        F.col("w.full").alias("truncated"),
        F.when(F.col("w.full"), F.concat(body, F.lit(packs.QA_CUT_NOTE))).otherwise(body).alias("context"),
    )


def question_scope(requests: DataFrame, findings: DataFrame) -> DataFrame:
    """Scope of each question: a finding, the full text, or an error when the named finding is gone.

    requests(doc_id, finding_seq nullable, question); an unknown finding never falls back to full text.
    """
    f = findings.select("doc_id", F.col("seq").alias("finding_seq"), "item_id", "headline", F.get("anchors", F.lit(0)).alias("anchor"))
    j = requests.join(f, ["doc_id", "finding_seq"], "left")
    scope = F.when(F.col("finding_seq").isNull(), "fulltext").when(F.col("item_id").isNull(), "finding_not_found").otherwise("finding")
    return j.withColumn("scope", scope)
