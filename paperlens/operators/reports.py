"""Report consumption, comparison and revision."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from paperlens import packs
from paperlens.functions.text import cs, literal_map, squeeze, strip
from paperlens.operators import gates
from paperlens.operators.reconcile import beside_texts


def facets(findings: DataFrame) -> DataFrame:
    g, v, c = F.col("grade"), F.col("verdict"), F.col("certainty")
    pred = {
        "n_all": F.lit(True), "n_problem": v == "problem", "n_uncertain": v == "uncertain", "n_pass": v == "pass",
        "n_undetermined": c == "undetermined", "n_grade_a": g == "A", "n_grade_b": g == "B", "n_grade_cd": g.isin("C", "D"),
    }
    return findings.groupBy("doc_id").agg(*[F.count_if(p).alias(k) for k, p in pred.items()])


def top_risk(findings: DataFrame) -> DataFrame:
    """First problem by severity, stable in report order: one min_by per document, combined map-side."""
    rank = literal_map(packs.SEVERITY_RANK)
    p = findings.filter(F.col("verdict") == "problem").withColumn("_k", F.struct(F.element_at(rank, F.col("severity")).alias("r"), "seq"))
    return p.groupBy("doc_id").agg(F.min_by(F.struct("item_id", "severity", "seq"), "_k").alias("t")).select("doc_id", "t.*")


def name_filter(df: DataFrame, column: str, keyword: str) -> DataFrame:
    key = keyword.strip().lower()
    return df if not key else df.filter(F.lower(F.coalesce(column, F.lit(""))).contains(key))


def scoped(resources: DataFrame, grants: DataFrame, keys) -> DataFrame:
    """Rows whose id and owner are both granted; anything else is simply absent."""
    return resources.join(grants, keys, "left_semi")


def problems(findings: DataFrame) -> DataFrame:
    """One row per (document, item) with a problem; the last finding of the item wins."""
    return (
        findings.filter(F.col("verdict") == "problem")
        .groupBy("doc_id", "item_id")
        .agg(F.max_by(F.struct("seq", "severity", "code", F.get("anchors", F.lit(0)).alias("para_idx")), "seq").alias("f"))
        .select("doc_id", "item_id", "f.*")
    )


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """change = resolved / new / kept per (document, item)."""
    b = problems(before).select("doc_id", "item_id", F.col("severity").alias("before_severity"))
    a = problems(after).select("doc_id", "item_id", F.col("severity").alias("after_severity"))
    change = F.when(F.col("after_severity").isNull(), "resolved").when(F.col("before_severity").isNull(), "new").otherwise("kept")
    return b.join(a, ["doc_id", "item_id"], "full_outer").withColumn("change", change)


def compare_detail(diff: DataFrame, status: DataFrame) -> DataFrame:
    return diff.join(status.select("doc_id", "item_id", "status"), ["doc_id", "item_id"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def delta(before: DataFrame, after: DataFrame, diff: DataFrame) -> DataFrame:
    """Per document: totals and high counts on both sides, and how many were resolved, added, kept."""
    def side(f, name):
        p = F.col("verdict") == "problem"
        return f.groupBy("doc_id").agg(F.count_if(p).alias(f"{name}_total"), F.count_if(p & (F.col("severity") == "high")).alias(f"{name}_high"))

    changes = diff.groupBy("doc_id").agg(*[F.count_if(F.col("change") == c).alias(n) for c, n in (("resolved", "resolved"), ("new", "added"), ("kept", "kept"))])
    out = side(before, "before").join(side(after, "after"), "doc_id", "full_outer").join(changes, "doc_id", "left")
    return out.na.fill(0)


# --- revision -------------------------------------------------------------------

def section_targets(fr: DataFrame) -> DataFrame:
    """Adds ``section_target`` (struct item -> paragraph): first body paragraph of the earliest matching section.

    The paragraph right after a heading is its first body paragraph or the next heading; in the
    second case the section has no body and yields null.
    """
    def pick(pattern):
        all_heads = F.filter("paras", lambda p: p["is_heading"] & strip(p["text"]).rlike(cs(pattern)))
        head = F.try_element_at(all_heads, F.lit(1))["para_idx"]
        nxt = F.try_element_at(F.filter("paras", lambda p: p["para_idx"] > head), F.lit(1))
        return F.when(~nxt["is_heading"], nxt["para_idx"])

    return fr.withColumn("section_target", F.struct(*[pick(p).alias(i) for i, p in packs.SECTION_PREFERENCE.items()]))


def revision_plan(findings: DataFrame, fr: DataFrame, offered: DataFrame | None = None) -> DataFrame:
    """One row per problem finding: status, target paragraph, supplement text.

    ``offered`` (doc_id, item_id, text, quote) are externally written supplements; they are accepted
    only when the quote stands in the document, otherwise the item stays pending.
    """
    p = findings.filter(F.col("verdict") == "problem").select("doc_id", "seq", "item_id", "suggestion", F.get("anchors", F.lit(0)).alias("anchor"))
    external = reduce(lambda a, b: a | b, [F.col("item_id").startswith(x) for x in packs.EXTERNAL_PREFIXES])
    manual = external | F.col("item_id").isin(packs.MANUAL_ITEMS + packs.STRUCTURAL_ITEMS)
    st = section_targets(fr).select("doc_id", "section_target")
    preferred = F.coalesce(*[F.when(F.col("item_id") == i, F.col("section_target")[i]) for i in packs.SECTION_PREFERENCE])
    texts = literal_map(packs.REVISION_TEXT)
    out = p.join(st, "doc_id").withColumns(
        {
            "target": F.when(~manual, F.coalesce(preferred, F.col("anchor"))),
            "text": F.coalesce(F.try_element_at(texts, F.col("item_id")), strip(F.col("suggestion"))),
            "manual": manual,
        }
    ).drop("section_target", "suggestion", "anchor")
    if offered is None:
        out = out.withColumn("refused", F.lit(False))
    else:
        ok = accepted_offers(offered, fr)
        out = (
            out.join(offered.select("doc_id", "item_id", F.lit(True).alias("_offered")), ["doc_id", "item_id"], "left")
            .join(ok.select("doc_id", "item_id", F.col("text").alias("_text")), ["doc_id", "item_id"], "left")
            .withColumns({"refused": F.col("_offered").isNotNull() & F.col("_text").isNull(), "text": F.coalesce("_text", "text")})
            .drop("_offered", "_text")
        )
    status = F.when(F.col("manual"), "manual").when(F.col("target").isNull() | F.col("refused") | (F.col("text") == ""), "pending").otherwise("rewritten")
    return out.withColumn("status", status).drop("manual", "refused")


def accepted_offers(offered: DataFrame, fr: DataFrame) -> DataFrame:
    """Offers (doc_id, item_id, text, quote) whose quote (6+ characters) stands in some unit of its own document, ignoring
    spaces and punctuation.  They go to the document's row as one array; no text moves for them."""
    o = offered.filter((F.length(strip(F.col("quote"))) >= packs.REVISION_QUOTE_MIN) & (strip(F.col("text")) != "")).withColumn("needle", squeeze(F.col("quote")))
    return beside_texts(fr, o, "item_id", "text", "quote").select("doc_id", "item_id", "text", "quote")


def item_status(plan: DataFrame) -> DataFrame:
    """(document, item) -> status; any finding of the item gives the same status but for missing targets."""
    return plan.groupBy("doc_id", "item_id").agg(F.max_by("status", "seq").alias("status"))


def revised_frame(fr: DataFrame, plan: DataFrame) -> DataFrame:
    """Frame of the revised documents: supplements appended to their target paragraph in finding order.

    The additions of a document are bounded by its problem findings and travel on one doc_id join.
    """
    adds = (
        plan.filter(F.col("status") == "rewritten")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("target", "seq", "text"))).alias("adds"))
    )
    j = fr.join(adds, "doc_id", "left").withColumn("adds", F.coalesce("adds", F.array().cast("array<struct<target:int,seq:bigint,text:string>>")))
    extra = lambda p: F.array_join(F.transform(F.filter("adds", lambda a: a["target"] == p["para_idx"]), lambda a: a["text"]), "")
    return j.withColumn(
        "paras",
        F.transform("paras", lambda p: p.withField("text", F.concat(p["text"], extra(p)))),
    ).drop("adds")


def markdown(findings: DataFrame, runs: DataFrame | None = None, notes: DataFrame | None = None, items=packs.CHECKLIST) -> DataFrame:
    """doc_id and its whole report as Markdown; findings in report order.

    runs(doc_id, report_id, duration_ms) fills the header, an absent run leaves an empty id and 0 ms; notes(doc_id, notes)
    are the texts of notes.review_notes, both one row per document.  Everything of a document comes from one aggregation.
    """

    def label(table, col):
        return F.coalesce(F.try_element_at(literal_map(table), F.col(col)), F.col(col))

    def filled(template, *values):
        return F.format_string(template, *[F.coalesce(v.cast("string"), F.lit("")) for v in values])

    c = F.col
    shown = c("certainty") != "undetermined"
    at = F.get("anchors", F.lit(0))
    place = F.when(at.isNotNull(), filled(packs.REPORT_PLACE, at)).otherwise(packs.REPORT_NO_PLACE)
    grade = label(packs.GRADE_LABEL, "grade")
    block = F.concat_ws(
        "\n",
        filled(
            packs.REPORT_FINDING, label(packs.SEVERITY_LABEL, "severity"), label(packs.CERTAINTY_LABEL, "certainty"), c("grade"), grade,
            c("headline"), c("item_id"), place, c("confidence"), grade,
        ),
        F.when(c("description") != "", filled(packs.REPORT_DESCRIPTION, c("description"))),
        F.when(c("suggestion") != "", filled(packs.REPORT_SUGGESTION, c("suggestion"))),
        F.lit(""),
    )
    line = F.when(shown, block).otherwise(filled(packs.REPORT_OPEN_LINE, c("item_id"), c("description")))
    per = findings.groupBy("doc_id").agg(
        F.first("source").alias("source"),
        F.sort_array(F.collect_list(F.struct("seq", shown.alias("shown"), "gate_reason", line.alias("line")))).alias("lines"),
        F.count_if(shown & (c("verdict") == "uncertain")).alias("n_doubted"),
        *gates.count_columns(),
        *gates.quality_columns(items),
    )
    per = gates.with_review_rate(per)
    per = per.withColumns({"report_id": F.lit(""), "duration_ms": F.lit(0)}) if runs is None else per.join(runs.select("doc_id", "report_id", "duration_ms"), "doc_id", "left")
    none = F.array().cast("array<string>")
    per = per.withColumn("notes", none) if notes is None else per.join(notes.select("doc_id", "notes"), "doc_id", "left").withColumn("notes", F.coalesce("notes", none))

    listed = lambda keep: F.array_join(F.transform(F.filter("lines", lambda x: x["shown"] == keep), lambda x: x["line"]), "\n")
    reasons = F.transform("lines", lambda x: x["gate_reason"])
    gate_table = F.transform(
        F.array_distinct(reasons), lambda r: F.concat_ws(" ", r, F.size(F.filter("lines", lambda x: x["gate_reason"] == r)).cast("string"))
    )
    parts = [
        filled(
            packs.REPORT_HEAD, c("source"), c("report_id"), F.lit(packs.CHECKLIST_VERSION), *[c(f"n_{s}") for s in (*packs.SEVERITIES, "total")],
            *[c(f"n_{s}") for s in packs.CERTAINTY_LABEL], F.coalesce("duration_ms", F.lit(0)),
        ),
        filled(
            packs.REPORT_CARD, *[c(f"grade_{g}") for g in "abcd"], c("avg_confidence"), c("assessed_items"), c("applicable_items"),
            F.bround(c("review_rate") * 100).cast("int"),
        ),
        filled(packs.REPORT_GATES, F.array_join(gate_table, packs.REPORT_GATE_SEPARATOR)),
        F.when(F.exists("lines", lambda x: x["shown"]), listed(True)),
        F.when(c("n_doubted") > 0, filled(packs.REPORT_UNCERTAIN, c("n_doubted"))),
        F.when(F.exists("lines", lambda x: ~x["shown"]), F.concat(F.lit(packs.REPORT_OPEN + "\n"), listed(False), F.lit("\n"))),
        F.when(F.size("notes") > 0, F.concat_ws("\n", F.lit(packs.REPORT_NOTES), F.array_join(F.transform("notes", lambda n: filled(packs.REPORT_NOTE, n)), "\n"))),
    ]
    return per.select("doc_id", F.concat_ws("\n", *parts).alias("markdown"))
