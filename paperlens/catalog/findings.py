"""Model reconciliation, gates, reports, comparison, revision, evaluation."""

from pyspark.sql import functions as F

from paperlens import packs as P
from paperlens.catalog import query
from paperlens.catalog.common import docs, facts, kept_facts, once, overlay_frame, planned, rule_rows, scored, tagged
from paperlens.catalog.structure import IMAGE_CAPTIONS
from paperlens.operators import elements, evaluate, gates, notes, reconcile, reports, structure
from paperlens.operators.quota import micros
from paperlens.oracle.sql import inlist, q, sql
from paperlens.plans.compare import review_and_compare
from paperlens.plans.review import document_facts, draft, review
from paperlens.sources import verdicts as V
from paperlens.sources.intake import read, unnest
from paperlens.sources.sinks import staged


def parsed(spark, d):
    return V.parse_verdicts(V.synthetic_payloads(docs(spark, d)))


def verdicts(spark, d):
    return reconcile.normalize_ids(parsed(spark, d).filter("valid"))


def second(spark, d):
    """A second opinion by formula on the item number of the first."""
    k = F.regexp_extract("headline", r"H(\d+)", 1).cast("int")
    other = F.get(F.array(F.lit("problem"), F.lit("pass"), F.lit("problem")), F.pmod(F.col("doc_id") + k, F.lit(3)).cast("int"))
    return verdicts(spark, d).withColumn("verdict", other)


def with_model(spark, d):
    return planned(spark, d, "with_model", lambda: review(facts=kept_facts(spark, d), verdicts=verdicts(spark, d), demote=True))


# --- verdict ingest and reconciliation ---------------------------------------------------

@query("src_verdicts", sql("SELECT doc_id, mseq, raw_id, verdict, severity, headline, description, suggestion, verdict <> 'maybe' AS valid FROM vraw"))
def src_verdicts(spark, d):
    return parsed(spark, d)


IMG = """SELECT i.doc_id, i.img_idx, (i.doc_id * 37 + i.img_idx * 11) % 5 AS nv, (i.doc_id + i.img_idx) % 3 AS cz, ((i.doc_id * 13) % 8) * 1048576 AS byte_size,
  coalesce(max(p.para_idx) FILTER (WHERE p.para_idx <= i.idx), min(p.para_idx), 0) AS anchor FROM img i LEFT JOIN paras p ON p.doc_id = i.doc_id GROUP BY i.doc_id, i.img_idx, i.idx"""


@query(
    "src_image_readings",
    sql(f"""SELECT doc_id, img_idx, 'R-FIG-02' AS item_id, 'uncertain' AS verdict, '图内数值识读线索：第 ' || (img_idx + 1) || ' 张插图' AS headline,
      '模型识读图内数值：' || CASE WHEN nv > 0 THEN array_to_string(list_transform(range(nv), lambda j: '0.' || j), '、') ELSE '未识别到明确数值' END || '。' || CASE WHEN cz = 0 THEN ' 疑点：坐标轴缺单位' ELSE '' END || ' 该结论来自图像识读，需人工复核。' AS description, anchor, nv AS n_values
      FROM ({IMG}) WHERE img_idx IN (0, 1, 2, 3) AND byte_size BETWEEN 1 AND 4194304 AND (nv > 0 OR cz = 0)"""),
)
def src_image_readings(spark, d):
    """Readings written by formula for every image of the overlay, then ingested."""
    return V.image_findings(readings(spark, d).withColumn("caption", F.lit("")))


def readings(spark, d):
    i = structure.images(overlay_frame(spark, d))
    nv = F.pmod(F.col("doc_id") * 37 + F.col("img_idx") * 11, F.lit(5)).cast("int")
    vals = F.when(nv > 0, F.transform(F.sequence(F.lit(0), F.greatest(nv - 1, F.lit(0))), lambda j: F.concat(F.lit("0."), j.cast("string")))).otherwise(F.array(F.lit(" ")))
    concern = F.when(F.pmod(F.col("doc_id") + F.col("img_idx"), F.lit(3)) == 0, "坐标轴缺单位")
    size = (F.pmod(F.col("doc_id") * 13, F.lit(8)) * 1048576).alias("byte_size")
    return i.select("doc_id", "img_idx", "anchor", size, F.to_json(F.struct(vals.alias("values"), concern.alias("concern"))).alias("content"))


@query("mod_item_ids", sql("SELECT doc_id, mseq, raw_id, item_id FROM verd"))
def mod_item_ids(spark, d):
    return verdicts(spark, d).select("doc_id", "mseq", "raw_id", "item_id")


@query("mod_tier_routing", sql("SELECT a.doc_id, count(*) FILTER (WHERE judge = 'rule') AS rule_items, count(*) FILTER (WHERE judge <> 'rule') AS model_items FROM applic a GROUP BY a.doc_id"))
def mod_tier_routing(spark, d):
    t = elements.paper_type(overlay_frame(spark, d)).select("doc_id", "paper_type")
    items = F.array(*[F.struct(F.lit(r[0]).alias("item_id"), F.lit(r[3]).alias("judge")) for r in P.CHECKLIST])
    kept = F.filter(items, lambda i: elements.applicable(i["item_id"], F.col("paper_type")))
    n = lambda c: F.size(F.filter(kept, c)).cast("bigint")
    return t.select("doc_id", n(lambda i: i["judge"] == "rule").alias("rule_items"), n(lambda i: i["judge"] != "rule").alias("model_items"))


MERGE = ["doc_id", "seq", "engine", "item_id", "verdict", "severity", "description", "suggestion", "llm_verdict", "conflict", "vetoed_llm"]


@query("mod_merge", sql("SELECT " + ", ".join(MERGE) + " FROM fm0 WHERE phase <= 1"))
def mod_merge(spark, d):
    return draft(facts(spark, d), verdicts(spark, d)).filter("phase <= 1").select(*MERGE)


@query("mod_dual_check", sql("SELECT doc_id, mseq, item_id, verdict, dual_check, dual_verdict FROM dual"))
def mod_dual_check(spark, d):
    return reconcile.dual_check(*[reconcile.restrict(v, facts(spark, d)) for v in (verdicts(spark, d), second(spark, d))]).select("doc_id", "mseq", "item_id", "verdict", "dual_check", "dual_verdict")


@query("mod_dual_review", sql("SELECT doc_id, seq, item_id, verdict, confidence, grade, gate_reason FROM fd"))
def mod_dual_review(spark, d):
    r = review(facts=kept_facts(spark, d), verdicts=verdicts(spark, d), second=second(spark, d), demote=True)
    return r.select("doc_id", "seq", "item_id", "verdict", "confidence", "grade", "gate_reason")


SQUEEZE = f"lower(regexp_replace({{}}, {q(P.QUOTE_NOISE)}, '', 'g'))"
_KW = [(i, w.lower()) for i, ws in P.ITEM_KEYWORDS.items() for w in ws]
PEND = "SELECT doc_id, seq, item_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn FROM fm0 WHERE engine = 'llm' AND verdict = 'problem'"
QUOTES = f"SELECT p.doc_id, p.seq, p.item_id, p.rn, b.k AS position, b.sentence AS quote FROM ({PEND}) p JOIN bank b ON (b.k + p.doc_id + p.rn) % 2 = 0 WHERE p.rn <= {P.VERIFY_MAX_ITEMS}"
KEYED = "EXISTS (SELECT 1 FROM (VALUES " + ", ".join(f"({q(i)}, {q(w)})" for i, w in _KW) + ") kw(item_id, w) WHERE kw.item_id = x.item_id AND contains(lower(x.quote), kw.w))"
FOUND = f"SELECT x.doc_id, x.seq, x.item_id, x.position, x.quote, arg_min(u.para_idx, u.pos) AS para_idx FROM ({QUOTES}) x JOIN units u ON u.doc_id = x.doc_id AND contains({SQUEEZE.format('u.text')}, {SQUEEZE.format('x.quote')}) WHERE length({SQUEEZE.format('x.quote')}) >= {P.QUOTE_MIN} AND {KEYED} GROUP BY ALL"
VERIFIED = f"SELECT doc_id, seq, item_id, arg_max(para_idx, position) AS para_idx, left(arg_max(quote, position), {P.QUOTE_SHOWN}) AS quote FROM ({FOUND}) GROUP BY ALL"


def quotes(spark, d):
    """Quotes by formula: half of the bank's sentences for every pending finding, in the order of the bank."""
    rn = F.explode(F.sequence(F.lit(1), F.lit(P.VERIFY_MAX_ITEMS))).alias("rn")
    bank = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(b).alias("quote")) for k, b in enumerate(P.BANK)])
    base = docs(spark, d).select("doc_id", rn)
    return unnest(base, F.filter(bank, lambda b: F.pmod(b["position"] + F.col("doc_id") + F.col("rn"), F.lit(2)) == 0), "doc_id", "rn")


@query("mod_quote_verification", sql(VERIFIED))
def mod_quote_verification(spark, d):
    f = draft(facts(spark, d), verdicts(spark, d))
    return reconcile.verify_quotes_in_rows(reconcile.pending_quotes(f), quotes(spark, d), overlay_frame(spark, d))


@query("mod_quoted_review", sql(f"SELECT f.doc_id, f.seq, f.item_id, v.para_idx AS quote_at, v.quote AS verified_quote FROM fm0 f LEFT JOIN ({VERIFIED}) v ON v.doc_id = f.doc_id AND v.seq = f.seq"))
def mod_quoted_review(spark, d):
    """Every finding of the review with model verdicts, with the quote that was verified for it and where it stands."""
    r = review(overlay_frame(spark, d), verdicts(spark, d), quotes=quotes(spark, d), facts=facts(spark, d))
    at = F.when(F.col("evidence_gate") == "quote_verified", F.get("anchors", F.lit(0)))
    return r.select("doc_id", "seq", "item_id", at.alias("quote_at"), "verified_quote")


@query("mod_rule_anchors", sql("SELECT doc_id, item_id, string_agg(CAST(para_idx AS VARCHAR), ',' ORDER BY seq) AS anchors FROM rulef GROUP BY doc_id, item_id"))
def mod_rule_anchors(spark, d):
    """Anchors of an item's rule findings in order; collected per document and item inside one document's findings."""
    r = rule_rows(spark, d).groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_list(F.struct("seq", "para_idx"))).alias("a"))
    return r.select("doc_id", "item_id", F.array_join(F.transform("a", lambda x: x["para_idx"].cast("string")), ",").alias("anchors"))


@query("mod_usage_notes", sql("SELECT doc_id, count(*) FILTER (WHERE verdict <> 'maybe') AS n_valid, count(*) FILTER (WHERE verdict = 'maybe') AS n_invalid, CASE WHEN count(*) FILTER (WHERE verdict = 'maybe') > 0 THEN 'routed_by_tier,invalid_dropped' ELSE 'routed_by_tier' END AS notes FROM vraw GROUP BY doc_id"))
def mod_usage_notes(spark, d):
    return reconcile.usage_notes(parsed(spark, d)).withColumn("notes", F.array_join("notes", ","))


# --- gates ---------------------------------------------------------------------------------

def flat(df, *cols):
    return df.select(*cols)


ANCH = "array_to_string(anchors, ',')"


@query("gat_evidence", sql(f"SELECT doc_id, seq, item_id, verdict, certainty, {ANCH} AS anchors, array_to_string(evidence, ',') AS evidence, gate1 AS evidence_gate FROM fm1 WHERE phase <= 1"))
def gat_evidence(spark, d):
    f = gates.attach_evidence(draft(facts(spark, d), verdicts(spark, d))).filter("phase <= 1")
    return f.select("doc_id", "seq", "item_id", "verdict", "certainty", F.array_join(F.col("anchors").cast("array<string>"), ",").alias("anchors"), F.array_join("evidence", ",").alias("evidence"), "evidence_gate")


@query("gat_judge_tiers", sql("SELECT doc_id, seq, item_id, verdict, description, advisory FROM fm2 WHERE engine = 'llm'"))
def gat_judge_tiers(spark, d):
    f = gates.judge_tiers(gates.attach_evidence(draft(facts(spark, d), verdicts(spark, d))))
    return f.filter("engine = 'llm'").select("doc_id", "seq", "item_id", "verdict", "description", "advisory")


@query("gat_figure_demotion", sql("SELECT doc_id, item_id, verdict, description FROM fr WHERE evidence_gate = 'figures_unparsed'"))
def gat_figure_demotion(spark, d):
    return scored(spark, d).filter(F.col("evidence_gate") == "figures_unparsed").select("doc_id", "item_id", "verdict", "description")


@query("gat_unassessed", sql("SELECT doc_id, seq, item_id, description FROM fr WHERE code = 'UNASSESSED'"))
def gat_unassessed(spark, d):
    return scored(spark, d).filter(F.col("code") == "UNASSESSED").select("doc_id", "seq", "item_id", "description")


@query("gat_unassessed_with_model", sql("SELECT doc_id, item_id FROM fm WHERE code = 'UNASSESSED'"))
def gat_unassessed_with_model(spark, d):
    return with_model(spark, d).filter(F.col("code") == "UNASSESSED").select("doc_id", "item_id")


@query("gat_reason", sql("SELECT doc_id, seq, gate_reason FROM fm"))
def gat_reason(spark, d):
    return with_model(spark, d).select("doc_id", "seq", "gate_reason")


@query("gat_confidence", sql("SELECT doc_id, seq, item_id, confidence FROM fm"))
def gat_confidence(spark, d):
    return with_model(spark, d).select("doc_id", "seq", "item_id", "confidence")


@query("gat_grade", sql("SELECT doc_id, seq, item_id, grade FROM fm"))
def gat_grade(spark, d):
    return with_model(spark, d).select("doc_id", "seq", "item_id", "grade")


def card(f):
    return f"""SELECT doc_id, count(*) FILTER (WHERE grade = 'A') AS grade_a, count(*) FILTER (WHERE grade = 'B') AS grade_b, count(*) FILTER (WHERE grade = 'C') AS grade_c, count(*) FILTER (WHERE grade = 'D') AS grade_d,
   coalesce((2 * sum(CAST(round(confidence * 10000) AS BIGINT)) FILTER (WHERE certainty <> 'undetermined') + count(*) FILTER (WHERE certainty <> 'undetermined')) // nullif(2 * count(*) FILTER (WHERE certainty <> 'undetermined'), 0) / 10000, 0)::DOUBLE AS avg_confidence, ai AS assessed_items, greatest(n_items, ai) AS applicable_items, round(ai / greatest(n_items, ai), 4) AS review_rate FROM (
   SELECT f.*, coalesce(c.ai, 0) AS ai, CASE WHEN f.paper_type = 'review' THEN 4 ELSE 17 END AS n_items FROM {f} f LEFT JOIN (
     SELECT x.doc_id, count(DISTINCT x.item_id) AS ai FROM {f} x JOIN applic a ON a.doc_id = x.doc_id AND a.item_id = x.item_id WHERE x.certainty <> 'undetermined' GROUP BY 1) c ON c.doc_id = f.doc_id) GROUP BY doc_id, ai, n_items"""


@query("gat_quality_card", sql(card("fr")))
def gat_quality_card(spark, d):
    return gates.quality(scored(spark, d))


@query("gat_gate_reasons", sql("SELECT doc_id, gate_reason, count(*) AS n FROM fm GROUP BY ALL"))
def gat_gate_reasons(spark, d):
    return gates.gate_reasons(with_model(spark, d))


def count_sql(f):
    c = lambda p: f"count(*) FILTER (WHERE {p})"
    cols = [f"{c(f'''verdict = 'problem' AND severity = '{s}' ''')} AS n_{s}" for s in P.SEVERITIES]
    cols += [f"{c('verdict = ' + q('problem'))} AS n_total"] + [f"{c('verdict = ' + q(v))} AS n_{v}" for v in ("pass", "not_applicable", "uncertain")]
    cols += [f"{c('certainty = ' + q(v))} AS n_{v}" for v in ("deterministic", "suspected", "undetermined")] + [f"{c('certainty <> ' + q('undetermined'))} AS n_assessed"]
    return f"SELECT doc_id, {', '.join(cols)} FROM {f} GROUP BY doc_id"


@query("gat_counts", sql(count_sql("fr")))
def gat_counts(spark, d):
    return gates.counts(scored(spark, d))


FULL = ["doc_id", "seq", "engine", "item_id", "code", "verdict", "severity", "certainty", "headline", "description", "suggestion", "evidence_gate", "gate_reason", "confidence", "grade"]


@query("gat_review_rules", sql("SELECT " + ", ".join(FULL) + f", {ANCH} AS anchors FROM fr"))
def gat_review_rules(spark, d):
    """The whole rules-only review pipeline, one row per finding."""
    return review(facts=facts(spark, d), demote=True).select(*FULL, F.array_join(F.col("anchors").cast("array<string>"), ",").alias("anchors"))


@query("gat_review_model", sql(count_sql("fm")))
def gat_review_model(spark, d):
    """The whole pipeline with model verdicts, one report row per document."""
    return gates.counts(review(facts=facts(spark, d), verdicts=verdicts(spark, d), demote=True))


IMAGE_FULL = ["doc_id", "seq", "engine", "item_id", "verdict", "severity", "certainty", "headline", "description", "suggestion", "advisory", "evidence_gate", "gate_reason", "confidence", "grade"]
IMAGE_ROWS = f"""SELECT i.doc_id, {5 << 40} + i.img_idx AS seq, 'llm' AS engine, 'R-FIG-02' AS item_id, 'uncertain' AS verdict, 'low' AS severity, 'suspected' AS certainty,
   '图内数值识读线索：' || CASE WHEN c.caption <> '' THEN c.caption ELSE '第 ' || (i.img_idx + 1) || ' 张插图' END AS headline,
   '模型识读图内数值：' || CASE WHEN nv > 0 THEN array_to_string(list_transform(range(nv), lambda j: '0.' || j), '、') ELSE '未识别到明确数值' END || '。' || CASE WHEN cz = 0 THEN ' 疑点：坐标轴缺单位' ELSE '' END || ' 该结论来自图像识读，需人工复核。' AS description,
   '对照图像与正文/表体的报数，确认统计量口径一致。' AS suggestion, true AS advisory, 'vision_read' AS evidence_gate, 'advisory' AS gate_reason, 0.27::DOUBLE AS confidence, 'D' AS grade, CAST(anchor AS VARCHAR) AS anchors
  FROM ({IMG}) i JOIN ({IMAGE_CAPTIONS}) c ON c.doc_id = i.doc_id AND c.img_idx = i.img_idx WHERE i.img_idx < 4 AND byte_size BETWEEN 1 AND 4194304 AND (nv > 0 OR cz = 0)"""


@query("gat_review_images", sql("SELECT " + ", ".join(IMAGE_FULL) + f", {ANCH} AS anchors FROM fm UNION ALL {IMAGE_ROWS}"))
def gat_review_images(spark, d):
    """The whole pipeline with model verdicts and image readings, one row per finding; one join on doc_id carries both."""
    r = review(facts=facts(spark, d), verdicts=verdicts(spark, d), readings=V.parse_readings(readings(spark, d)), demote=True)
    return r.select(*IMAGE_FULL, F.array_join(F.col("anchors").cast("array<string>"), ",").alias("anchors"))


_USED = "(doc_id % 10) <> 3"
_NOTE = {k: q(v) for k, v in P.NOTES.items()}


def _filled(name, n=None, t=None, image=None):
    out = _NOTE[name]
    for mark, value in (("n", n), ("t", t), ("image", image), ("mode", q(P.NOTE_DEMOTED))):
        out = out if value is None else f"replace({out}, '{{{mark}}}', CAST({value} AS VARCHAR))"
    return out


IMAGES_READ = f"SELECT doc_id, count(*) AS images, count(*) FILTER (WHERE nv > 0) AS facts FROM ({IMG}) WHERE img_idx < 4 AND byte_size BETWEEN 1 AND 4194304 AND (nv > 0 OR cz = 0) GROUP BY 1"
NO_IMAGES = "SELECT CAST(NULL AS BIGINT) AS doc_id, 0 AS images, 0 AS facts WHERE false"


def notes_sql(images):
    """Notes and token sums of the review with model verdicts; `images` counts the readings of a document."""
    return f"""SELECT doc_id, concat_ws(chr(10), CASE WHEN paper_type = 'review' THEN {_filled('review_paper', '17 - applicable')} END, CASE WHEN used THEN {_filled('routed', 'rule_items', 'applicable - rule_items')} END, CASE WHEN used THEN {_NOTE['directed']} END,
   CASE WHEN used AND facts > 0 THEN {_filled('facts', 'facts')} END, CASE WHEN used AND invalid > 0 THEN {_filled('invalid', 'invalid')} END, CASE WHEN NOT used THEN {_NOTE['unavailable']} END,
   CASE WHEN opened > 0 THEN {_filled('unassessed', 'opened')} END, CASE WHEN numeric > 0 THEN {_filled('numeric', 'numeric')} END, CASE WHEN images > 0 THEN {_filled('images', 'images')} END,
   CASE WHEN mentions > 0 AND tables > 0 THEN {_filled('figures_tables', 'mentions', 'tables', 'image_note')} WHEN mentions > 0 THEN {_filled('figures', 'mentions', None, 'image_note')} END) AS notes,
   CASE WHEN used THEN 1000 + doc_id % 100 ELSE 0 END + 11 * images AS tokens_in, CASE WHEN used THEN 200 ELSE 0 END + 7 * images AS tokens_out, CASE WHEN used THEN doc_id % 3 ELSE 0 END AS retries
  FROM (SELECT *, CASE WHEN images > 0 THEN {q(P.NOTE_IMAGES_READ)} ELSE {q(P.NOTE_IMAGES_UNREAD)} END AS image_note FROM (
   SELECT p.doc_id, p.paper_type, {_USED.replace('doc_id', 'p.doc_id')} AS used, coalesce(a.applicable, 0) AS applicable, coalesce(a.rule_items, 0) AS rule_items, coalesce(f.opened, 0) AS opened, coalesce(f.numeric, 0) AS numeric, coalesce(i.images, 0) AS images, coalesce(i.facts, 0) AS facts,
     coalesce(v.invalid, 0) AS invalid, coalesce(m.figure_mentions, 0) AS mentions, coalesce(t.tables, 0) AS tables FROM ptype p
    LEFT JOIN (SELECT doc_id, count(*) AS applicable, count(*) FILTER (WHERE judge = 'rule') AS rule_items FROM applic GROUP BY 1) a ON a.doc_id = p.doc_id
    LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE certainty = 'undetermined') AS opened, count(*) FILTER (WHERE phase = 3) AS numeric FROM fm GROUP BY 1) f ON f.doc_id = p.doc_id
    LEFT JOIN ({images}) i ON i.doc_id = p.doc_id
    LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE verdict = 'maybe') AS invalid FROM vraw GROUP BY 1) v ON v.doc_id = p.doc_id
    LEFT JOIN figcount m ON m.doc_id = p.doc_id LEFT JOIN (SELECT doc_id, count(*) AS tables FROM tbl GROUP BY 1) t ON t.doc_id = p.doc_id))"""


def usage(spark, d, images=True):
    """Model calls by formula: a review call of every document, of which each tenth failed, and one call per image read."""
    n = lambda c: c.cast("bigint")
    review = docs(spark, d).select("doc_id", F.lit("review").alias("call"), (F.pmod("doc_id", F.lit(10)) != 3).alias("ok"), n(1000 + F.pmod("doc_id", F.lit(100))).alias("tokens_in"), n(F.lit(200)).alias("tokens_out"), n(F.pmod("doc_id", F.lit(3))).alias("retries"))
    if not images:
        return review
    image = V.parse_readings(readings(spark, d)).select("doc_id", F.lit("image").alias("call"), F.lit(True).alias("ok"), n(F.lit(11)).alias("tokens_in"), n(F.lit(7)).alias("tokens_out"), n(F.lit(9)).alias("retries"))
    return review.unionByName(image)


@query("mod_review_notes", sql(notes_sql(IMAGES_READ)))
def mod_review_notes(spark, d):
    """Notes and token sums of the review with model verdicts and image readings."""
    f = review(facts=facts(spark, d), verdicts=verdicts(spark, d), readings=V.parse_readings(readings(spark, d)), demote=True)
    out = notes.review_notes(f, facts(spark, d), parsed(spark, d), usage(spark, d), use_model=True, directed=True, demote=True)
    return out.withColumn("notes", F.array_join("notes", "\n"))


# --- report consumption ----------------------------------------------------------------------

@query("rep_facets", sql("SELECT doc_id, count(*) AS n_all, count(*) FILTER (WHERE verdict = 'problem') AS n_problem, count(*) FILTER (WHERE verdict = 'uncertain') AS n_uncertain, count(*) FILTER (WHERE verdict = 'pass') AS n_pass, count(*) FILTER (WHERE certainty = 'undetermined') AS n_undetermined, count(*) FILTER (WHERE grade = 'A') AS n_grade_a, count(*) FILTER (WHERE grade = 'B') AS n_grade_b, count(*) FILTER (WHERE grade IN ('C', 'D')) AS n_grade_cd FROM fr GROUP BY doc_id"))
def rep_facets(spark, d):
    return reports.facets(scored(spark, d))


@query("rep_top_risk", sql("SELECT doc_id, item_id, severity, seq FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END, seq) AS rn FROM fr WHERE verdict = 'problem') WHERE rn = 1"))
def rep_top_risk(spark, d):
    return reports.top_risk(scored(spark, d))


def _label(table, column):
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {column} END"


_CONFIDENT = "'- 置信度：' || confidence || '（' || grade_label || '）'"
MARKDOWN = f"""
 WITH lined AS (SELECT *, certainty <> 'undetermined' AS shown, CASE WHEN certainty = 'undetermined' THEN '- [' || item_id || '] ' || description ELSE
   '## [' || {_label(P.SEVERITY_LABEL, 'severity')} || '·' || {_label(P.CERTAINTY_LABEL, 'certainty')} || '·' || grade || ' ' || grade_label || '] ' || headline || chr(10)
   || '- 清单条目：' || item_id || chr(10) || '- 原文定位：' || coalesce('段落 ' || anchors[1], '位置未定') || chr(10) || {_CONFIDENT} || chr(10)
   || CASE WHEN description <> '' THEN '- 说明：' || description || chr(10) ELSE '' END || CASE WHEN suggestion <> '' THEN '- 建议：' || suggestion || chr(10) ELSE '' END END AS line
   FROM (SELECT *, {_label(P.GRADE_LABEL, 'grade')} AS grade_label FROM fm)),
 per AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY seq) FILTER (WHERE shown) AS blocks, string_agg(line, chr(10) ORDER BY seq) FILTER (WHERE NOT shown) AS opened,
   count(*) FILTER (WHERE shown AND verdict = 'uncertain') AS doubted FROM lined GROUP BY doc_id),
 reasons AS (SELECT doc_id, string_agg(gate_reason || ' ' || n, '、' ORDER BY first_seq) AS gate_table FROM (SELECT doc_id, gate_reason, count(*) AS n, min(seq) AS first_seq FROM fm GROUP BY ALL) GROUP BY doc_id)
 SELECT p.doc_id, '# 方法学审查报告 · ' || s.source || chr(10) || chr(10) || '- 报告 ID：rep-' || p.doc_id || chr(10) || '- 清单版本：1.0' || chr(10)
  || '- 问题统计：严重 ' || n_high || ' / 中等 ' || n_mid || ' / 轻微 ' || n_low || '（共 ' || n_total || '）' || chr(10)
  || '- 确定性统计：确定性 ' || n_deterministic || ' / 疑似 ' || n_suspected || ' / 未判定 ' || n_undetermined || chr(10) || '- 审查耗时：' || (100 + p.doc_id % 900) || ' ms' || chr(10) || chr(10)
  || '## 输出质量卡' || chr(10) || '- 分级分布：A 高置信 ' || grade_a || ' / B 中置信 ' || grade_b || ' / C 低置信 ' || grade_c || ' / D 待确认 ' || grade_d || chr(10)
  || '- 平均置信度：' || avg_confidence || '（0–1，越高越可采信）' || chr(10)
  || '- 审查率：' || assessed_items || '/' || applicable_items || ' = ' || CAST(round_even(review_rate * 100, 0) AS INTEGER) || '%（已评估条目 / 适用条目）' || chr(10) || chr(10)
  || '- 门控分布：' || gate_table || chr(10) || coalesce(chr(10) || blocks, '')
  || CASE WHEN doubted > 0 THEN chr(10) || '> 其中存疑（需人工复核）' || doubted || ' 项，见上文带「疑似 / 未判定」标签的条目。' || chr(10) ELSE '' END
  || coalesce(chr(10) || '## 本项未能判定（证据不足，不计入问题数）' || chr(10) || opened || chr(10), '')
  || CASE WHEN n.notes <> '' THEN chr(10) || '## 备注' || chr(10) || '- ' || replace(n.notes, chr(10), chr(10) || '- ') ELSE '' END AS markdown
 FROM per p JOIN reasons USING (doc_id) JOIN docs s ON s.doc_id = p.doc_id JOIN ({count_sql('fm')}) k ON k.doc_id = p.doc_id JOIN ({card('fm')}) c ON c.doc_id = p.doc_id
 LEFT JOIN ({notes_sql(NO_IMAGES)}) n ON n.doc_id = p.doc_id"""


@query("src_markdown", sql(f"SELECT doc_id, markdown FROM ({MARKDOWN})"))
def src_markdown(spark, d):
    """Whole reports of the review with model verdicts: header of the run, card, findings, open items and notes."""
    f = with_model(spark, d)
    runs = docs(spark, d).select("doc_id", F.concat(F.lit("rep-"), F.col("doc_id").cast("string")).alias("report_id"), (100 + F.pmod("doc_id", F.lit(900))).alias("duration_ms"))
    told = notes.review_notes(f, facts(spark, d), parsed(spark, d), usage(spark, d, images=False), use_model=True, directed=True, demote=True)
    return reports.markdown(f, runs, told)


# --- compare and revise ------------------------------------------------------------------------

PROB = "SELECT doc_id, item_id, arg_max(severity, seq) AS severity, arg_max(code, seq) AS code, max(seq) AS seq, arg_max(anchors[1], seq) AS para_idx FROM {} WHERE verdict = 'problem' GROUP BY doc_id, item_id"


@query("cmp_problem_map", sql(PROB.format("fr")))
def cmp_problem_map(spark, d):
    return reports.problems(scored(spark, d))


DIFF = f"SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(b.item_id, a.item_id) AS item_id, b.severity AS before_severity, a.severity AS after_severity, CASE WHEN a.doc_id IS NULL THEN 'resolved' WHEN b.doc_id IS NULL THEN 'new' ELSE 'kept' END AS change FROM ({PROB.format('fr')}) b FULL JOIN ({PROB.format('fm')}) a ON a.doc_id = b.doc_id AND a.item_id = b.item_id"


@query("cmp_diff", sql(DIFF))
def cmp_diff(spark, d):
    """Rules-only reports against the reports with model verdicts."""
    return reports.compare(scored(spark, d), with_model(spark, d))


PREF = "(VALUES " + ", ".join(f"({q(i)}, {q(p)})" for i, p in P.SECTION_PREFERENCE.items()) + ") pref(item_id, pattern)"
TARGET = f"""SELECT h.doc_id, h.item_id, CASE WHEN NOT n.is_heading THEN n.para_idx END AS target FROM (
   SELECT p.doc_id, pref.item_id, min(p.para_idx) AS head FROM paras p JOIN {PREF} ON p.is_heading AND regexp_matches(p.s, pref.pattern) GROUP BY 1, 2) h
   JOIN (SELECT doc_id, para_idx, lead(para_idx) OVER w AS nxt FROM paras WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx)) l ON l.doc_id = h.doc_id AND l.para_idx = h.head LEFT JOIN paras n ON n.doc_id = h.doc_id AND n.para_idx = l.nxt"""
RTEXT = "(VALUES " + ", ".join(f"({q(i)}, {q(t)})" for i, t in P.REVISION_TEXT.items()) + ") rt(item_id, body)"
TRIAGE = f"""SELECT f.doc_id, f.seq, f.item_id, m.manual, CASE WHEN NOT m.manual THEN coalesce(t.target, f.anchors[1]) END AS target, coalesce(rt.body, f.suggestion) AS text,
   CASE WHEN m.manual THEN 'manual' WHEN coalesce(t.target, f.anchors[1]) IS NULL OR coalesce(rt.body, f.suggestion) = '' THEN 'pending' ELSE 'rewritten' END AS status
  FROM (SELECT *, (starts_with(item_id, 'R-DATA-') OR starts_with(item_id, 'R-FIG-') OR item_id IN {inlist(P.MANUAL_ITEMS + P.STRUCTURAL_ITEMS)}) AS manual FROM fr WHERE verdict = 'problem') f
  JOIN (VALUES (true), (false)) m(manual) ON m.manual = f.manual LEFT JOIN ({TARGET}) t ON t.doc_id = f.doc_id AND t.item_id = f.item_id LEFT JOIN {RTEXT} ON rt.item_id = f.item_id"""


def plan(spark, d):
    return reports.revision_plan(scored(spark, d), overlay_frame(spark, d))


@query("cmp_detail", sql(f"SELECT x.doc_id, x.item_id, x.change, coalesce(s.status, 'pending') AS status FROM ({DIFF}) x LEFT JOIN (SELECT doc_id, item_id, arg_max(status, seq) AS status FROM ({TRIAGE}) GROUP BY 1, 2) s ON s.doc_id = x.doc_id AND s.item_id = x.item_id"))
def cmp_detail(spark, d):
    diff = reports.compare(scored(spark, d), with_model(spark, d)).select("doc_id", "item_id", "change")
    return reports.compare_detail(diff, reports.item_status(plan(spark, d)))


@query(
    "cmp_delta",
    sql(f"""SELECT b.doc_id, coalesce(bt, 0) AS before_total, coalesce(bh, 0) AS before_high, coalesce(atot, 0) AS after_total, coalesce(ah, 0) AS after_high, coalesce(r, 0) AS resolved, coalesce(n, 0) AS added, coalesce(k, 0) AS kept
      FROM (SELECT doc_id, count(*) FILTER (WHERE verdict = 'problem') AS bt, count(*) FILTER (WHERE verdict = 'problem' AND severity = 'high') AS bh FROM fr GROUP BY 1) b
      FULL JOIN (SELECT doc_id, count(*) FILTER (WHERE verdict = 'problem') AS atot, count(*) FILTER (WHERE verdict = 'problem' AND severity = 'high') AS ah FROM fm GROUP BY 1) a ON a.doc_id = b.doc_id
      LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE change = 'resolved') AS r, count(*) FILTER (WHERE change = 'new') AS n, count(*) FILTER (WHERE change = 'kept') AS k FROM ({DIFF}) GROUP BY 1) c ON c.doc_id = b.doc_id"""),
)
def cmp_delta(spark, d):
    b, a = scored(spark, d), with_model(spark, d)
    return reports.delta(b, a, reports.compare(b, a))


@query("rev_section_target", sql(f"SELECT doc_id, item_id, target FROM ({TARGET}) WHERE target IS NOT NULL"))
def rev_section_target(spark, d):
    st = reports.section_targets(overlay_frame(spark, d))
    rows = F.array(*[F.struct(F.lit(i).alias("item_id"), F.col("section_target")[i].alias("target")) for i in P.SECTION_PREFERENCE])
    return unnest(st, rows, "doc_id").filter(F.col("target").isNotNull())


@query("rev_triage", sql(f"SELECT doc_id, seq, item_id, target, text, status FROM ({TRIAGE})"))
def rev_triage(spark, d):
    return plan(spark, d).select("doc_id", "seq", "item_id", "target", "text", "status")


OFFER = f"SELECT DISTINCT f.doc_id, f.item_id, 'T' || f.item_id AS text, b.sentence AS quote FROM fr f JOIN items i ON i.item_id = f.item_id JOIN bank b ON b.k = (f.doc_id*3 + i.item_no) % {len(P.BANK)} WHERE f.verdict = 'problem'"


def offers(spark, d):
    """Externally written supplements by formula, each with a quote that may or may not be in the document."""
    bank, no = F.array(*[F.lit(b) for b in P.BANK]), F.create_map(*[F.lit(x) for i, r in enumerate(P.CHECKLIST) for x in (r[0], i + 1)])
    p = scored(spark, d).filter(F.col("verdict") == "problem").filter(F.col("item_id").isin(P.ITEM_IDS)).select("doc_id", "item_id").distinct()
    k = F.pmod(F.col("doc_id") * 3 + F.element_at(no, F.col("item_id")), F.lit(len(P.BANK))).cast("int")
    return p.select("doc_id", "item_id", F.concat(F.lit("T"), "item_id").alias("text"), F.get(bank, k).alias("quote"))


@query("rev_accepted_offers", sql(f"SELECT o.doc_id, o.item_id, o.text FROM ({OFFER}) o WHERE length(o.quote) >= {P.REVISION_QUOTE_MIN} AND EXISTS (SELECT 1 FROM units u WHERE u.doc_id = o.doc_id AND contains({SQUEEZE.format('u.text')}, {SQUEEZE.format('o.quote')}))"))
def rev_accepted_offers(spark, d):
    return reports.accepted_offers(offers(spark, d), overlay_frame(spark, d)).select("doc_id", "item_id", "text")


@query("rev_apply", sql(f"SELECT p.doc_id, p.para_idx, p.text || x.added AS text FROM paras p JOIN (SELECT doc_id, target, string_agg(text, '' ORDER BY seq) AS added FROM ({TRIAGE}) WHERE status = 'rewritten' GROUP BY 1, 2) x ON x.doc_id = p.doc_id AND x.target = p.para_idx"))
def rev_apply(spark, d):
    """Paragraphs changed by the revision, whole."""
    pl = plan(spark, d)
    revised = structure.paragraphs(reports.revised_frame(overlay_frame(spark, d), pl)).select("doc_id", "para_idx", "text")
    changed = pl.filter("status = 'rewritten'").select("doc_id", F.col("target").alias("para_idx")).distinct()
    return revised.join(changed, ["doc_id", "para_idx"], "left_semi")


@query("rev_review_compare")
def rev_review_compare(spark, d):
    """Review, revise, review again, compare: changes per item."""
    out = review_and_compare(overlay_frame(spark, d), before=scored(spark, d), demote=True)
    return out["diff"].groupBy("item_id", "change").agg(F.count("*").alias("n"))


# --- evaluation ---------------------------------------------------------------------------------

GROUPS = "['fixture','real','planted'][doc_id % 3 + 1]"
TRUTH = f"""SELECT doc_id, {GROUPS} AS grp, item_id, CASE WHEN (doc_id + item_no) % 5 = 0 THEN para_idx + 2 ELSE para_idx END AS para_idx FROM (
  SELECT d.doc_id, i.item_id, i.item_no, p.para_idx, p.doc_id IS NOT NULL AS found FROM docs d CROSS JOIN items i LEFT JOIN ({PROB.format('fr')}) p ON p.doc_id = d.doc_id AND p.item_id = i.item_id)
  WHERE found <> ((doc_id * 17 + item_no) % 11 = 0)"""
DET = f"SELECT coalesce(g.doc_id, w.doc_id) AS doc_id, coalesce(g.item_id, w.item_id) AS item_id, g.para_idx AS got_para, w.para_idx AS want_para, g.doc_id IS NOT NULL AS detected, w.doc_id IS NOT NULL AS expected FROM (SELECT * FROM ({PROB.format('fr')}) WHERE item_id IN (SELECT item_id FROM items)) g FULL JOIN ({TRUTH}) w ON w.doc_id = g.doc_id AND w.item_id = g.item_id"
DETG = f"SELECT x.*, t.grp FROM ({DET}) x JOIN (SELECT doc_id, {GROUPS} AS grp FROM docs) t ON t.doc_id = x.doc_id"


def group():
    return F.get(F.array(F.lit("fixture"), F.lit("real"), F.lit("planted")), F.pmod("doc_id", F.lit(3)).cast("int")).alias("grp")


def samples(spark, d):
    """Every document with its group, those without expected items included."""
    return docs(spark, d).select("doc_id", group())


def truth(spark, d):
    """Expected items by formula: the found problems with every 11th (document, item) flipped and every 5th anchor moved."""
    found = reports.problems(scored(spark, d)).select("doc_id", "item_id", "para_idx", F.lit(True).alias("found"))
    no = F.array(*[F.struct(F.lit(r[0]).alias("item_id"), F.lit(i + 1).alias("item_no")) for i, r in enumerate(P.CHECKLIST)])
    grid = unnest(docs(spark, d), no, "doc_id")
    j = grid.join(found, ["doc_id", "item_id"], "left")
    flip = F.pmod(F.col("doc_id") * 17 + F.col("item_no"), F.lit(11)) == 0
    j = j.filter(F.coalesce("found", F.lit(False)) != flip)
    moved = F.when((F.col("doc_id") + F.col("item_no")) % 5 == 0, F.col("para_idx") + 2).otherwise(F.col("para_idx"))
    return j.select("doc_id", group(), "item_id", moved.alias("para_idx"))


@query("eva_detection", sql(DETG))
def eva_detection(spark, d):
    return evaluate.detection(scored(spark, d), truth(spark, d), samples=samples(spark, d))


RATIO = "round(coalesce({a} / nullif({b}, 0), 0), 6)"
EVAL = f"""SELECT grp, samples, expected, hit, fp, anchor_checked, anchor_ok, {RATIO.format(a='hit', b='expected')} AS recall, {RATIO.format(a='hit', b='(hit + fp)')} AS precision, {RATIO.format(a='anchor_ok', b='anchor_checked')} AS anchor_rate FROM (
  SELECT grp, count(*) FILTER (WHERE sample) AS samples, count(*) FILTER (WHERE expected) AS expected, count(*) FILTER (WHERE expected AND detected) AS hit, count(*) FILTER (WHERE detected AND NOT expected) AS fp, count(*) FILTER (WHERE expected AND detected AND want_para IS NOT NULL AND got_para IS NOT NULL) AS anchor_checked,
   count(*) FILTER (WHERE expected AND detected AND abs(got_para - want_para) <= 1) AS anchor_ok FROM (SELECT *, false AS sample FROM ({DETG}) UNION ALL BY NAME SELECT doc_id, {GROUPS} AS grp, true AS sample FROM docs) GROUP BY ROLLUP (grp))"""


@query("eva_groups", sql(EVAL))
def eva_groups(spark, d):
    return evaluate.group_report(evaluate.detection(scored(spark, d), truth(spark, d), samples=samples(spark, d)), samples=samples(spark, d))


@query("eva_anchor_accuracy", sql(f"SELECT anchor_checked, anchor_ok, anchor_rate FROM ({EVAL}) WHERE grp IS NULL"))
def eva_anchor_accuracy(spark, d):
    return evaluate.group_report(evaluate.detection(scored(spark, d), truth(spark, d), samples=samples(spark, d))).filter("grp IS NULL").select("anchor_checked", "anchor_ok", "anchor_rate")


@query("eva_anchor_misses", sql(f"SELECT doc_id, item_id, want_para, got_para FROM ({DETG}) WHERE expected AND detected AND abs(got_para - want_para) > 1"))
def eva_anchor_misses(spark, d):
    return evaluate.anchor_misses(evaluate.detection(scored(spark, d), truth(spark, d), samples=samples(spark, d)))


@query("eva_ablation")
def eva_ablation(spark, d):
    """Elements x gates x model switches over one truth table."""
    bare = staged(document_facts(overlay_frame(spark, d), use_elements=False))
    runs = {
        "E": review(facts=bare, use_gates=False),
        "A": review(facts=kept_facts(spark, d), use_gates=False),
        "B": review(facts=bare),
        "C": scored(spark, d),
        "D": with_model(spark, d),
    }
    sums = notes.token_sums(usage(spark, d, images=False)).withColumn("duration_ms", 100 + F.pmod("doc_id", F.lit(900)))
    return evaluate.ablation(runs, staged(truth(spark, d)), samples=samples(spark, d), costs={"D": staged(sums)})


GOLD = f"SELECT doc_id, type FROM (SELECT d.doc_id, t.type, t.tno, e.type IS NOT NULL AS found FROM docs d CROSS JOIN (SELECT type, tno FROM types UNION ALL VALUES ('citation', {len(P.ELEMENT_TYPES)}), ('reference_list', {len(P.ELEMENT_TYPES) + 1})) t LEFT JOIN (SELECT DISTINCT doc_id, type FROM elements) e ON e.doc_id = d.doc_id AND e.type = t.type) WHERE found <> ((doc_id * 7 + tno) % 13 = 0)"


ELEMENT_SCORES = f"""SELECT tp, predicted, annotated, precision, recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM (SELECT tp, predicted, annotated, {RATIO.format(a='tp', b='predicted')} AS precision, {RATIO.format(a='tp', b='annotated')} AS recall FROM (
      SELECT count(*) FILTER (WHERE p.type IS NOT NULL AND g.type IS NOT NULL) AS tp, count(p.type) AS predicted, count(g.type) AS annotated FROM (SELECT DISTINCT doc_id, type FROM elements) p FULL JOIN ({GOLD}) g ON g.doc_id = p.doc_id AND g.type = p.type))"""


@query("eva_elements", sql(ELEMENT_SCORES))
def eva_elements(spark, d):
    rows = once(spark, d, "element_types", lambda: elements.element_rows(tagged(spark, d)).select("doc_id", "type").distinct())
    kinds = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(i).alias("tno")) for i, t in enumerate([*P.ELEMENT_TYPES, "citation", "reference_list"])])
    j = unnest(docs(spark, d), kinds, "doc_id").join(rows.withColumn("found", F.lit(True)), ["doc_id", "type"], "left")
    gold = j.filter(F.coalesce("found", F.lit(False)) != (F.pmod(F.col("doc_id") * 7 + F.col("tno"), F.lit(13)) == 0)).select("doc_id", "type")
    return evaluate.element_metrics(rows, gold)


@query(
    "eva_thresholds",
    sql(f"""SELECT name, value, floor FROM (SELECT 'detection' AS name, (SELECT recall FROM ({EVAL}) WHERE grp IS NULL) AS value, 0.95::DOUBLE AS floor UNION ALL SELECT 'precision', (SELECT precision FROM ({EVAL}) WHERE grp IS NULL), 0.95
     UNION ALL SELECT 'element_f1', (SELECT f1 FROM ({ELEMENT_SCORES})), 0.85) WHERE value < floor"""),
)
def eva_thresholds(spark, d):
    """All three measured: detection and precision on the findings, F1 on the element labels."""
    g = evaluate.group_report(evaluate.detection(scored(spark, d), truth(spark, d), samples=samples(spark, d))).filter("grp IS NULL")
    measured = lambda df, **names: unnest(df, F.array(*[F.struct(F.lit(k).alias("name"), F.col(v).alias("value")) for k, v in names.items()]))
    return evaluate.below_floor(measured(g, detection="recall", precision="precision").unionByName(measured(eva_elements(spark, d), element_f1="f1")))


RUNS = "SELECT doc_id, 0 AS run, item_id, arg_max(verdict, seq) AS verdict FROM fr GROUP BY doc_id, item_id UNION ALL SELECT doc_id, 1, item_id, arg_max(verdict, seq) FROM fm GROUP BY doc_id, item_id"
HISTOGRAM = "SELECT doc_id, string_agg(k || '=' || n, ' ' ORDER BY k) AS severities FROM (SELECT doc_id, run || ':' || severity AS k, count(*) AS n FROM (SELECT doc_id, 0 AS run, verdict, severity FROM fr UNION ALL SELECT doc_id, 1, verdict, severity FROM fm) WHERE verdict = 'problem' GROUP BY 1, 2) GROUP BY doc_id"


@query(
    "eva_run_consistency",
    sql(f"""SELECT x.doc_id, common_items, stable_items, problem_inter, problem_union, {RATIO.format(a='stable_items', b='common_items')} AS stable_rate, {RATIO.format(a='problem_inter', b='problem_union')} AS jaccard, coalesce(severities, '') AS severities FROM (
      SELECT doc_id, count(*) FILTER (WHERE n = 2) AS common_items, count(*) FILTER (WHERE n = 2 AND v = 1) AS stable_items, count(*) FILTER (WHERE np = 2) AS problem_inter, count(*) FILTER (WHERE np > 0) AS problem_union FROM (
       SELECT doc_id, item_id, count(DISTINCT run) AS n, count(DISTINCT verdict) AS v, count(*) FILTER (WHERE verdict = 'problem') AS np FROM ({RUNS}) GROUP BY 1, 2) GROUP BY 1) x LEFT JOIN ({HISTOGRAM}) h ON h.doc_id = x.doc_id"""),
)
def eva_run_consistency(spark, d):
    runs = {0: scored(spark, d), 1: with_model(spark, d)}
    last = [f.groupBy("doc_id", "item_id").agg(F.max_by("verdict", "seq").alias("verdict")).withColumn("run", F.lit(n)) for n, f in runs.items()]
    every = [f.select("doc_id", F.lit(n).alias("run"), "verdict", "severity") for n, f in runs.items()]
    h = evaluate.severity_histogram(every[0].unionByName(every[1]))
    told = F.array_join(F.transform(F.map_entries("severities"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    return evaluate.run_consistency(last[0].unionByName(last[1]), 2).join(h, "doc_id", "left").withColumn("severities", F.coalesce(told, F.lit("")))


@query("eva_classification", sql("SELECT paper_type, count(*) AS n, CAST(sum(review_hits) AS BIGINT) AS review_hits, CAST(sum(empirical_hits) AS BIGINT) AS empirical_hits FROM ptype GROUP BY paper_type"))
def eva_classification(spark, d):
    t = elements.paper_type(overlay_frame(spark, d))
    return t.groupBy("paper_type").agg(F.count("*").alias("n"), F.sum("review_hits").alias("review_hits"), F.sum("empirical_hits").alias("empirical_hits"))


def _ranked(source, group, value):
    at = lambda p: f"max({value}) FILTER (WHERE rn - 1 = CAST(round_even({p} * (c - 1), 0) AS BIGINT))"
    return f"""SELECT {group}, {at(0.5)} AS p50, {at(0.95)} AS p95, max({value}) AS max_value, max(c) AS n
 FROM (SELECT {group}, {value}, row_number() OVER (PARTITION BY {group} ORDER BY {value}) AS rn, count(*) OVER (PARTITION BY {group}) AS c FROM {source} WHERE {value} IS NOT NULL) GROUP BY {group}"""


@query("eva_latency", _ranked("events", "event_type", "value"))
def eva_latency(spark, d):
    return evaluate.latency_summary(read(spark, d, "events"))


LOAD = f"""WITH r AS (SELECT *, (e - s) / 1000 AS ms FROM (SELECT [1, 2, 4, 8][user_id % 4 + 1] AS level, CAST(ts AS DATE) AS round, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value) AS BIGINT) * 1000000 AS e FROM events)),
 m AS (SELECT level, round, t, sum(d) AS d FROM (SELECT level, round, s AS t, 1 AS d FROM r WHERE e > s UNION ALL SELECT level, round, e, -1 FROM r WHERE e > s) GROUP BY ALL),
 w AS (SELECT level, round, t, sum(d) OVER o AS open, lead(t) OVER o AS nxt FROM m WINDOW o AS (PARTITION BY level, round ORDER BY t)),
 b AS (SELECT level, sum(busy) AS busy, max(peak) AS peak FROM (SELECT level, round, sum(CASE WHEN open > 0 THEN nxt - t ELSE 0 END) AS busy, max(open) AS peak FROM w GROUP BY ALL) GROUP BY level),
 l AS (SELECT p.*, b.peak, b.busy / c.rounds / 1e6 AS wall FROM ({_ranked("r", "level", "ms")}) p JOIN b USING (level) JOIN (SELECT level, count(DISTINCT round) AS rounds FROM r GROUP BY level) c USING (level))
 SELECT level, n, p50, p95, max_value, round(wall, 6) AS wall_s, CAST(peak AS BIGINT) AS peak, round(coalesce((SELECT arg_min(wall / greatest(level, 1), level) FROM l) * level / nullif(wall, 0), 0), 6) AS speedup FROM l"""


@query("eva_load", LOAD)
def eva_load(spark, d):
    """Events as requests of four levels of concurrency, a day as a round; wall time and peak by a sweep over their intervals."""
    e = read(spark, d, "events")
    level = F.get(F.array(*map(F.lit, (1, 2, 4, 8))), F.pmod("user_id", F.lit(4)).cast("int")).alias("level")
    start = micros(e, "ts")
    return evaluate.load_report(e.select(level, F.to_date("ts").alias("round"), start.alias("start_us"), (start + F.floor("value") * 1_000_000).alias("end_us")))


@query("eva_truth_upsert", "SELECT doc_id, quality FROM labels UNION ALL SELECT d.doc_id, 0 FROM (SELECT DISTINCT doc_id FROM documents) d ANTI JOIN labels l ON l.doc_id = d.doc_id")
def eva_truth_upsert(spark, d):
    """Labels plus a default label for the documents that have none."""
    old = read(spark, d, "labels").select("doc_id", "quality")
    new = read(spark, d, "documents").select("doc_id", F.lit(0).alias("quality"))
    return evaluate.upsert_truth(old, new, "doc_id")


@query("src_ground_truth", "SELECT CAST(doc_id AS VARCHAR) AS sample_id, 'fixture' AS grp, CASE WHEN quality = 1 THEN 'R-01' ELSE 'R-15' END AS item_id, 'mid' AS severity, toxic AS para_idx FROM labels")
def src_ground_truth(spark, d):
    """Labels as ground-truth JSON, read back with the loader's schema."""
    from paperlens.sources.checklists import truth_rows

    item = F.struct(
        F.when(F.col("quality") == 1, "R-01").otherwise("R-15").alias("checklist_item_id"), F.lit("mid").alias("severity_expected"), F.struct(F.col("toxic").alias("paragraph_index")).alias("anchor")
    )
    js = read(spark, d, "labels").select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("sample_id"), F.lit("fixture").alias("type"), F.array(item).alias("items"))).alias("js"))
    return truth_rows(js, "js")
