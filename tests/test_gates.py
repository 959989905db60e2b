import json

import pytest

from paperlens.operators import gates, reconcile
from paperlens.plans.review import draft, document_facts, review
from paperlens.sources import verdicts as V


def model(spark, rows):
    payload = [(d, json.dumps(e, ensure_ascii=False)) for d, e in rows.items()]
    return V.parse_verdicts(spark.createDataFrame(payload, "doc_id bigint, content string"))


def entry(item, verdict, **kw):
    return {"checklist_item_id": item, "verdict": verdict, **kw}


def test_contract(spark):
    rows = model(spark, {1: [entry("R-01", "pass"), entry("R-02", "maybe"), entry("R-03", "problem", severity="huge"), {"verdict": "pass"}], 2: {"findings": [entry("R-04", "problem", headline="h" * 300)]}}).collect()
    assert [(r["doc_id"], r["raw_id"], r["valid"]) for r in rows] == [(1, "R-01", True), (1, "R-02", False), (1, "R-03", False), (1, None, False), (2, "R-04", True)]
    assert len(rows[4]["headline"]) == 200 and rows[4]["severity"] == "mid"


def test_rule_pass_vetoes_model_problem(spark, frame_of):
    fr = frame_of({1: ["准确率 0.9（95% CI 0.8–0.95）。"]})
    v = reconcile.normalize_ids(model(spark, {1: [entry("R-09", "problem", description="x"), entry("是否报告效应量与置信区间", "pass"), entry("R-09", "problem")]}).filter("valid"))
    r = review(fr, v).filter("item_id = 'R-09'").collect()
    assert len(r) == 1 and r[0]["verdict"] == "pass" and r[0]["vetoed_llm"] and r[0]["gate_reason"] == "vetoed_llm"
    assert r[0]["confidence"] == pytest.approx(0.32) and r[0]["description"] == "x"


def test_no_evidence_and_unknown_item(spark, frame_of):
    fr = frame_of({1: ["普通文本。"]})
    v = reconcile.normalize_ids(model(spark, {1: [entry("R-07", "problem"), entry("R-77", "problem"), entry("R-77", "pass")]}).filter("valid"))
    rows = {(r["item_id"], r["verdict"]): r for r in review(fr, v).filter("engine = 'llm'").collect()}
    assert set(rows) == {("R-07", "uncertain"), ("unknown", "uncertain"), ("unknown", "pass")}
    assert rows[("R-07", "uncertain")]["evidence_gate"] == "no_evidence"


def test_documents_without_model_rows_keep_their_findings(spark, frame_of):
    fr = frame_of({1: ["准确率 0.9。"], 2: ["准确率 0.9。"]})
    v = reconcile.normalize_ids(model(spark, {1: [entry("R-77", "pass")]}).filter("valid"))
    got = review(fr, v).filter("phase = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in got} == {1, 2} and len({r["count"] for r in got}) == 1


def test_dual_disagreement(spark):
    a = reconcile.normalize_ids(model(spark, {1: [entry("R-01", "pass"), entry("R-02", "pass")]}))
    b = reconcile.normalize_ids(model(spark, {1: [entry("R-01", "problem"), entry("R-01", "pass"), entry("R-02", "problem")]}))
    assert {r["item_id"]: r["verdict"] for r in reconcile.dual_check(a, b).collect()} == {"R-01": "pass", "R-02": "uncertain"}


def test_figure_demotion_depends_on_tables(frame_of):
    fr = frame_of({1: ["学习率为 0.1，见图1。"], 2: ["见图1。", "学习率 | 0.1"], 3: ["学习率为 0.1。"]})
    rows = {r["doc_id"]: r["verdict"] for r in review(fr, demote=True).filter("item_id = 'R-12'").collect()}
    assert rows == {1: "uncertain", 2: "problem", 3: "problem"}


def test_quote_verification(spark, frame_of):
    fr = frame_of({1: ["本研究的局限：样本来自单一中心，缺少外部验证。", "其他。", "更多其他文字。"]})
    v = reconcile.normalize_ids(model(spark, {1: [entry("R-07", "problem"), entry("R-08", "problem")]}).filter("valid"))
    q = spark.createDataFrame([(1, 1, "显著性检验并未出现在文中任何地方"), (1, 2, "x")], "doc_id bigint, rn int, quote string")
    assert review(fr, v, quotes=q).filter("evidence_gate = 'quote_verified'").count() == 0
    fr = frame_of({1: ["采用 Bonferroni 校正，处理多重比较问题。", "其他。"]})
    v = reconcile.normalize_ids(model(spark, {1: [entry("R-07", "problem"), entry("R-03", "problem")]}).filter("valid"))
    q = spark.createDataFrame([(1, 1, "Bonferroni校正处理多重比较"), (1, 2, "不存在的划分描述文字内容")], "doc_id bigint, rn int, quote string")
    r = review(fr, v, quotes=q).filter("engine = 'llm'").collect()
    assert all(x["evidence_gate"] != "quote_verified" for x in r)  # the first quote does not name a test
    q = spark.createDataFrame([(1, 1, "显著性 Bonferroni校正处理多重比较")], "doc_id bigint, rn int, quote string")
    assert review(fr, v, quotes=q).filter("evidence_gate = 'quote_verified'").count() == 0  # not in the text
    fr = frame_of({1: ["普通。", "组间差异经检验具有统计学意义，处理得当。"]})
    q = spark.createDataFrame([(1, 1, "组间差异经检验，具有统计学意义")], "doc_id bigint, rn int, quote string")
    v = reconcile.normalize_ids(model(spark, {1: [entry("R-07", "problem")]}).filter("valid"))
    r = review(fr, v, quotes=q).filter("evidence_gate = 'quote_verified'").collect()
    assert [(x["anchors"], x["verdict"]) for x in r] == [([1], "problem")]


def test_review_paper_keeps_four_items(frame_of):
    fr = frame_of({1: ["本文综述研究进展。", "准确率 0.9，按 7:1:5 划分训练集。"]})
    assert {r["item_id"] for r in review(fr).collect()} == {"R-01", "R-15", "R-REF-01", "R-REF-02"}


def test_quality_card(frame_of):
    fr = frame_of({1: ["准确率 0.9。"]})
    f = review(fr)
    q, c = gates.quality(f).first(), gates.counts(f).first()
    assert q["applicable_items"] == 17 and q["assessed_items"] == c["n_assessed"] and q["grade_d"] >= c["n_undetermined"]
    assert c["n_undetermined"] + c["n_assessed"] == f.count() == 17


def test_draft_without_gates_leaves_items_open(frame_of):
    f = draft(document_facts(frame_of({1: ["普通文本。"]})), mark_unassessed=False)
    assert f.count() == 0


def test_an_invalid_entry_leaves_the_others_alone(spark):
    good = {"checklist_item_id": "R-01", "verdict": "pass", "severity": None, "headline": "h"}
    bad = ["oops", 7, None, [good], {**good, "checklist_item_id": {"a": 1}}, {**good, "headline": 7}, {**good, "verdict": "maybe"}, {**good, "severity": 3}, {**good, "suggestion": None}]
    twice = '{"checklist_item_id": "R-02", "checklist_item_id": "R-03", "verdict": "pass"}'
    rows = [
        (1, json.dumps([good, *bad, good])), (2, json.dumps({"findings": [good, "oops"]})), (3, f"[{json.dumps(good)}, {twice}]"),
        (4, "no json"), (5, None), (6, "[]"), (7, '{"findings": 3}'), (8, json.dumps(json.dumps([good]))),
    ]
    got = V.parse_verdicts(spark.createDataFrame(rows, "doc_id bigint, content string")).collect()
    flags = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.mseq)):
        flags.setdefault(r.doc_id, []).append(r.valid)
    assert flags == {1: [True] + [False] * len(bad) + [True], 2: [True, False], 3: [True, False]}
    assert {(r.raw_id, r.severity, r.headline, r.description) for r in got if r.valid} == {("R-01", "mid", "h", "")}


def test_inapplicable_items_share_the_unknown_second_opinion(spark):
    from paperlens import packs

    a, b = [i for i in packs.ITEM_IDS if i not in packs.REVIEW_ALLOWED][:2]
    kinds = spark.createDataFrame([(1, "review")], "doc_id bigint, paper_type string")
    row = "doc_id bigint, mseq int, item_id string, verdict string"
    first = spark.createDataFrame([(1, 0, a, "pass"), (1, 1, b, "pass")], row)
    other = spark.createDataFrame([(1, 0, a, "pass"), (1, 1, b, "problem")], row)
    got = reconcile.dual_check(*[reconcile.restrict(v, kinds) for v in (first, other)]).collect()
    assert [(r.item_id, r.verdict, r.dual_check) for r in got] == [("unknown", "uncertain", "disagree")] * 2


def test_the_last_of_several_quotes_counts(spark):
    from paperlens import packs

    item, words = next(iter(packs.ITEM_KEYWORDS.items()))
    one, two = f"{words[0]} stands in this first sentence", f"{words[0]} stands in another sentence"
    pending = spark.createDataFrame([(1, 5, 1, item)], "doc_id bigint, seq bigint, rn int, item_id string")
    quotes = spark.createDataFrame([(1, 1, one, 2), (1, 1, two, 1)], "doc_id bigint, rn int, quote string, position int")
    units = spark.createDataFrame([(1, 0, 10, two), (1, 1, 11, one)], "doc_id bigint, pos int, para_idx int, text string")
    assert [(r.para_idx, r.quote) for r in reconcile.verify_quotes(pending, quotes, units).collect()] == [(11, one)]
