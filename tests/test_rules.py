import pytest

from paperlens.operators import elements, rules
from paperlens.operators.rules import OUTCOME_OF


def codes(fr):
    rows = rules.finding_rows(rules.with_findings(elements.with_features(elements.with_elements(fr)))).collect()
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], {}).setdefault(r["item_id"], []).append((r["code"], r["para_idx"]))
    return out


H = ("2. 方法", "Heading 1")
FIXTURES = {
    # leak on the test set, p value without a named test, no limitation
    1: [H, "研究共收集 32000 张眼底图像，按 8:2 划分为训练集与测试集。", "在测试集上进行网格搜索以确定学习率。", "模型准确率较基线提升，差异显著（p<0.01），结论可靠。", "结论：方法有效。"],
    # new module without ablation, over-general conclusion, no split detail
    2: [H, "数据集共 2400 例样本用于训练。", "采用配对 t 检验，准确率为 0.90。", "本文提出新的注意力机制模块。", "该方法普遍适用于各类影像，结论成立。"],
    # dangling citation without a reference list, several data sets
    3: [H, "如文献[99]所述。", "采用 t 检验比较。", "在 3 个数据集上评估 CNN 模型的准确率与召回率。"],
    # complete paper
    5: [
        H, "样本量依据功效分析确定，共 500 例患者，数据集按 7:1:2 划分为训练集、验证集与测试集，随机种子固定为 42。",
        "图像经归一化与数据增强，学习率经网格搜索在 [1e-4, 1e-2] 内确定。",
        "与 3 种基线方法比较，准确率 0.91（95% CI 0.88–0.94），配对 t 检验，多重比较采用 Bonferroni 校正，消融实验见下。",
        "本研究的局限在于单中心样本。",
    ],
}


@pytest.fixture(scope="module")
def found(spark):
    from paperlens.operators.structure import frame

    rows = [(d, "s", [(i, b[0], b[1]) if isinstance(b, tuple) else (i, b, "Normal") for i, b in enumerate(bs)]) for d, bs in FIXTURES.items()]
    return codes(frame(spark.createDataFrame(rows, "doc_id bigint, source string, blocks array<struct<idx:int,text:string,style:string>>")))


def problems(found, d):
    return {i for i, cs in found[d].items() if any(OUTCOME_OF[c][1] == "problem" for c, _ in cs)}


def test_leak_fixture(found):
    assert {"R-03", "R-07", "R-09", "R-15"} <= problems(found, 1)
    assert found[1]["R-03"] == [("LEAK", 2)] and found[1]["R-07"] == [("TEST_BAD", 3)]


def test_module_fixture(found):
    assert {"R-05", "R-11", "R-15"} <= problems(found, 2)
    assert found[2]["R-05"] == [("ABL_BAD", 3)] and found[2]["R-11"] == [("OVER_BAD", 4)]


def test_reference_fixture(found):
    assert {"R-REF-01", "R-REF-02", "R-08"} <= problems(found, 3)
    assert found[3]["R-REF-01"] == [("REF1_BAD", 1)]


def test_clean_fixture_has_no_problem(found):
    assert problems(found, 5) == set()


def test_tuning_on_validation_is_fine(frame_of):
    fr = frame_of({1: ["超参数在验证集上调参，测试集只使用一次。", "按 8:1:1 划分训练集。"], 2: ["在测试集上调参。", "按 8:1:1 划分训练集。"]})
    got = codes(fr)
    assert got[1]["R-03"][0][0] == "SPLIT_OK" and got[2]["R-03"] == [("LEAK", 0)]


def test_metric_rule_outcomes(frame_of):
    fr = frame_of({1: ["本文提出新方法用于文本分类。", "推理延迟为 3 ms。"], 2: ["本文提出新方法。"], 3: ["本文提出新方法，准确率 0.9。"]})
    got = codes(fr)
    assert [got[d]["R-06"][0][0] for d in (1, 2, 3)] == ["METRIC_MISFIT", "METRIC_BAD", "METRIC_OK"]


def test_hyperparameter_rule_ignores_citations(frame_of):
    fr = frame_of({1: ["学习率经网格搜索确定[3]。"], 2: ["学习率经网格搜索确定，取值范围 0.1 至 1。"], 3: ["学习率为 0.1。"]})
    got = codes(fr)
    assert [got[d]["R-12"][0][0] for d in (1, 2, 3)] == ["HYP_NORANGE", "HYP_OK", "HYP_BAD"]


def test_section_anchor_closes_on_level_one(frame_of):
    fr = frame_of({1: [("方法", "Heading 1"), ("细节", "Heading 2"), "训练集划分说明。", ("结果", "Heading 1"), "测试集划分。"], 2: [("数据划分", "Heading 1"), ("结果", "Heading 1"), "测试集划分。"]})
    rows = {r["doc_id"]: r for r in fr.select("doc_id", elements.section_anchor("split_a").alias("a"), elements.section_anchor("split_b").alias("b")).collect()}
    assert (rows[1]["a"], rows[1]["b"]) == (None, 2)
    assert (rows[2]["a"], rows[2]["b"]) == (None, None)


def test_paper_type(frame_of):
    fr = frame_of({1: ["1 引言", "本文综述相关研究进展。"], 2: ["数据集与基线，准确率高。"], 3: ["普通文本。"]})
    assert {r["doc_id"]: r["paper_type"] for r in elements.paper_type(fr).collect()} == {1: "review", 2: "empirical", 3: "unknown"}


def test_every_rule_has_every_reachable_outcome_on_the_overlay(spark):
    from paperlens.plans.flagship import overlay_frame

    rows = rules.finding_rows(rules.with_findings(elements.with_features(elements.with_elements(overlay_frame(spark, "/root/testdata/sf0.01")))))
    seen = {r["code"] for r in rows.select("code").distinct().collect()}
    assert set(OUTCOME_OF) - seen <= {"METRIC_BAD"}
