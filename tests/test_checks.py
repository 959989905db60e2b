import random
import re
import time

import pytest
from pyspark.sql import functions as F

from paperlens import packs
from paperlens.operators import checks


def val(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text,bad", [("按 7:1:5 划分", 13), ("按 7:1:2 划分", None), ("按 70:15:15 划分", None), ("按 5:2:2:1 划分", None), ("按 4:1:1 划分", None), ("时间 7:1:5 记录", None)])
def test_ratio(spark, text, bad):
    assert val(spark, text, lambda t: checks.bad_ratio(t)["total"]) == bad


@pytest.mark.parametrize(
    "text,bad",
    [
        ("训练集 70%、验证集 20%、测试集 5%", 95.0),
        ("训练集 70%、验证集 15%、测试集 15%，准确率 95%", None),
        ("训练集占 80%，验证集占 20%，其中训练集正类占比 5%", None),
        ("训练集 60%，测试集 30%；随访率 95%", 90.0),
        ("训练集 60%", None),
    ],
)
def test_percent(spark, text, bad):
    assert val(spark, text, lambda t: checks.bad_percent(t)["total"]) == bad


def shares(text):
    """The percentage check by positions in plain Python: (total, parts) of the first bad run."""
    run, bad, last = [], None, None
    ends = lambda run: run if len(run) >= 2 and not packs.PERCENT_LOW <= sum(run) <= packs.PERCENT_HIGH else None
    for m in re.finditer(packs.PERCENT, text, re.I):
        window = text[max(0, m.start() - 20) : m.start()], text[m.end() : m.end() + 20]
        word = packs.SPLIT_CONTEXT
        near = re.search(f"(?s){word}.{{0,{packs.SPLIT_WINDOW}}}$", window[0]) or re.search(f"(?s)^.{{0,{packs.SPLIT_WINDOW}}}{word}", window[1])
        share = near and not re.search(packs.METRIC_CONTEXT, text[max(0, m.start() - packs.METRIC_WINDOW) : m.start()])
        joined = last is not None and re.search(packs.PERCENT_GAP, text[last : m.start()])
        last = m.end()
        if share and joined and run:
            run.append(float(m[1]))
            continue
        bad = bad or ends(run)
        run = [float(m[1])] if share else []
    bad = bad or ends(run)
    return bad and (round(sum(bad), 4), " + ".join(f"{v:g}%" for v in bad))


def test_percent_by_positions(spark):
    rng = random.Random(4)
    bits = ["训练集", "验证集", "测试集", "占比", "准确率", "、", "，", " ", "和", "其中随访的病例", "5%", "9%", "20%", "70%", "95% CI", "12.5%", "abc"]
    texts = ["".join(rng.choices(bits, weights=[3] * 3 + [1] * 7 + [3] * 7, k=rng.randrange(2, 40))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("x", checks.bad_percent(F.col("t")))
    got = {r.t: r.x and (r.x.total, r.x.parts) for r in df.collect()}
    # the operator looks at nothing unless the unit names a split and holds two percentages
    want = {t: shares(t) for t in texts}
    assert got == want and sum(w is not None for w in want.values()) > 100


def test_percent_is_linear(spark):
    start = time.time()
    assert val(spark, "划分：" + "训练集 70%、测试集 30%；随访" * 50_000, lambda t: checks.bad_percent(t)["total"]) is None
    assert val(spark, "划分：" + "训练集 1%、" * 100_000, lambda t: checks.bad_percent(t)["total"]) == 100_000.0
    assert time.time() - start < 60


@pytest.mark.parametrize("text,bad", [("0.95（95% CI 0.80–0.90）", "0.95|0.8|0.9"), ("0.85（95% CI 0.80–0.90）", None), ("97%（95% CI 88%–96%）", "97.0|88.0|96.0"), ("92%（95% CI 0.88–0.96）", None), ("0.85（95% CI 0.90–0.80）", None)])
def test_interval(spark, text, bad):
    assert val(spark, text, checks.bad_interval) == bad


def run(fr):
    return [(r["code"], r["para_idx"], r["arg0"], r["arg1"]) for r in checks.check_rows(checks.with_figure_checks(checks.with_captions(fr)), "figure").orderBy("doc_id", "seq").collect()]


def test_caption_is_not_a_sentence(frame_of):
    fr = frame_of({1: ["图1显示了准确率的对比。", "图1 准确率对比"]})
    caps = checks.with_captions(fr).select(F.inline("captions")).collect()
    assert [(c["kind"], c["number"], c["para_idx"]) for c in caps] == [("图", 1, 1)]


def test_sample_conflict(frame_of):
    body = ["![a](x.png)", "图1 结果（n=12）"]
    assert run(frame_of({1: [*body, "如图1所示，42 例患者。"]})) == [("SAMPLE_CONFLICT", 2, "图1", "12|42|计数")]
    assert run(frame_of({1: [*body, "如图1所示，12 例患者。"]})) == []


def test_quantities_are_not_mentions(frame_of):
    fr = frame_of({1: ["本研究代表3个模型，发表12篇论文，表12个样本，见表十二。"]})
    m = checks.with_captions(fr).select(F.inline("mentions")).collect()
    assert [(x["kind"], x["number"]) for x in m] == [("表", 12)]


def test_uncaptioned_mention_and_missing_caption(frame_of):
    assert run(frame_of({1: ["见图2与表3。", "![a](x.png)"]})) == [("CAPTION_MISSING", 0, "图", "1"), ("MENTION_UNCAPTIONED", 0, "图2", None)]
    assert run(frame_of({1: ["见图2。"]})) == []
