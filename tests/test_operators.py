import datetime as dt
import random

from pyspark.sql import functions as F

from paperlens import packs
from paperlens.functions.ranks import nearest_rank, running_total, previous_time
from paperlens.operators import dialogue, evaluate, lifecycle, reports, retrieval
from paperlens.operators.elements import with_elements
from paperlens.plans.compare import review_and_compare
from paperlens.plans.review import review


def conv(spark, rows):
    return spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(rows)], "conv_id bigint, turn bigint, role string, text string")


def brute_history(rows, turns, chars, system):
    kept = rows[-turns * 2 :]
    cut = len(kept) < len(rows)
    if kept and kept[0][0] != "user":
        kept, cut = kept[1:], True
    while kept and system + sum(len(t) for _, t in kept) > chars and len(kept) > 1:
        kept, cut = kept[2:], True
    return kept, cut


def test_history_fifteen_turns(spark):
    rows = [(r, f"{r}{i}") for i in range(15) for r in ("user", "assistant")]
    t = dialogue.truncate_history(conv(spark, rows), 10, 8000).first()
    assert len(t["kept"]) == 20 and t["kept"][0]["text"] == "user5" and t["truncated"]


def test_history_matches_brute_force(spark):
    rnd = random.Random(3)
    for _ in range(6):
        rows = [(rnd.choice(["user", "assistant", "system"]), "x" * rnd.randint(1, 60)) for _ in range(rnd.randint(1, 12))]
        for chars in (10, 80, 200):
            got = dialogue.truncate_history(conv(spark, rows), 3, chars, 5).first()
            kept, cut = brute_history(rows, 3, chars, 5)
            assert [(m["role"], m["text"]) for m in got["kept"]] == kept and got["truncated"] == cut


def test_question_context_keeps_oversized_first_line(spark):
    d = spark.createDataFrame([(1, "a" * 50 + "\nb"), (2, "aa\n\nbb\ncc"), (3, "a\nb")], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in dialogue.question_context(d, 6).collect()}
    assert rows[1]["context"] == "a" * 50 + packs.QA_CUT_NOTE and rows[2]["n_lines"] == 2 and not rows[3]["truncated"]


def test_nearest_rank_matches_sorting_even_with_a_hot_group(spark):
    rnd = random.Random(1)
    data = [("hot", float(rnd.randint(0, 50))) for _ in range(3000)] + [("b", rnd.random()) for _ in range(101)] + [("c", 7.0)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {(r["g"], r["pct"]): r["v"] for r in nearest_rank(df, "g", "v", [0, 50, 95, 100]).collect()}
    for g in ("hot", "b", "c"):
        s = sorted(v for k, v in data if k == g)
        for p in (0, 50, 95, 100):
            assert got[(g, float(p))] == s[round(p / 100 * (len(s) - 1))]


def test_running_total_in_blocks(spark):
    df = spark.createDataFrame([(1, i, i % 7) for i in range(500)], "k int, o bigint, v int")
    rows = running_total(df, "k", "o", F.col("v"), "t", block=16).orderBy("o").collect()
    total = 0
    for r in rows:
        total += r["v"]
        assert r["t"] == total


def brute_quota(rows, limit, window):
    out, queues = {}, {}
    for eid, who, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        q = queues.setdefault(who, [])
        q[:] = [t for t in q if (ts - t).total_seconds() <= window]
        out[eid] = len(q) < limit
        if out[eid]:
            q.append(ts)
    return out


def test_quota_matches_brute_force_with_a_hot_key(spark):
    rnd = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 1 if rnd.random() < 0.5 else rnd.randint(2, 9), t0 + dt.timedelta(seconds=rnd.randint(0, 200_000))) for i in range(1500)]
    df = spark.createDataFrame(rows, "id bigint, who bigint, ts timestamp")
    got = {r["id"]: r["allowed"] for r in lifecycle.quota(df, "who", "ts", "id", 2, 600).collect()}
    assert got == brute_quota(rows, 2, 600)


def test_quota_third_request_is_refused(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, 1, t0 + dt.timedelta(seconds=i)) for i in range(3)], "id bigint, who bigint, ts timestamp")
    assert [r["allowed"] for r in lifecycle.quota(df, "who", "ts", "id", 2, 60).orderBy("id").collect()] == [True, True, False]


def test_expired_sessions(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    s = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 14)), (2, dt.datetime(2024, 1, 1, 23)), (3, dt.datetime(2024, 1, 1, 14))], "session_id int, created_at timestamp")
    jobs = spark.createDataFrame([(3, "running"), (1, "failed")], "session_id int, state string")
    assert [r["session_id"] for r in lifecycle.expired_sessions(s, jobs, now, ttl_hours=24, retention_hours=2).collect()] == [1]


def test_license_and_redaction(spark):
    df = spark.createDataFrame([("CC-BY 4.0",), ("CC BY-NC",), ("CC0",), ("public domain",), ("MIT",)], "t string")
    assert [r["x"] for r in df.select(lifecycle.license_ok(F.col("t")).alias("x")).collect()] == [True, False, True, True, False]
    df = spark.createDataFrame([(1, "api_key: abc rest sk-abcdefghij")], "doc_id int, text string")
    assert lifecycle.redacted(df).first()["clean"] == "[REDACTED] rest [REDACTED]"


def brute_tokens(text):
    import re

    words = {w.lower() for w in re.findall(packs.ASCII_WORD, text)}
    han = re.sub(packs.NOT_HAN, "", text)
    return words | ({han} if len(han) == 1 else {han[i : i + 2] for i in range(len(han) - 1)})


def test_search_matches_brute_force(spark, frame_of):
    texts = ["数据划分采用随机种子。", "seed and split of the data", "无关内容", "未报告数据划分 split"]
    ch = retrieval.chunks(frame_of({1: texts}))
    q = spark.createDataFrame([("q", "划分 split seed")], "query_id string, text string")
    got = [r["para_idx"] for r in retrieval.search(ch, q).orderBy("rank").collect()]
    want = sorted((i for i, t in enumerate(texts) if brute_tokens(t) & brute_tokens("划分 split seed")), key=lambda i: (-len(brute_tokens(texts[i]) & brute_tokens("划分 split seed")), i))
    assert got == want
    assert [r["para_idx"] for r in retrieval.search(ch, q, counter=True).collect()] == [3]


def test_context_packing_is_greedy(frame_of):
    ctx = retrieval.directed_context(with_elements(frame_of({1: ["数据划分采用随机种子。" * 30, "样本量依据不足。", "准确率 0.9。"]})))
    full = retrieval.pack_context(ctx, budget=0).first()
    sizes = [(b["item_id"], len(b["text"])) for b in full["blocks"]]
    for budget in (1, 500, 1500):
        used, kept, dropped = 0, [], []
        for i, n in sizes:
            if kept and used + n > budget:
                dropped.append(i)
            else:
                kept.append(i)
                used += n + 2
        p = retrieval.pack_context(ctx, budget=budget).first()["packed"]
        assert (p["kept"], p["dropped"], p["used"]) == (kept, dropped, used)


def test_revise_and_compare(frame_of):
    fr = frame_of({1: [("方法", "Heading 1"), "本研究纳入 300 例患者，采用 t 检验，p<0.05。", ("讨论", "Heading 1"), "结果良好。", "普通段落。"]})
    out = review_and_compare(fr)
    change = {r["item_id"]: r["change"] for r in out["diff"].collect()}
    assert change["R-02"] == "resolved" and change["R-15"] == "resolved" and change["R-09"] == "resolved"
    plan = {r["item_id"]: (r["status"], r["target"]) for r in out["plan"].collect()}
    assert plan["R-15"] == ("rewritten", 3) and plan["R-02"] == ("rewritten", 1)
    text = {p["para_idx"]: p["text"] for p in out["revised"].select(F.inline("paras")).collect()}
    assert text[3] == "结果良好。" + packs.REVISION_TEXT["R-15"]


def test_markdown_report(frame_of):
    md = reports.markdown(review(frame_of({1: ["准确率 0.9。"]}))).first()["markdown"]
    assert md.startswith("# 方法学审查报告 · doc-1") and "- 清单条目：R-09" in md and "## 本项未能判定" in md


def test_markdown_whole(spark):
    """Every line of a report, in order: run, card, gates by first appearance, findings, doubts, open items, notes."""
    cols = "doc_id bigint, source string, paper_type string, seq bigint, item_id string, verdict string, severity string, certainty string, grade string, confidence double, gate_reason string, anchors array<int>, headline string, description string, suggestion string"
    rows = [
        (1, "s", "empirical", 2, "R-02", "uncertain", "low", "suspected", "C", 0.5, "advisory", [], "B %s", "", "fix {0}"),
        (1, "s", "empirical", 1, "R-01", "problem", "high", "deterministic", "A", 1.0, "direct", [7, 9], "A", "why", ""),
        (1, "s", "empirical", 3, "R-03", "not_applicable", "low", "undetermined", "D", 0.0, "not_evaluated", [], "C", "no cue", ""),
        (2, "t", "review", 1, "R-01", "pass", "low", "deterministic", "A", 0.8, "direct", [1], "P", "", ""),
    ]
    f = spark.createDataFrame(rows, cols)
    runs = spark.createDataFrame([(1, "r1", 12)], "doc_id bigint, report_id string, duration_ms int")
    notes = spark.createDataFrame([(1, ["n1", "n2"])], "doc_id bigint, notes array<string>")
    got = {r.doc_id: r.markdown.split("\n") for r in reports.markdown(f, runs, notes).collect()}
    assert got[1] == [
        "# 方法学审查报告 · s", "", "- 报告 ID：r1", "- 清单版本：1.0", "- 问题统计：严重 1 / 中等 0 / 轻微 0（共 1）", "- 确定性统计：确定性 1 / 疑似 1 / 未判定 1", "- 审查耗时：12 ms", "",
        "## 输出质量卡", "- 分级分布：A 高置信 1 / B 中置信 0 / C 低置信 1 / D 待确认 1", "- 平均置信度：0.75（0–1，越高越可采信）", "- 审查率：2/17 = 12%（已评估条目 / 适用条目）", "",
        "- 门控分布：direct 1、advisory 1、not_evaluated 1", "",
        "## [严重·确定性·A 高置信] A", "- 清单条目：R-01", "- 原文定位：段落 7", "- 置信度：1.0（高置信）", "- 说明：why", "",
        "## [轻微·疑似·C 低置信] B %s", "- 清单条目：R-02", "- 原文定位：位置未定", "- 置信度：0.5（低置信）", "- 建议：fix {0}", "",
        "> 其中存疑（需人工复核）1 项，见上文带「疑似 / 未判定」标签的条目。", "", "## 本项未能判定（证据不足，不计入问题数）", "- [R-03] no cue", "", "## 备注", "- n1", "- n2",
    ]
    assert got[2][2] == "- 报告 ID：" and got[2][6] == "- 审查耗时：0 ms" and got[2][-2:] == ["- 置信度：0.8（高置信）", ""]
    assert reports.markdown(f.limit(0), runs, notes).count() == 0


def test_evaluation_arithmetic(spark):
    f = spark.createDataFrame([(1, "R-01", "problem", 0, "mid", "X", [5]), (1, "R-02", "problem", 1, "low", "X", [9]), (1, "R-FIG-01", "problem", 2, "low", "X", [1])], "doc_id bigint, item_id string, verdict string, seq bigint, severity string, code string, anchors array<int>")
    t = spark.createDataFrame([(1, "real", "R-01", 6), (1, "real", "R-03", 2)], "doc_id bigint, grp string, item_id string, para_idx int")
    r = evaluate.group_report(evaluate.detection(f, t)).filter("grp IS NULL").first()
    assert r["samples"] == 1
    assert (r["expected"], r["hit"], r["fp"], r["recall"], r["precision"], r["anchor_rate"]) == (2, 1, 1, 0.5, 0.5, 1.0)


def test_ablation_without_elements_finds_less(spark, frame_of):
    fr = frame_of({1: ["准确率 0.9。", "在测试集上调参。"]})
    truth = spark.createDataFrame([(1, "fixture", "R-09", 0)], "doc_id bigint, grp string, item_id string, para_idx int")
    rows = {r["variant"]: r for r in evaluate.ablation({"E": review(fr, use_elements=False, use_gates=False), "C": review(fr)}, truth).collect()}
    assert rows["E"]["detection"] == 0.0 and rows["C"]["detection"] == 1.0 and rows["E"]["review_rate"] < rows["C"]["review_rate"]


def test_thresholds_and_consistency(spark):
    m = spark.createDataFrame([("detection", 0.99), ("precision", 0.5)], "name string, value double")
    assert {r["name"] for r in evaluate.below_floor(m).collect()} == {"precision", "element_f1"}
    runs = spark.createDataFrame([(1, 0, "a", "problem"), (1, 1, "a", "problem"), (1, 0, "b", "pass"), (1, 1, "b", "problem"), (1, 0, "c", "pass")], "doc_id int, run int, item_id string, verdict string")
    r = evaluate.run_consistency(runs, 2).first()
    assert (r["common_items"], r["stable_items"], r["problem_inter"], r["problem_union"]) == (2, 1, 1, 2)


def test_folded_patterns_keep_their_classes(spark):
    from pyspark.sql import functions as F

    from paperlens.operators.elements import folded, tag

    assert folded(r"AB\D\S\p{Lu}[A-Z]") == r"ab\D\S\p{Lu}[a-z]"
    df = spark.createDataFrame([("ab12",), ("ABxx",)], "t string")
    assert [r[0] for r in df.select(tag(F.col("t"), {"k": [r"Ab\D"]})).collect()] == [[], ["k"]]


def test_false_positives_of_clean_documents_count(spark):
    from paperlens.operators.evaluate import detection, group_report
    from paperlens.packs import ITEM_IDS

    item = ITEM_IDS[0]
    found = spark.createDataFrame([(1, 0, item, "problem", "major", "c", [3]), (2, 0, item, "problem", "major", "c", [5])], "doc_id bigint, seq int, item_id string, verdict string, severity string, code string, anchors array<int>")
    truth = spark.createDataFrame([(1, "flawed", item, 3)], "doc_id bigint, grp string, item_id string, para_idx int")
    samples = spark.createDataFrame([(1, "flawed"), (2, "clean")], "doc_id bigint, grp string")
    overall = group_report(detection(found, truth, samples=samples)).filter("grp is null").first()
    assert (overall["hit"], overall["fp"], overall["precision"]) == (1, 1, 0.5)


def test_quota_keeps_requests_without_a_time(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a', timestamp_ntz'2024-01-01 00:00:00'), (2, 'a', null), (3, 'a', timestamp_ntz'2024-01-01 00:00:10') AS t(id, who, ts)")
    assert {r.id: r.allowed for r in lifecycle.quota(df, "who", "ts", "id", 1, 60).collect()} == {1: True, 2: None, 3: False}


def test_element_metrics_skip_unlabelled_documents(spark):
    pair = "doc_id bigint, type string"
    found = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], pair)
    gold, labelled = spark.createDataFrame([(1, "a")], pair), spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    r = evaluate.element_metrics(found, gold, labelled).first()
    assert (r.tp, r.predicted, r.annotated, r.precision) == (1, 2, 1, 0.5)


def test_quota_keeps_requests_without_a_key(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 7L, timestamp_ntz'2024-01-01 00:00:00'), (2, null, timestamp_ntz'2024-01-01 00:00:05'), (3, 7L, timestamp_ntz'2024-01-01 00:00:10'), (4, null, null) AS t(id, who, ts)")
    assert {r.id: r.allowed for r in lifecycle.quota(df, "who", "ts", "id", 1, 60).collect()} == {1: True, 2: None, 3: False, 4: None}
    assert sorted(r.id for r in previous_time(df.filter("ts IS NOT NULL"), "who", "ts", "id").collect()) == [1, 2, 3]


def test_quota_stream_decides_files_that_arrive_in_falling_order(spark, tmp_path):
    from paperlens.streaming.quota_stream import decided, quota_stream, requests_log

    t0 = dt.datetime(2024, 1, 1)
    # user 2 comes in order; the others' later files hold earlier times, some beyond the watermark
    files = [[(1, 1, 7200), (2, 1, 7230), (3, 2, 0)], [(4, 1, 7000), (5, 1, 7190), (6, 2, 7210), (7, 3, 100)], [(8, 1, 10), (9, 1, 20), (10, 1, 30), (11, 2, 7220), (12, 2, 7225), (13, None, 50), (14, 1, None)]]
    d, schema = str(tmp_path), "id bigint, who bigint, ts timestamp"
    rows = [[(i, who, None if t is None else t0 + dt.timedelta(seconds=t)) for i, who, t in f] for f in files]
    for f in rows:
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    for name, out in (("told", quota_stream(events, "who", "ts", "id", 2, 600)), ("log", requests_log(events, "who", "ts", "id"))):
        out.writeStream.format("parquet").option("path", f"{d}/{name}").option("checkpointLocation", f"{d}/c-{name}").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    told, log = spark.read.parquet(f"{d}/told"), spark.read.parquet(f"{d}/log")
    assert told.count() < log.count() == 14
    got = {r.id: r.allowed for r in decided(log, told, "who", "ts", "id", 2, 600).collect()}
    whole = [r for f in rows for r in f if r[1] is not None and r[2] is not None]
    assert got == brute_quota(whole, 2, 600) | {13: None, 14: None}


def test_ranks_of_small_groups_are_found(spark):
    """At 199 rows a sketch's rank for 95 % is one above the nearest rank."""
    from paperlens.functions.ranks import nearest_rank

    sizes = [1, 2, 13, 93, 199, 200]
    df = spark.createDataFrame([(n, float(i)) for n in sizes for i in range(n)], "g int, v double").repartition(3)
    got = {(r["g"], r["pct"]): r["v"] for r in nearest_rank(df, "g", "v", [50, 95]).collect()}
    assert got == {(n, float(p)): float(round(p / 100 * (n - 1))) for n in sizes for p in (50, 95)}
