from pyspark.sql import functions as F

from paperlens import packs
from paperlens.functions import text as T
from paperlens.operators import elements, structure


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_sentences_keep_offsets_and_split_by_script(spark):
    text = "结果良好。随访完成！See Fig. 2 for 0.912 detail. Next one starts (here). end"
    spans = one(spark, text, T.sentence_spans)
    assert [s["text"] for s in spans] == ["结果良好。", "随访完成！", "See Fig. 2 for 0.912 detail.", "Next one starts (here). end"]
    for s in spans:
        assert text[s["char_start"] : s["char_end"]].strip() == s["text"]


def test_number_before_full_stop_does_not_split(spark):
    assert one(spark, "We used 2. Methods follow", T.sentences) == ["We used 2. Methods follow"]


def test_citation_tokens_and_ranges(spark):
    assert one(spark, "见[1-3,5]与[7]。", lambda c: F.flatten(F.transform(structure.citation_tokens(c), structure.expand_numbers))) == [1, 2, 3, 5, 7]
    assert one(spark, "[5-3]", structure.expand_numbers) == []
    assert one(spark, "R² 为 0.9。¹² 后文", structure.citation_tokens) == ["12"]
    assert one(spark, "[12] Author. Title", structure.citation_tokens) == []
    assert one(spark, "[1-99999999999]", structure.expand_numbers) is None
    wide = one(spark, "[1-200001]", structure.expand_numbers)
    assert len(wide) == 200001 and wide[-1] == 200001
    known = F.array(*[F.lit(n).cast("bigint") for n in (3, 1, 7, 3)])
    gaps = one(spark, "[1-5,7,9-99999999999]", lambda c: structure.outside(structure.ranges(c), known))
    assert [(g.lo, g.hi) for g in gaps] == [(2, 2), (4, 5), (9, 99999999999)]
    assert one(spark, "[1-3,9-99999999999]", lambda c: structure.spelled(structure.ranges(c))) == "1, 2, 3, 9-99999999999"


def test_reference_heading_and_number(spark):
    for t in ("References", "7 References", "六、参考文献", "参考文献（References）", "Bibliography."):
        assert one(spark, t, structure.is_reference_heading), t
    assert not one(spark, "参考文献综述", structure.is_reference_heading)
    assert [one(spark, t, structure.reference_number) for t in ("[3]张三", "4. Lee", "5、王", "6 Kim", "Kim 6")] == [3, 4, 5, 6, None]


def test_headings(frame_of):
    fr = frame_of({1: ["1.2 数据", "摘要", "图1 结构", "方法如下所述。", "普通段落", ("Custom", "Heading 3"), ("T", "Title")]})
    rows = structure.paragraphs(fr).orderBy("para_idx").collect()
    assert [(r["is_heading"], r["level"], r["reason"]) for r in rows] == [
        (True, 2, "numbering"), (True, 1, "keyword"), (False, None, None), (False, None, None), (False, None, None), (True, 3, "style"), (True, 0, "style"),
    ]
    assert rows[0]["style"] == "HeuristicHeading"


def test_table_grid_caption_and_gaps(frame_of):
    fr = frame_of({1: ["正文", "表1 基线", "列 | 值 | 注", "a | 1", "", "x | y", "尾段"]})
    t = structure.tables(fr).orderBy("tbl_idx").collect()
    assert [x["n_rows"] for x in t] == [2, 1]
    assert t[0]["rows"] == [["列", "值", "注"], ["a", "1", None]] and t[0]["header_rows"] == 1
    assert t[0]["caption"] == "表1 基线" and t[0]["anchor"] == 1 and t[1]["anchor"] == 1
    assert [r["para_idx"] for r in structure.paragraphs(fr).orderBy("para_idx").collect()] == [0, 1, 6]


def test_image_caption_prefers_below(frame_of):
    fr = frame_of({1: ["图1 上方", "![a](x.png)", "", "正文", "图2 下方"], 2: ["图3 上方", "![b](y.jpg)", "正文"]})
    rows = {r["doc_id"]: r for r in structure.images(fr).collect()}
    assert (rows[1]["caption"], rows[1]["caption_para"], rows[1]["anchor"]) == ("图2 下方", 4, 0)
    assert (rows[2]["caption"], rows[2]["media_type"]) == ("图3 上方", "image/jpeg")


def test_references_last_wins_and_unresolved(frame_of):
    fr = frame_of({1: ["引言见[1]和[9]。", "参考文献", "[1] A", "[2] B", "[1] C"]})
    refs = {r["number"]: (r["text"], r["para_idx"]) for r in structure.references(fr).collect()}
    assert refs == {1: ("[1] C", 4), 2: ("[2] B", 3)}
    cites = structure.citations(fr).orderBy("cite_idx").collect()
    assert [(c["marker"], c["unresolved"]) for c in cites] == [("[1]", []), ("[9]", [9])]


def test_tagging_prefilter_changes_nothing(spark):
    from paperlens.functions.text import any_of, ci

    texts = packs.BANK + [t for t, _ in packs.HEADINGS] + ["95% ci 0.1", "Mean ± SD", "FDR法校正", "seed = 3", "1,200 eye images", "n=40", "Nothing here at all", "p = .03"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    naive = F.array_compact(F.array(*[F.when(F.col("t").rlike(ci(any_of(ps))), F.lit(k)) for k, ps in packs.ELEMENT_PATTERNS.items()]))
    bad = df.select("t", elements.tag(F.col("t")).alias("fast"), naive.alias("slow")).filter("fast <> slow").collect()
    assert bad == []


def test_needs_han():
    assert T.needs_han("(训练集|\\d+\\s*折)") and not T.needs_han("(95%\\s*(?:置信区间|CI)|置信区间)") and not T.needs_han("(\\[|范围)")


def test_language_and_numerals(spark):
    assert one(spark, "ab汉字", T.language) == "zh" and one(spark, "abc汉字", T.language) == "en" and one(spark, "", T.language) == "zh"
    assert [one(spark, t, T.zh_number) for t in ("12", "十", "十二", "二十", "九十九", "三", "百")] == [12, 10, 12, 20, 99, 3, None]


def test_section_extent(frame_of):
    fr = frame_of({1: ["前言段", "1 引言", "a段", "b段", "2 方法", "c段"]})
    rows = structure.section_extent(fr).orderBy("para_idx").collect()
    assert [(r["para_idx"], r["section_idx"], r["section_end"]) for r in rows] == [(0, None, 1), (2, 1, 4), (3, 1, 4), (5, 4, None)]
