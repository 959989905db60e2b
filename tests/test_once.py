"""What a document's row needs once is found once, and texts without vocabulary are only marked; against the plain forms."""

import random

from pyspark.sql import functions as F

from paperlens import packs
from paperlens.functions import text as T
from paperlens.operators import elements, retrieval

from test_gated import texts


def plan_of(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_reference_heading_is_looked_for_once(frame_of):
    """Before, it was looked for again for every paragraph: the work was quadratic in the paragraphs of a document."""
    fr = frame_of({1: ["References", "[1] A", "[2] B"], 2: ["[1] A"], 3: ["x", "参考文献", "[7] C", "References", "[8] D"]})
    assert "array_min" in plan_of(fr) and "> array_min(" not in plan_of(fr).replace(" >  ", " > ")
    assert {r[0]: r[1] for r in fr.select("doc_id", F.transform("refs", lambda r: r["number"])).collect()} == {1: [1, 2], 2: [], 3: [7, 8]}


def test_han_characters_are_found_once_for_all_bigrams(spark):
    """Before, the text was searched again for every bigram: the work was quadratic in the length of a text."""
    df = spark.createDataFrame([(t,) for _, t in texts()] + [("数",), ("数 据",), ("a数b据c集",), ("x" * 9,), ("é数",)], "t string")
    got = df.select("t", T.tokens(F.col("t")).alias("k"))
    assert "substr(regexp_replace" not in plan_of(got)

    def brute(t):
        import re

        han = re.sub(packs.NOT_HAN, "", t)
        grams = [han] if len(han) == 1 else [han[i : i + 2] for i in range(len(han) - 1)]
        return list(dict.fromkeys([w.lower() for w in re.findall(packs.ASCII_WORD, t)] + grams))

    assert all(r["k"] is None if r["t"] is None else r["k"] == brute(r["t"]) for r in got.collect())


def test_what_hits_is_marked(spark):
    """A text without the mark of a signal or type must not be hit by it, whatever its case and letters."""
    df = spark.createDataFrame(texts(), "id int, t string").repartition(4).withColumn("m", elements.marks(F.col("t")))
    off = [F.count_if(T.signal(F.col("t"), n) & ~elements.marked(F.col("m"), bit)).alias(n) for n, bit in elements.SIGNAL_BITS.items()]
    for k, bit in elements._bits(packs.ELEMENT_PATTERNS).items():
        plain = F.lower("t").rlike(T.cs(T.any_of(list(map(elements.folded, packs.ELEMENT_PATTERNS[k])))))
        off.append(F.count_if(plain & ~elements.marked(F.col("m"), bit)).alias(k))
    off.append(F.count_if((F.col("t") == "plain words without any of it") & (F.col("m") != 0)).alias("none"))
    assert {k: v for k, v in df.agg(*off).first().asDict().items() if v} == {}


def test_packs_without_plain_texts_are_tried_whole(spark):
    pack = {"digits": [r"\d{3}"], "word": [r"(?<!x)yes"], "any": [r"a.c"]}
    df = spark.createDataFrame([("12",), ("123 abc",), ("xyes",), ("YES",), (None,)], "t string")
    assert [r[0] for r in df.select(elements.tag(F.col("t"), pack)).collect()] == [[], ["digits", "any"], [], ["word"], []]


def test_signals_over_several_lines_survive_shortening(spark, frame_of):
    """Signals that begin on one line and end on another, beside long lines without any vocabulary."""
    rnd = random.Random(11)
    long = ["the lines that nothing is in " * 4, "und noch eine längere zeile ohne worte " * 3, " " * 3 + "blank at the beginning and no more of it at all to be found here", "it ends in blanks " * 4 + "  "]
    heads = ["paired", "with a paired", "10 种", "共 3 个", "logistic", "grid", "text", "仅与", "以", "对比方法为", "p", "训练 " * 20, "和 12"]
    tails = ["t is", "regression was it", "模型", "个数据集上的模型，比较", "search", "classification", "某某作为基线", "< .05", "种方法 比较", "搜索"]
    docs = {}
    for i in range(150):
        lines = []
        for _ in range(rnd.randint(1, 4)):
            head, tail = rnd.choice(heads), rnd.choice(tails)
            if rnd.random() < 0.5:
                head, tail = rnd.choice(long) + head, tail + " " + rnd.choice(long)
            lines += [head, *([rnd.choice(long)] if rnd.random() < 0.2 else []), tail, *rnd.choices([*long, *packs.BANK], k=rnd.randint(0, 3))]
        docs[i] = lines
    fr = frame_of(docs)
    plain = F.array_join(F.concat(F.transform("paras", lambda p: p["text"]), F.transform("table_rows", lambda r: r["text"])), "\n")
    spoken = F.array_join(F.transform("paras", lambda p: p["text"]), "\n")
    f = elements.paper_type(elements.with_features(elements.with_elements(fr)))
    off = [F.count_if(~F.col(f"sig.{n}").eqNullSafe(T.signal(plain, n))).alias(n) for n in elements.BODY_SIGNALS]
    for n, c in (("review", "review_hits"), ("strong_review", "strong_hits"), ("empirical", "empirical_hits")):
        off.append(F.count_if(~F.col(c).eqNullSafe(F.regexp_count(spoken, F.lit(T.signal_pattern(n))))).alias(c))
    hit = [F.count_if(f"sig.{n}").alias(f"hit_{n}") for n in ("named_test", "multi_comparison", "single_baseline", "class_task", "hyper_search")]
    got = f.agg(*off, *hit).first().asDict()
    assert {k: v for k, v in got.items() if v and not k.startswith("hit_")} == {} and all(v for k, v in got.items() if k.startswith("hit_"))


def test_items_and_chunks_meet_in_words_of_both(frame_of):
    """Before, every chunk met all the words that items ask for."""
    lines = ["数据划分采用随机种子 seed 42。", "the sample of nothing", "准确率 0.9，样本量依据不足。"]
    got = retrieval.directed_context(elements.with_elements(frame_of({1: lines})))
    assert "shared" in plan_of(got)
    rows = retrieval.context_rows(got).filter("item_id = 'R-02' and role = 'support'").collect()
    assert rows and rows[0]["para_idx"] == 2
