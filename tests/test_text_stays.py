"""Quotes, offers and supplements meet the texts in their documents' rows."""

import re

import pytest
from pyspark.sql import functions as F

from paperlens import packs
from paperlens.operators import reconcile, reports, structure
from paperlens.sources.intake import text_blocks
from paperlens.sources.sinks import save_bucketed

TEXTS = {
    1: ["采用 Bonferroni 校正，处理多重比较问题。", "其他的一段文字。", "组间差异经检验，具有统计学意义。"],
    2: ["a | Bonferroni 校正值 | 0.05 的水平", "组间差异经检验，具有统计学意义。"],
    3: ["没有任何依据。"],
}


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    spark.sql("CREATE DATABASE IF NOT EXISTS stays LOCATION '%s'" % tmp_path_factory.mktemp("stays"))
    rows = spark.createDataFrame([(k, "\n".join(t), "s") for k, t in TEXTS.items()], "doc_id bigint, text string, source string")
    yield structure.frame(text_blocks(save_bucketed(rows, "stays.documents", buckets=8)))
    spark.sql("DROP DATABASE stays CASCADE")


def moved(df) -> set:
    """Names of the columns that exchanges move."""
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    found = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*?)\]", plan)
    return {re.sub(r"#\d+L?$", "", c.strip()) for x in found for c in x.split(",")}


def asked(spark):
    pending = spark.createDataFrame([(d, s, s, i) for d in TEXTS for s, i in ((1, "R-08"), (2, "R-07"))], "doc_id bigint, seq bigint, rn int, item_id string")
    texts = ["Bonferroni校正处理多重比较", "Bonferroni 校正值 | 0.05 的水平", "组间差异经检验具有统计学意义", "短检验", "从未出现在文中的检验说明文字"]
    quotes = spark.createDataFrame([(d, rn, k, q) for d in TEXTS for rn in (1, 2) for k, q in enumerate(texts)], "doc_id bigint, rn int, position int, quote string")
    return pending, quotes


def test_quotes_in_rows_equal_those_in_a_table_of_units(spark, bucketed):
    pending, quotes = asked(spark)
    rows = lambda df: sorted(map(str, df.collect()))
    got = reconcile.verify_quotes_in_rows(pending, quotes, bucketed)
    assert rows(got) == rows(reconcile.verify_quotes(pending, quotes, structure.units(bucketed)))
    assert {(r.doc_id, r.seq) for r in got.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert reconcile.verify_quotes_in_rows(pending.limit(0), quotes, bucketed).count() == 0


def test_no_text_is_exchanged(spark, bucketed):
    pending, quotes = asked(spark)
    offers = spark.createDataFrame([(1, "R-08", "T", "校正，处理多重比较"), (3, "R-08", "T", "没有"), (2, "R-08", "T", "nowhere in it")], "doc_id bigint, item_id string, text string, quote string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.createDataFrame([(1, 1, "R-08", 0, "more", "rewritten"), (1, 2, "R-07", 0, "again", "rewritten"), (2, 1, "R-08", 0, "x", "pending")], "doc_id bigint, seq bigint, item_id string, target int, text string, status string")
        revised = reports.revised_frame(bucketed, plan)
        for df in (reconcile.verify_quotes_in_rows(pending, quotes, bucketed), reports.accepted_offers(offers.withColumnRenamed("text", "t").withColumnRenamed("t", "text"), bucketed)):
            assert "asked" in moved(df) or "doc_id" in moved(df)
            assert not moved(df) & {"paras", "blocks", "hays", "table_rows"}
        assert not moved(revised) & {"paras", "blocks", "table_rows"}
        assert [(r.doc_id, r.item_id) for r in reports.accepted_offers(offers, bucketed).collect()] == [(1, "R-08")]
        first = revised.filter("doc_id = 1").select(F.col("paras")[0]["text"]).first()[0]
        assert first == TEXTS[1][0] + "moreagain" and revised.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_short_quotes_and_limits(spark, bucketed):
    assert packs.QUOTE_SHOWN == 120
    offers = spark.createDataFrame([(1, "R-08", "", "采用 Bonferroni"), (1, "R-08", "T", "采用"), (None, "R-08", "T", "采用 Bonferroni"), (1, None, "T", None)], "doc_id bigint, item_id string, text string, quote string")
    assert reports.accepted_offers(offers, bucketed).count() == 0
