"""Image readings in the review."""

from pyspark.sql import functions as F

from paperlens import packs
from paperlens.plans.review import document_facts, review
from paperlens.sources.verdicts import image_findings, parse_readings

READ = "doc_id bigint, img_idx int, byte_size bigint, content string"


def reading(doc, k, content, size=100):
    return (doc, k, size, content)


def documents(frame_of):
    return frame_of({1: ["Intro", "![a](images/a.png)", "图1 测试用的说明", "Text of the study.", "![b](images/b.jpg)", "![c](c.png)", "![d](d.png)", "![e](e.png)"], 2: ["No image here."], 3: ["![x](x.png)"]})


def test_readings_become_advisory_findings_at_their_image(spark, frame_of):
    fr = documents(frame_of)
    rows = [
        reading(1, 0, '{"values": ["n=42", " ", 0.5, null], "concern": null}'),
        reading(1, 1, '{"values": [], "concern": "axis without a unit"}'),
        reading(1, 2, '{"values": [], "concern": ""}'),  # says nothing
        reading(1, 3, "no json"),
        reading(1, 4, '{"values": ["beyond the first four"]}'),
        reading(2, 0, '{"values": ["1"]}'),  # no such image
        reading(3, 0, '{"values": ["1"]}', packs.IMAGE_BYTES_MAX + 1),
        reading(3, 0, '{"values": ["2"]}', 0),
        reading(3, 0, '{"values": ["3"]}', None),
        reading(None, 0, '{"values": ["4"]}'),
        reading(3, None, '{"values": ["5"]}'),
        reading(3, 0, '{"values": [%s]}' % ", ".join(f'"v{i}"' for i in range(20)), packs.IMAGE_BYTES_MAX),
    ]
    got = review(fr, readings=parse_readings(spark.createDataFrame(rows, READ)), demote=True)
    plain = review(fr, demote=True)
    assert got.filter("phase < 5").count() == plain.count() and plain.columns == got.columns
    found = {(r.doc_id, r.seq & 0xFFFF): r for r in got.filter("phase = 5").collect()}
    assert set(found) == {(1, 0), (1, 1), (3, 0)}
    first = found[1, 0]
    assert (first.item_id, first.engine, first.verdict, first.severity, first.certainty) == ("R-FIG-02", "llm", "uncertain", "low", "suspected")
    assert (first.evidence_gate, first.advisory, first.gate_reason, first.confidence, first.grade) == ("vision_read", True, "advisory", 0.27, "D")
    assert first.headline.endswith("图1 测试用的说明") and "n=42、0.5。" in first.description and first.suggestion == packs.IMAGE_SUGGESTION
    assert first.anchors == [r["anchor"] for r in fr.select(F.explode("images").alias("i")).select("i.*").filter("path = 'images/a.png'").collect()]
    assert "第 1 张插图" in found[3, 0].headline and "axis without a unit" in found[1, 1].description
    assert "v11" in found[3, 0].description and "v12" not in found[3, 0].description


def test_verdicts_and_readings_share_one_join(spark, frame_of):
    facts = document_facts(documents(frame_of))
    kinds = "doc_id bigint, mseq int, verdict string, severity string, headline string, description string, suggestion string, item_id string"
    verdicts = spark.createDataFrame([(1, 0, "problem", "mid", "h", "d", "s", "R-09"), (3, 0, "problem", "mid", "h", "d", "s", "R-09")], kinds)
    readings = parse_readings(spark.createDataFrame([reading(1, 0, '{"values": ["7"]}'), reading(3, 0, '{"values": ["8"]}')], READ))
    both = review(facts=facts, verdicts=verdicts, readings=readings)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    alone = review(facts=facts, verdicts=verdicts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == alone.count("Join ")
    assert both.filter("phase = 5").count() == 2
    rows = lambda r: sorted(map(str, r.filter("phase < 5").collect()))
    assert rows(both) == rows(review(facts=facts, verdicts=verdicts))
    empty = review(facts=facts, readings=readings.limit(0))
    assert empty.filter("phase = 5").count() == 0 and empty.count() == review(facts=facts).count()


def test_findings_without_a_review(spark):
    rows = spark.createDataFrame([(1, 0, 10, '{"values": ["1"]}', "", 4), (1, 1, 10, '{"concern": "odd"}', "图2", 5)], READ + ", caption string, anchor int")
    assert [(r.anchor, r.n_values, r.headline[-2:]) for r in image_findings(rows).orderBy("img_idx").collect()] == [(4, 1, "插图"), (5, 0, "图2")]
