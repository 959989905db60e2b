import json

import pytest
from pyspark.sql import functions as F

from paperlens import packs
from paperlens.sources import checklists, intake, verdicts
from paperlens.sources.sections import excerpts


def item(i, **kw):
    return {"id": i, "title": f"t{i}", "severity_default": "mid", "judge": "llm", "requires": ["element:metric", "other"], "templates": [], **kw}


def write(path, obj):
    path.write_text(json.dumps(obj, ensure_ascii=False), encoding="utf-8")


def test_checklist_files(spark, tmp_path):
    write(tmp_path / "a.json", {"items": [item("A1"), item("A2", templates=["quant"])]})
    write(tmp_path / "b.json", [item("B1")])
    rows = checklists.read_checklists(spark, str(tmp_path))
    assert sorted((r["checklist"], r["item_id"]) for r in rows.collect()) == [("a", "A1"), ("a", "A2"), ("b", "B1")]
    got = checklists.load_checklist(spark, str(tmp_path / "a.json"))
    assert sorted((r[0], r[1]) for r in got) == [("A1", ["metric"]), ("A2", ["metric"])]


@pytest.mark.parametrize("items", [[item("X"), item("X")], [item("X", severity_default="huge")], [item("X", title=None)]])
def test_bad_checklists_are_refused(spark, tmp_path, items):
    write(tmp_path / "c.json", {"items": items})
    with pytest.raises(checklists.ChecklistError):
        checklists.load_checklist(spark, str(tmp_path / "c.json"))


def test_short_checklist_is_refused(spark, tmp_path):
    write(tmp_path / "c.json", {"items": [item("X")]})
    with pytest.raises(checklists.ChecklistError):
        checklists.load_checklist(spark, str(tmp_path / "c.json"), min_items=packs.MIN_ITEMS)


def test_truth_files(spark, tmp_path):
    write(tmp_path / "x.json", {"sample_id": "x", "type": "real", "items": [{"checklist_item_id": "R-01", "severity_expected": "mid", "anchor": {"paragraph_index": 3}}]})
    write(tmp_path / "y.json", {"sample_id": "y", "type": "odd"})
    assert [tuple(r) for r in checklists.read_truth(spark, str(tmp_path)).collect()] == [("x", "real", "R-01", "mid", 3)]


def test_admission_order(spark):
    ok = "PK\u0003\u0004"
    rows = [("a.PDF", 0, "", 1, 1, 0), ("a.txt", 1, ok, 1, 1, 0), ("a.docx", 0, ok, 1, 1, 0), ("a.docx", 60 << 20, ok, 1, 1, 0), ("a.docx", 1, "MZ", 1, 1, 0), ("a.docx", 1, ok, 500, 1, 0), ("a.docx", 1, ok, 1, 1, 9), ("a.docx", 1, ok, 1, 1, 0), ("noext", 1, ok, 1, 1, 0)]
    df = spark.createDataFrame(rows, "name string, size long, head string, total_bytes long, packed_bytes long, pages int")
    got = [r["reject_code"] for r in intake.admission(df, max_pages=5).collect()]
    assert got == ["pdf_not_supported", "unsupported_file_type", "empty_file", "file_too_large", "file_content_mismatch", "file_too_large_uncompressed", "too_many_pages", None, "unsupported_file_type"]


def test_html_blocks_and_excerpts(spark):
    long = "word " * 20
    html = f"<html><head><title>x</title></head><body><h1>Intro</h1><p>skip {long}</p><h2>Methods</h2><p>{long}</p><p>short</p><p>more {long}</p></body></html>"
    p = spark.createDataFrame([(1, "u", html), (2, "u", f"<p>{long}</p>")], "page_id bigint, url string, html string")
    rows = intake.block_rows(intake.html_blocks(p)).filter("doc_id = 1").orderBy("para_idx").collect()
    assert [(r["style"], r["text"][:5]) for r in rows][:3] == [("Heading 1", "Intro"), ("Normal", "skip "), ("Heading 2", "Metho")]
    e = {r["page_id"]: r for r in excerpts(p).collect()}
    assert e[1]["from_section"] and e[1]["excerpt"] == f"{long.strip()} more {long.strip()}" and not e[2]["from_section"]


def test_image_readings(spark):
    rows = [(1, 0, "图1", 3, 10, '{"values":["0.9"," "],"concern":null}'), (1, 1, "", 4, 10, '{"values":[],"concern":""}'), (1, 2, "", 4, 5 << 20, '{"values":["1"]}'), (1, 4, "", 4, 1, '{"values":["1"]}'), (1, 3, "", 5, 1, '{"values":[],"concern":"c"}')]
    df = spark.createDataFrame(rows, "doc_id bigint, img_idx int, caption string, anchor int, byte_size long, content string")
    got = {r["img_idx"]: r for r in verdicts.image_findings(df).collect()}
    assert set(got) == {0, 3} and got[0]["n_values"] == 1 and "疑点：c" in got[3]["description"]
