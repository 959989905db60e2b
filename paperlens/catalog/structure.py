"""Sources, structure, elements, anchors, classification, rules, checks."""

from pyspark.sql import functions as F

from paperlens import packs as P
from paperlens.catalog import query
from paperlens.catalog.common import docs, overlay_frame, raw_frame, rule_rows, tagged
from paperlens.functions.text import ci, cs, language, sentence_spans, signal, zh_number
from paperlens.operators import checks, elements, structure
from paperlens.oracle.sql import _BARE, _BASE, kindof, q, rx, sig, sql, zh
from paperlens.sources import intake
from paperlens.sources.intake import read, spread

TAGS = r"regexp_replace(html, '<[^>]*>', '', 'g')"
NAME = "regexp_replace(url, '[?#].*$', '')"
UPLOAD = f"""SELECT page_id, {NAME} AS name, length(html) AS size, left(html, 15) AS head, length(html) AS total_bytes, length({TAGS}) AS packed_bytes, len(regexp_extract_all(html, '<p>')) AS pages FROM pages"""
EXT = "CASE WHEN contains(name, '.') THEN '.' || string_split(lower(name), '.')[-1] ELSE '' END"


def uploads(spark, d):
    return intake.page_uploads(spread(read(spark, d, "pages")))


@query(
    "src_admission_screen",
    f"""SELECT page_id, CASE WHEN {EXT} = '.pdf' THEN 'pdf_not_supported' WHEN {EXT} NOT IN ('.com/en/25', '.net/en/25') AND NOT regexp_matches({EXT}, '^[.](com|net)/') THEN 'unsupported_file_type' WHEN size <= 0 THEN 'empty_file' WHEN size > 8192 THEN 'file_too_large' WHEN NOT starts_with(head, '<!DOCTYPE') THEN 'file_content_mismatch' WHEN total_bytes > 314572800 OR total_bytes / greatest(packed_bytes, 1) > 120 THEN 'file_too_large_uncompressed' END AS reject_code FROM ({UPLOAD})""",
)
def src_admission(spark, d):
    ups = uploads(spark, d).withColumn("name", F.regexp_replace("name", r"(?i)\.(com|net)/[^.]*$", ".page"))
    return intake.admission(ups, max_mb=8192 / 1024 / 1024, allowed=(".page",), magic="<!DOCTYPE").select("page_id", "reject_code")


@query(
    "src_volume_guard",
    f"""SELECT page_id, CASE WHEN total_bytes > 314572800 OR total_bytes / greatest(packed_bytes, 1) > 120 THEN 'file_too_large_uncompressed' WHEN pages > 5 THEN 'too_many_pages' END AS reject_code FROM ({UPLOAD})""",
)
def src_volume(spark, d):
    ups = uploads(spark, d).withColumn("name", F.lit("page.docx")).withColumn("head", F.lit("PK\u0003\u0004"))
    return intake.admission(ups, max_pages=5).select("page_id", "reject_code")


@query("src_text_blocks", "SELECT doc_id, i AS para_idx, trim(line) AS text FROM lines WHERE trim(line) <> ''".replace("FROM lines", "FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents)"))
def src_text_blocks(spark, d):
    return intake.block_rows(intake.text_blocks(docs(spark, d))).select("doc_id", "para_idx", "text")


HTML = r"""SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>|<!--.*?-->', '', 'g'), '(?i)<h([1-6])[^>]*>', chr(10) || chr(1) || '\1', 'g'), '(?i)</?(?:p|div|li|ul|ol|tr|table|br|article|section|nav|footer|header|h[1-6])\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS ls FROM (SELECT page_id, url, regexp_replace(html, '(?is)<head\b.*?</head>', '', 'g') AS html FROM pages)"""
HROWS = f"""SELECT page_id, url, k AS para_idx, CASE WHEN starts_with(l, chr(1)) THEN 'Heading ' || l[2] ELSE 'Normal' END AS style, trim(CASE WHEN starts_with(l, chr(1)) THEN substr(l, 3) ELSE l END) AS text FROM (SELECT page_id, url, unnest(ls) AS l, unnest(range(len(ls))) AS k FROM ({HTML}))"""


@query("src_html_blocks", f"SELECT page_id AS doc_id, para_idx, style, text FROM ({HROWS}) WHERE text <> ''")
def src_html_blocks(spark, d):
    return intake.block_rows(intake.html_blocks(spread(read(spark, d, "pages"))))


HREASON = f"""SELECT *, CASE WHEN starts_with(style, 'Heading') THEN 'style' WHEN contains(text, ' | ') OR starts_with(text, '![') OR length(text) > {P.HEADING_MAX} OR {rx('text', P.CAPTION_START)} THEN NULL
   WHEN regexp_matches(text, {q(P.NUMBERING)}) THEN 'numbering' WHEN regexp_matches(text, {q(P.TERMINAL)}) THEN NULL WHEN regexp_matches(lower(text), {q('^(?:' + '|'.join(P.SECTION_KEYWORDS) + ')')}) THEN 'keyword' END AS reason,
   regexp_extract(text, {q(P.NUMBERING)}, 1) AS depth FROM ({HROWS}) WHERE text <> ''"""


@query(
    "str_html_sections",
    f"""SELECT page_id AS doc_id, para_idx, text AS title, CASE WHEN reason = 'style' THEN CAST(style[-1] AS INTEGER) WHEN depth <> '' THEN least(len(string_split(depth, '.')), 4) ELSE 1 END AS level,
     CASE WHEN reason = 'style' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS confidence, reason <> 'style' AS needs_review FROM ({HREASON}) WHERE reason IS NOT NULL""",
)
def str_html_sections(spark, d):
    return structure.sections(structure.frame(intake.html_blocks(spread(read(spark, d, "pages")))))


@query("str_sentences", sql("SELECT doc_id, para_idx, sent_idx, text FROM r_sents"))
def str_sentences(spark, d):
    return structure.sentences(raw_frame(spark, d)).select("doc_id", "para_idx", "sent_idx", "text")


@query("str_sentences_overlay", sql("SELECT doc_id, para_idx, sent_idx, text FROM sents"))
def str_sentences_overlay(spark, d):
    return structure.sentences(overlay_frame(spark, d)).select("doc_id", "para_idx", "sent_idx", "text")


@query(
    "str_sentence_offsets",
    sql("""SELECT s.doc_id, s.para_idx, count(*) AS n, max(n_sent) AS n_sent, bool_and(fits) AS offsets_fit FROM (
      SELECT doc_id, para_idx, sent_idx, count(*) OVER (PARTITION BY doc_id, para_idx) AS n_sent, true AS fits FROM r_sents) s GROUP BY s.doc_id, s.para_idx"""),
)
def str_sentence_offsets(spark, d):
    """Each span, cut out of the paragraph by its offsets, is the sentence itself, and spans do not overlap."""
    p = structure.paragraphs(raw_frame(spark, d)).select("doc_id", "para_idx", "text", sentence_spans(F.col("text")).alias("s"))
    ok = F.forall("s", lambda x: F.trim(F.substr("text", x["char_start"] + 1, x["char_end"] - x["char_start"])) == x["text"]) & F.forall(
        F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i)["char_start"] >= F.get("s", i - 1)["char_end"])
    )
    n = F.size("s").cast("bigint")
    return p.filter(F.size("s") > 0).select("doc_id", "para_idx", n.alias("n"), n.alias("n_sent"), ok.alias("offsets_fit"))


@query("str_headings", sql("SELECT doc_id, para_idx, is_heading, reason, level, style FROM paras"))
def str_headings(spark, d):
    return structure.paragraphs(overlay_frame(spark, d)).select("doc_id", "para_idx", "is_heading", "reason", "level", "style")


@query("str_sections", sql("SELECT doc_id, para_idx, s AS title, level, CASE WHEN reason = 'style' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS confidence, reason <> 'style' AS needs_review FROM paras WHERE is_heading"))
def str_sections(spark, d):
    return structure.sections(overlay_frame(spark, d))


@query(
    "str_section_extent",
    sql("""SELECT doc_id, para_idx, section_idx, section_end FROM (SELECT *, max(CASE WHEN is_heading THEN para_idx END) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS UNBOUNDED PRECEDING) AS section_idx,
      min(CASE WHEN is_heading THEN para_idx END) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS section_end FROM paras) WHERE NOT is_heading"""),
)
def str_section_extent(spark, d):
    return structure.section_extent(overlay_frame(spark, d))


SCRIPTS = "length(regexp_replace(text, '[^{}]', '', 'g'))"


@query("str_language", f"SELECT doc_id, lang, CASE WHEN {SCRIPTS.format('A-Za-z')} > {SCRIPTS.format('一-鿿')} THEN 'en' ELSE 'zh' END AS detected FROM documents")
def str_language(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang", language(F.col("text")).alias("detected"))


@query("str_language_overlay", sql("SELECT d.doc_id, CASE WHEN length(regexp_replace(coalesce(body, ''), '[^A-Za-z]', '', 'g')) > length(regexp_replace(coalesce(body, ''), '[^一-鿿]', '', 'g')) THEN 'en' ELSE 'zh' END AS language FROM docs d LEFT JOIN ptext p USING (doc_id)"))
def str_language_overlay(spark, d):
    return structure.counters(overlay_frame(spark, d)).select("doc_id", "language")


GRID = """SELECT doc_id, tbl_idx, row_idx, unnest(range(n_cols)) AS col_idx, list_resize(cells, n_cols) AS cs FROM {p}trow"""


def grid_rows(t):
    r = t.select("doc_id", "tbl_idx", F.posexplode("rows").alias("row_idx", "r"))
    return r.select("doc_id", "tbl_idx", "row_idx", F.posexplode("r").alias("col_idx", "cell"))


@query("str_table_grid", sql(f"SELECT doc_id, tbl_idx, row_idx, col_idx, cs[col_idx + 1] AS cell FROM ({GRID.format(p='r_')})"))
def str_table_grid(spark, d):
    return grid_rows(structure.tables(raw_frame(spark, d)))


HDR = """CASE WHEN t.n_rows >= 2 AND len(list_filter(f.cells, lambda c: c <> '')) > 0 AND len(list_filter(f.cells, lambda c: regexp_matches(c, '\\d'))) = 0 THEN 1 ELSE 0 END"""


@query("str_header_rows", sql(f"SELECT t.doc_id, t.tbl_idx, t.n_rows, t.n_cols, {HDR} AS header_rows FROM r_tbl t JOIN r_trow f ON f.doc_id = t.doc_id AND f.tbl_idx = t.tbl_idx AND f.row_idx = 0"))
def str_header_rows(spark, d):
    return structure.tables(raw_frame(spark, d)).select("doc_id", "tbl_idx", "n_rows", "n_cols", "header_rows")


@query("str_table_captions", sql(f"SELECT doc_id, tbl_idx, anchor, CASE WHEN {rx('prev', P.TABLE_CAPTION_START)} THEN prev ELSE '' END AS caption FROM tbl"))
def str_table_captions(spark, d):
    return structure.tables(overlay_frame(spark, d)).select("doc_id", "tbl_idx", "anchor", "caption")


IMAGE_CAPTIONS = f"""SELECT i.doc_id, i.img_idx, i.path, arg_min(p.para_idx, CASE WHEN p.para_idx > i.idx THEN p.para_idx - i.idx ELSE 100 + i.idx - p.para_idx END) AS caption_para, coalesce(arg_min(p.s, CASE WHEN p.para_idx > i.idx THEN p.para_idx - i.idx ELSE 100 + i.idx - p.para_idx END), '') AS caption
      FROM img i LEFT JOIN paras p ON p.doc_id = i.doc_id AND p.para_idx BETWEEN i.idx - {P.CAPTION_LOOKBEHIND} AND i.idx + {P.CAPTION_LOOKAHEAD} AND p.para_idx <> i.idx AND {rx('p.s', P.CAPTION_START)} GROUP BY ALL"""


@query("str_image_captions", sql(IMAGE_CAPTIONS))
def str_image_captions(spark, d):
    return structure.images(overlay_frame(spark, d)).select("doc_id", "img_idx", "path", "caption_para", "caption")


@query(
    "str_nearest_paragraph",
    sql("""SELECT k.doc_id, k.idx, coalesce(max(CASE WHEN p.para_idx <= k.idx THEN p.para_idx END), min(p.para_idx), 0) AS nearest FROM r_k k LEFT JOIN r_paras p ON p.doc_id = k.doc_id WHERE k.kind <> 'para' GROUP BY k.doc_id, k.idx"""),
)
def str_nearest_paragraph(spark, d):
    """Blank and table blocks mapped to the paragraph they belong to."""
    b = intake.text_blocks(docs(spark, d)).withColumn("blocks", F.transform("blocks", lambda x: F.struct(x["idx"].alias("idx"), structure.block_kind(x["text"]).alias("kind"))))
    paras = F.transform(F.filter("blocks", lambda x: x["kind"] == "para"), lambda x: F.struct(x["idx"].alias("para_idx")))
    b = b.withColumn("paras", paras)
    other = F.transform(
        F.filter("blocks", lambda x: x["kind"] != "para"), lambda x: F.struct(x["idx"].alias("idx"), structure.nearest_paragraph(F.col("paras"), x["idx"]).alias("nearest"))
    )
    return intake.unnest(b, other, "doc_id")


@query("str_citations", sql("SELECT doc_id, cite_idx, para_idx, marker, array_to_string(numbers, ',') AS numbers FROM cites"))
def str_citations(spark, d):
    c = structure.citation_ranges(overlay_frame(spark, d))
    return c.select("doc_id", "cite_idx", "para_idx", "marker", structure.spelled(F.col("numbers"), ",").alias("numbers"))


@query("str_citation_filter", sql(f"SELECT doc_id, para_idx, count(*) AS kept FROM marks WHERE NOT starts_with(marker, '[') GROUP BY doc_id, para_idx"))
def str_citation_filter(spark, d):
    """Superscript citations kept after the mathematics filter, per paragraph."""
    p = structure.paragraphs(overlay_frame(spark, d))
    kept = F.size(F.filter(structure.citation_tokens(F.col("text")), lambda m: ~m.startswith("[")))
    return p.select("doc_id", "para_idx", kept.cast("bigint").alias("kept")).filter("kept > 0")


@query("str_reference_headings", sql(f"SELECT doc_id, para_idx, s AS title FROM paras WHERE is_heading AND (lower({_BASE}) IN ('references','bibliography','参考文献','文献','references and notes') OR lower({_BARE}) IN ('references','bibliography','参考文献','文献','references and notes'))"))
def str_reference_headings(spark, d):
    s = structure.sections(overlay_frame(spark, d))
    return s.filter(structure.is_reference_heading(F.col("title"))).select("doc_id", "para_idx", "title")


@query("str_references", sql("SELECT doc_id, number, text, para_idx FROM refs"))
def str_references(spark, d):
    return structure.references(overlay_frame(spark, d))


@query("str_unresolved", sql("SELECT doc_id, cite_idx, para_idx, marker, nums AS unresolved FROM dangling"))
def str_unresolved(spark, d):
    c = structure.citation_ranges(overlay_frame(spark, d)).filter(F.size("unresolved") > 0)
    return c.select("doc_id", "cite_idx", "para_idx", "marker", F.concat(F.lit("["), structure.spelled(F.col("unresolved")), F.lit("]")).alias("unresolved"))


@query(
    "str_counters",
    sql("""SELECT d.doc_id, coalesce(p.n, 0) AS paragraph_count, coalesce(p.h, 0) AS section_count, coalesce(p.hh, 0) AS heuristic_headings, coalesce(t.n, 0) AS table_count, coalesce(t.r, 0) AS table_rows, coalesce(i.n, 0) AS image_count, coalesce(r.n, 0) AS reference_count, coalesce(c.n, 0) AS citation_count,
       concat_ws(',', CASE WHEN coalesce(p.h, 0) = 0 THEN 'no_sections' END, CASE WHEN coalesce(p.hh, 0) > 0 THEN 'heuristic_headings' END, CASE WHEN coalesce(i.n, 0) > 0 THEN 'images_not_read' END, CASE WHEN coalesce(t.n, 0) > 0 THEN 'tables_moved' END, CASE WHEN coalesce(r.n, 0) = 0 THEN 'no_references' END) AS warnings
     FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE is_heading) AS h, count(*) FILTER (WHERE is_heading AND reason <> 'style') AS hh FROM paras GROUP BY 1) p USING (doc_id)
     LEFT JOIN (SELECT doc_id, count(*) AS n, CAST(sum(n_rows) AS BIGINT) AS r FROM tbl GROUP BY 1) t USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM img GROUP BY 1) i USING (doc_id)
     LEFT JOIN (SELECT doc_id, count(*) AS n FROM refs GROUP BY 1) r USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM cites GROUP BY 1) c USING (doc_id)"""),
)
def str_counters(spark, d):
    return structure.counters(overlay_frame(spark, d)).drop("language").withColumn("warnings", F.array_join("warnings", ","))


@query("str_units", sql("SELECT doc_id, pos, para_idx, text, kind FROM r_units"))
def str_units(spark, d):
    return structure.units(raw_frame(spark, d)).select("doc_id", "pos", "para_idx", "text", "kind")


@query(
    "str_labelled_blocks",
    sql(f"""SELECT doc_id, para_idx, 0 AS kind, -1 AS tbl_idx, '[P' || para_idx || '] ' || s AS line FROM paras
     UNION ALL SELECT r.doc_id, r.anchor, 1, r.tbl_idx, '[P' || r.anchor || '] ' || CASE WHEN {rx('any_value(t.prev)', P.TABLE_CAPTION_START)} THEN '[表] ' || any_value(t.prev) || chr(10) ELSE '[表]' || chr(10) END
       || string_agg(array_to_string(list_transform(list_resize(r.cells, r.n_cols), lambda c: coalesce(c, '')), ' | '), chr(10) ORDER BY r.row_idx)
     FROM trow r JOIN tbl t USING (doc_id, tbl_idx) WHERE EXISTS (SELECT 1 FROM paras p WHERE p.doc_id = r.doc_id AND p.para_idx = r.anchor) GROUP BY r.doc_id, r.anchor, r.tbl_idx"""),
)
def str_labelled_blocks(spark, d):
    return structure.labelled_blocks(overlay_frame(spark, d))


# --- elements -----------------------------------------------------------------------

@query("elm_elements", sql("SELECT doc_id, elem_seq, type, value, para_idx, sent_idx, confidence::DOUBLE AS confidence, in_table FROM elements"))
def elm_elements(spark, d):
    return elements.element_rows(tagged(spark, d))


CORPUS_PACK = {
    "email": [r"[a-z0-9._%+]+@[a-z0-9.]+\.[a-z]{2,}"],
    "ip": [r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"],
    "phone": [r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"],
    "token": [r"token\s*=\s*\""],
    "licence": [r"licen[sc]ed? under|public domain|cc[ -]by"],
}


@query(
    "elm_corpus_pack",
    sql("SELECT doc_id, para_idx, sent_idx, unnest(list_filter([" + ", ".join(f"CASE WHEN {rx('text', p[0])} THEN '{t}' END" for t, p in CORPUS_PACK.items()) + "], lambda x: x IS NOT NULL)) AS type FROM r_sents"),
)
def elm_corpus_pack(spark, d):
    """The same tagging operator with another pattern pack, on the raw corpus."""
    s = structure.sentences(raw_frame(spark, d))
    return s.select("doc_id", "para_idx", "sent_idx", F.explode_outer(elements.tag(F.col("text"), CORPUS_PACK)).alias("type")).filter(F.col("type").isNotNull())


@query("elm_structural", sql("SELECT doc_id, type, value, para_idx, confidence::DOUBLE AS confidence FROM elements WHERE type IN ('citation', 'reference_list')"))
def elm_structural(spark, d):
    return elements.element_rows(tagged(spark, d)).filter(F.col("type").isin("citation", "reference_list")).select("doc_id", "type", "value", "para_idx", "confidence")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE type = '{t}') AS n_{t}" for t in P.ELEMENT_TYPES)


@query("elm_presence", sql(f"SELECT doc_id, {_COUNTS} FROM elements GROUP BY doc_id"))
def elm_presence(spark, d):
    rows = elements.element_rows(tagged(spark, d))
    return rows.groupBy("doc_id").agg(*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in P.ELEMENT_TYPES])


@query("elm_first_anchor", sql("SELECT doc_id, coalesce(data_split, metric, novel_module, study_design) AS split_anchor, coalesce(stat_test, p_value, metric) AS ci_anchor, coalesce(sample_size, study_design) AS size_anchor FROM docs LEFT JOIN firsts USING (doc_id)"))
def elm_first_anchor(spark, d):
    f = elements.with_features(tagged(spark, d))
    a = elements.anchor_for
    return f.select(
        "doc_id",
        a("data_split", "metric", "novel_module", "study_design").alias("split_anchor"),
        a("stat_test", "p_value", "metric").alias("ci_anchor"),
        a("sample_size", "study_design").alias("size_anchor"),
    )


@query(
    "elm_item_hints",
    sql("""SELECT d.doc_id, i.item_id, coalesce(string_agg(h.value, ' ' ORDER BY h.rpos, h.elem_seq), '') AS hint FROM docs d CROSS JOIN items i LEFT JOIN (
       SELECT e.doc_id, r.item_id, r.rpos, e.elem_seq, e.value, row_number() OVER (PARTITION BY e.doc_id, r.item_id, r.rpos ORDER BY e.elem_seq) AS rn FROM elements e JOIN requires r USING (type)) h ON h.doc_id = d.doc_id AND h.item_id = i.item_id AND h.rn <= 2 GROUP BY d.doc_id, i.item_id"""),
)
def elm_item_hints(spark, d):
    from paperlens.operators.retrieval import hints

    return intake.unnest(hints(tagged(spark, d)), "hints", "doc_id")


@query("elm_required_types", sql("SELECT e.doc_id, r.item_id, r.type, count(*) AS n FROM elements e JOIN requires r USING (type) GROUP BY ALL"))
def elm_required_types(spark, d):
    from paperlens.sources.checklists import default_checklist, required_types

    return elements.element_rows(tagged(spark, d)).join(required_types(default_checklist(spark)), "type").groupBy("doc_id", "item_id", "type").agg(F.count("*").alias("n"))


# --- anchors and classification -------------------------------------------------------

@query("anc_section_body", sql("SELECT doc_id, " + ", ".join(f"a_{n}" for n in P.SECTION_ANCHORS) + " FROM docs LEFT JOIN sec USING (doc_id)"))
def anc_section_body(spark, d):
    return overlay_frame(spark, d).select("doc_id", *[elements.section_anchor(n).alias(f"a_{n}") for n in P.SECTION_ANCHORS])


@query("anc_first_last_body", sql("SELECT doc_id, base_at, p_at FROM docs LEFT JOIN pflags USING (doc_id)"))
def anc_first_last_body(spark, d):
    return overlay_frame(spark, d).select("doc_id", elements.first_body_anchor("baseline_body").alias("base_at"), elements.last_body_anchor("p_body").alias("p_at"))


@query("anc_matching_paragraphs", sql("SELECT doc_id, multi_at, model_at, coalesce(last_para, 0) AS last_para FROM docs LEFT JOIN pflags USING (doc_id)"))
def anc_matching_paragraphs(spark, d):
    return overlay_frame(spark, d).select(
        "doc_id",
        elements.last_para(lambda p: signal(p["text"], "multi_comparison")).alias("multi_at"),
        elements.last_para(lambda p: signal(p["text"], "model_word")).alias("model_at"),
        F.coalesce(F.try_element_at("paras", F.lit(-1))["para_idx"], F.lit(0)).alias("last_para"),
    )


TYPE_COLS = ["doc_id", "review_hits", "strong_hits", "empirical_hits", "title_strong", "title_weak", "paper_type"]


@query("cls_paper_type", sql("SELECT " + ", ".join(TYPE_COLS) + " FROM ptype"))
def cls_paper_type(spark, d):
    return elements.paper_type(overlay_frame(spark, d)).select(*TYPE_COLS)


@query("cls_applicability", sql("SELECT doc_id, item_id, severity_default FROM applic"))
def cls_applicability(spark, d):
    t = elements.paper_type(overlay_frame(spark, d)).select("doc_id", "paper_type")
    items = F.array(*[F.struct(F.lit(r[0]).alias("item_id"), F.lit(r[2]).alias("severity_default")) for r in P.CHECKLIST])
    kept = F.filter(items, lambda i: elements.applicable(i["item_id"], F.col("paper_type")))
    return intake.unnest(t, kept, "doc_id")


@query("cls_template_filter", sql("SELECT r.item_id, count(*) AS n_findings FROM rulef r JOIN items i USING (item_id) WHERE i.item_id IN ('R-01','R-02','R-07','R-08','R-09','R-11','R-14','R-15','R-REF-01','R-REF-02') GROUP BY r.item_id"))
def cls_template_filter(spark, d):
    """Findings of the items that belong to the 'quant' template."""
    from paperlens.sources.checklists import default_checklist, for_template

    return rule_rows(spark, d).join(for_template(default_checklist(spark), "quant"), "item_id", "left_semi").groupBy("item_id").agg(F.count("*").alias("n_findings"))


@query("cls_context", sql("SELECT doc_id, trains AS trains_model, coalesce(ai, false) AS ai_empirical, coalesce(s_ml_evidence, false) AS model_evidence, coalesce(has_intro, false) AS has_intro FROM feat"))
def cls_context(spark, d):
    f = elements.with_features(tagged(spark, d))
    return f.select("doc_id", "trains_model", "ai_empirical", F.col("sig.ml_evidence").alias("model_evidence"), "has_intro")


# --- rules ------------------------------------------------------------------------------

RULE_COLS = ["doc_id", "seq", "item_id", "code", "verdict", "severity", "certainty", "para_idx", "arg0", "arg1"]


@query("rul_run", sql("SELECT " + ", ".join("r." + c for c in RULE_COLS) + " FROM rulef r"))
def rul_run(spark, d):
    return rule_rows(spark, d).select(*RULE_COLS)


@query("rul_severity_override", sql("SELECT r.item_id, CASE WHEN r.verdict = 'problem' THEN i.severity_default ELSE r.severity END AS severity, r.verdict, count(*) AS n FROM rulef r JOIN items i USING (item_id) GROUP BY ALL"))
def rul_severity_override(spark, d):
    from paperlens.operators.rules import finding_rows
    from paperlens.sources.checklists import default_checklist

    from paperlens.catalog.common import ruled

    return finding_rows(ruled(spark, d), default_checklist(spark)).groupBy("item_id", "severity", "verdict").agg(F.count("*").alias("n"))


@query("rul_certainty", sql("SELECT item_id, certainty, count(*) AS n FROM rulef GROUP BY ALL"))
def rul_certainty(spark, d):
    return rule_rows(spark, d).groupBy("item_id", "certainty").agg(F.count("*").alias("n"))


def _rule_query(item):
    name = "rul_" + item.lower().replace("-", "_")
    final = f"SELECT doc_id, code, verdict, severity, certainty, para_idx, arg0, arg1 FROM rulef WHERE item_id = '{item}'"
    query(name, sql(final))(lambda spark, d: rule_rows(spark, d).filter(F.col("item_id") == item).select("doc_id", "code", "verdict", "severity", "certainty", "para_idx", "arg0", "arg1"))


for _item in P.ITEM_IDS:
    _rule_query(_item)


# --- numeric checks ---------------------------------------------------------------------

def _unit_check(spark, d, fn, name):
    u = structure.units(overlay_frame(spark, d))
    return u.select("doc_id", "pos", "para_idx", fn(F.col("text")).alias(name)).filter(F.col(name).isNotNull())


@query("num_ratio", sql("SELECT doc_id, pos, para_idx, total, parts FROM ratios"))
def num_ratio(spark, d):
    found = _unit_check(spark, d, checks.bad_ratio, "found")
    return found.select("doc_id", "pos", "para_idx", F.col("found.total").cast("bigint").alias("total"), "found.parts")


@query("num_percent", sql("SELECT doc_id, pos, para_idx, round(total, 4) AS total, parts FROM percents"))
def num_percent(spark, d):
    return _unit_check(spark, d, checks.bad_percent, "found").select("doc_id", "pos", "para_idx", "found.total", "found.parts")


@query("num_interval", sql("SELECT doc_id, pos, para_idx, txt FROM intervals"))
def num_interval(spark, d):
    return _unit_check(spark, d, checks.bad_interval, "txt")


@query("num_all", sql("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, c) - 1 AS seq, item_id, code, para_idx, arg0, parts, quote FROM numeric"))
def num_all(spark, d):
    return checks.check_rows(checks.with_numeric(overlay_frame(spark, d)), "numeric").drop("arg1")


# --- figure checks ------------------------------------------------------------------------

@query("fig_mentions", sql("SELECT d.doc_id, coalesce(f.figure_mentions, 0) AS figure_mentions FROM docs d LEFT JOIN figcount f USING (doc_id)"))
def fig_mentions(spark, d):
    return checks.with_captions(overlay_frame(spark, d)).select("doc_id", F.col("figure_mentions").cast("bigint").alias("figure_mentions"))


@query("fig_captions", sql("SELECT doc_id, kind, number, para_idx FROM caps"))
def fig_captions(spark, d):
    return intake.unnest(checks.with_captions(overlay_frame(spark, d)), "captions", "doc_id").drop("samples")


@query("fig_references", sql("SELECT doc_id, kind, number, para_idx FROM ments WHERE number IS NOT NULL"))
def fig_references(spark, d):
    return intake.unnest(checks.with_captions(overlay_frame(spark, d)), "mentions", "doc_id").drop("samples")


NUMERAL = "(CASE WHEN item_id % 100 < 10 THEN '' WHEN item_id % 100 < 20 THEN '十' ELSE substr('一二三四五六七八九', CAST(item_id % 100 // 10 AS INTEGER), 1) || '十' END || CASE WHEN item_id % 10 = 0 THEN '' ELSE substr('一二三四五六七八九', CAST(item_id % 10 AS INTEGER), 1) END)"


@query("fig_key_numerals", f"SELECT item_id, {zh('numeral')} AS number FROM (SELECT item_id, {NUMERAL} AS numeral FROM benchmark)")
def fig_key_numerals(spark, d):
    """Chinese numerals written from the item number, read back by the key normaliser."""
    n = F.col("item_id") % 100
    digit = lambda x: F.substr(F.lit("一二三四五六七八九"), x.cast("int"), F.lit(1))
    tens = F.when(n < 10, "").when(n < 20, "十").otherwise(F.concat(digit(F.floor(n / 10)), F.lit("十")))
    numeral = F.concat(tens, F.when(n % 10 == 0, "").otherwise(digit(n % 10)))
    return read(spark, d, "benchmark").select("item_id", zh_number(numeral).alias("number"))


@query("fig_samples", sql("SELECT doc_id, kind, number, unit, value FROM csamp"))
def fig_samples(spark, d):
    c = intake.unnest(checks.with_captions(overlay_frame(spark, d)), "captions", "doc_id")
    return intake.unnest(c, "samples", "doc_id", "kind", "number")


def _fig(code):
    name = {"CAPTION_MISSING": "fig_check_captions", "MENTION_UNCAPTIONED": "fig_check_references", "SAMPLE_CONFLICT": "fig_check_samples"}[code]
    final = f"SELECT doc_id, para_idx, arg0, arg1 FROM figure WHERE code = '{code}'"

    @query(name, sql(final))
    def run(spark, d):
        c = checks.with_figure_checks(checks.with_captions(overlay_frame(spark, d)))
        return checks.check_rows(c, "figure").filter(F.col("code") == code).select("doc_id", "para_idx", "arg0", "arg1")


for _code in ("CAPTION_MISSING", "MENTION_UNCAPTIONED", "SAMPLE_CONFLICT"):
    _fig(_code)
