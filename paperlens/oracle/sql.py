"""Independent ANSI/DuckDB SQL for the registered queries, as named common table expressions.

The SQL works on flat rows with joins and window functions, where the engine works on arrays, so
agreement is a real check.  Only the fixed-value packs are shared.
"""

import re

from paperlens import packs as P

WORD = r"[^\p{L}\p{N}_]"


def q(text):
    return "'" + text.replace("'", "''") + "'"


def re2(pattern):
    """RE2 has no Unicode word boundary: a boundary becomes a neighbouring non-word character."""
    out, i = [], 0
    for m in re.finditer(r"\\b", pattern):
        out.append(pattern[i : m.start()])
        before = pattern[: m.start()]
        out.append(f"(?:^|{WORD})" if before == "" or before[-1] in "(|" else f"(?:$|{WORD})")
        i = m.end()
    out.append(pattern[i:])
    return "".join(out)


def rx(expr, pattern, ignore_case=True):
    return f"regexp_matches({expr}, {q(('(?i)' if ignore_case else '') + re2(pattern))})"


def sig(expr, name):
    p, ic = P.SIGNALS[name]
    return rx(expr, p, ic)


def any_of(ps):
    return "|".join(f"(?:{p})" for p in ps)


def values(rows):
    return "(VALUES " + ", ".join("(" + ", ".join(q(c) if isinstance(c, str) else ("NULL" if c is None else str(c)) for c in r) + ")" for r in rows) + ")"


def inlist(xs):
    return "(" + ", ".join(q(x) for x in xs) + ")"


SPECIAL = "，。；：、"
CTE = {}

CTE["bank"] = f"SELECT * FROM {values([(i, t) for i, t in enumerate(P.BANK)])} t(k, sentence)"
CTE["heads"] = f"SELECT * FROM {values([(i, t, s) for i, (t, s) in enumerate(P.HEADINGS)])} t(k, title, style)"
CTE["lines"] = """SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents"""
CTE["blocks"] = f"""
 SELECT doc_id, source, i*{P.BLOCKS_PER_LINE} AS idx, line AS text, 'Normal' AS style FROM lines
 UNION ALL
 SELECT l.doc_id, l.source, l.i*{P.BLOCKS_PER_LINE}+1, h.title, h.style FROM lines l JOIN heads h ON h.k = (l.doc_id + l.i // {P.HEADING_EVERY}) % {len(P.HEADINGS)} WHERE l.i % {P.HEADING_EVERY} = 0
 UNION ALL
 SELECT l.doc_id, l.source, l.i*{P.BLOCKS_PER_LINE}+1, b.sentence, 'Normal' FROM lines l JOIN bank b ON b.k = (l.doc_id*{P.BANK_STRIDE_DOC} + l.i*{P.BANK_STRIDE_LINE}) % {len(P.BANK)} WHERE l.i % {P.HEADING_EVERY} <> 0
 UNION ALL
 SELECT doc_id, source, i*{P.BLOCKS_PER_LINE}+2, CASE WHEN i % {P.HEADING_EVERY} <> 0 AND (doc_id*{P.BANK_STRIDE_DOC} + i*{P.BANK_STRIDE_LINE}) % {len(P.BANK)} = {P.TABLE_CAPTION_PICK} THEN {q(P.TABLE_ROW)} ELSE '' END, 'Normal' FROM lines"""
CTE["raw_blocks"] = "SELECT doc_id, source, i AS idx, line AS text, 'Normal' AS style FROM lines"

KIND = r"""CASE WHEN trim(text) = '' THEN 'blank' WHEN regexp_matches(text, '^\s*!\[') THEN 'image' WHEN contains(text, ' | ') THEN 'table' ELSE 'para' END"""
NUMBERED = f"regexp_matches(s, {q(P.NUMBERING)})"
DEPTH = f"regexp_extract(s, {q(P.NUMBERING)}, 1)"


def structure(prefix, blocks):
    """CTEs of one corpus: prefix + k (kinds), paras, tbl, trow, img."""
    n = prefix
    CTE[n + "k"] = f"SELECT *, {KIND} AS kind FROM {blocks}"
    CTE[n + "p0"] = f"SELECT doc_id, source, idx AS para_idx, text, trim(text) AS s, style, (style = 'Title' OR starts_with(style, 'Heading')) AS styled FROM {n}k WHERE kind = 'para'"
    CTE[n + "paras"] = f"""
 SELECT *, reason IS NOT NULL AS is_heading,
   CASE WHEN reason = 'style' THEN CASE WHEN style0 = 'Title' THEN 0 ELSE coalesce(try_cast(regexp_extract(style0, '(\\d+)$', 1) AS INTEGER), 1) END
        WHEN reason IS NULL THEN NULL WHEN {DEPTH} <> '' THEN least(len(string_split({DEPTH}, '.')), 4) ELSE 1 END AS level,
   CASE WHEN reason IN ('numbering','keyword') AND style0 = 'Normal' THEN 'HeuristicHeading' ELSE style0 END AS style,
   coalesce(try_cast(regexp_extract(style0, '^Heading (\\d+)$', 1) AS INTEGER), 0) AS outline
 FROM (SELECT doc_id, source, para_idx, text, s, style AS style0,
   CASE WHEN styled THEN 'style'
        WHEN length(s) > {P.HEADING_MAX} OR {rx('s', P.CAPTION_START)} THEN NULL
        WHEN {NUMBERED} THEN 'numbering'
        WHEN regexp_matches(s, {q(P.TERMINAL)}) THEN NULL
        WHEN regexp_matches(lower(s), {q('^(?:' + '|'.join(P.SECTION_KEYWORDS) + ')')}) THEN 'keyword' END AS reason FROM {n}p0)"""
    CTE[n + "tl"] = f"SELECT doc_id, idx, text, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM {n}k WHERE kind = 'table'"
    CTE[n + "t0"] = f"SELECT doc_id, island, min(idx) AS first_idx, count(*) AS n_rows, max(len(string_split(trim(text), ' | '))) AS n_cols, row_number() OVER (PARTITION BY doc_id ORDER BY min(idx)) - 1 AS tbl_idx FROM {n}tl GROUP BY doc_id, island"
    CTE[n + "tbl"] = f"""
 SELECT t.doc_id, t.island, t.tbl_idx, t.n_rows, t.n_cols, coalesce(max(p.para_idx), 0) AS anchor, coalesce(arg_max(p.s, p.para_idx), '') AS prev
 FROM {n}t0 t LEFT JOIN {n}paras p ON p.doc_id = t.doc_id AND p.para_idx < t.first_idx GROUP BY ALL"""
    CTE[n + "trow"] = f"""
 SELECT l.doc_id, t.tbl_idx, t.anchor, t.n_cols, l.idx, row_number() OVER (PARTITION BY l.doc_id, t.tbl_idx ORDER BY l.idx) - 1 AS row_idx,
   list_transform(string_split(trim(l.text), ' | '), lambda c: trim(c)) AS cells FROM {n}tl l JOIN {n}tbl t USING (doc_id, island)"""
    CTE[n + "trt"] = f"SELECT doc_id, tbl_idx, row_idx, idx, anchor AS para_idx, array_to_string(list_filter(cells, lambda c: c <> ''), ' | ') AS text FROM {n}trow"
    CTE[n + "units"] = f"""
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, idx) - 1 AS pos, para_idx, text, is_heading, kind FROM (
   SELECT doc_id, 0 AS part, para_idx AS idx, para_idx, text, is_heading, 'paragraph' AS kind FROM {n}paras
   UNION ALL SELECT doc_id, 1, idx, para_idx, text, false, 'table' FROM {n}trt WHERE text <> '')"""


structure("", "blocks")
structure("r_", "raw_blocks")
CTE["img"] = f"SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS img_idx, regexp_extract(text, '\\]\\(([^)\\s]+)', 1) AS path FROM k WHERE kind = 'image'"

# --- references and citations
_TAIL = q(P.REFERENCE_TAIL)
_BASE = f"regexp_replace(regexp_replace(s, {q(P.REFERENCE_PREFIX)}, ''), {_TAIL}, '')"
_BARE = f"regexp_replace(trim(regexp_replace({_BASE}, {q(P.REFERENCE_INLINE)}, '', 'g')), {_TAIL}, '')"
_ITEM = P.REFERENCE_ITEM.replace(r"(\d+)(?=\s)", r"(\d+)\s")
CTE["refhead"] = f"SELECT doc_id, min(para_idx) AS start FROM paras WHERE is_heading AND (lower({_BASE}) IN {inlist(P.REFERENCE_TITLES)} OR lower({_BARE}) IN {inlist(P.REFERENCE_TITLES)}) GROUP BY doc_id"
CTE["refent"] = f"""
 SELECT * FROM (SELECT p.doc_id, p.para_idx, p.s AS text, CAST(coalesce(nullif(regexp_extract(p.text, {q(_ITEM)}, 1), ''), nullif(regexp_extract(p.text, {q(_ITEM)}, 2), ''), nullif(regexp_extract(p.text, {q(_ITEM)}, 3), '')) AS BIGINT) AS number
 FROM paras p JOIN refhead h ON p.doc_id = h.doc_id AND p.para_idx > h.start) WHERE number IS NOT NULL"""
CTE["refs"] = "SELECT doc_id, number, arg_max(text, para_idx) AS text, max(para_idx) AS para_idx, min(para_idx) AS first_seen FROM refent GROUP BY doc_id, number"
_NEAR = P.MATH_NEIGHBOURS.replace("]", r"\]").replace("-", r"\-")
_MARK = rf"(?:{P.CITATION_BRACKET})|(?:^|[^\p{{L}}\p{{N}}{_NEAR}])[{P.SUPERSCRIPTS}]{{1,3}}(?:$|[^%{_NEAR}{P.SUPERSCRIPTS}])"
CTE["marks"] = f"""
 SELECT doc_id, para_idx, k, translate(CASE WHEN starts_with(m0, '[') THEN m0 ELSE regexp_extract(m0, '[{P.SUPERSCRIPTS}]+') END, '{P.SUPERSCRIPTS}', '{P.PLAIN_DIGITS}') AS marker
 FROM (SELECT doc_id, para_idx, unnest(ms) AS m0, unnest(range(len(ms))) AS k FROM (SELECT doc_id, para_idx, regexp_extract_all(regexp_replace(text, '^\\s*\\[\\s*\\d+\\s*\\]', ''), {q(_MARK)}) AS ms FROM paras))"""
CTE["cites"] = f"""
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, k) - 1 AS cite_idx, para_idx, marker, numbers FROM (
  SELECT *, flatten(list_transform(regexp_extract_all(marker, {q(P.RANGE_OR_NUMBER)}), lambda p:
   range(CAST(regexp_extract(p, '^(\\d+)', 1) AS BIGINT), CAST(regexp_extract(p, '(\\d+)$', 1) AS BIGINT) + 1))) AS numbers FROM marks) WHERE len(numbers) > 0"""
CTE["cnum"] = "SELECT doc_id, cite_idx, para_idx, marker, unnest(numbers) AS number, unnest(range(len(numbers))) AS k FROM cites"
CTE["unres"] = "SELECT c.* FROM cnum c ANTI JOIN refs r USING (doc_id, number)"
CTE["dangling"] = "SELECT doc_id, cite_idx, para_idx, marker, '[' || string_agg(CAST(number AS VARCHAR), ', ' ORDER BY k) || ']' AS nums FROM unres GROUP BY ALL"

# --- elements
_START = "[A-Z一-鿿“\"''(]"
_SPLIT1 = r"regexp_replace(text, '([。！？；])', '\1' || chr(1), 'g')"
_SPLIT2 = rf"regexp_replace({{0}}, '(^|[^0-9])([.?!])\s+({_START})', '\1\2' || chr(1) || '\3', 'g')"


def sentence_cte(src):
    m = _SPLIT2.format(_SPLIT2.format(_SPLIT1))
    return f"""SELECT doc_id, para_idx, row_number() OVER (PARTITION BY doc_id, para_idx ORDER BY k) - 1 AS sent_idx, trim(piece) AS text FROM (
   SELECT doc_id, para_idx, unnest(ps) AS piece, unnest(range(len(ps))) AS k FROM (SELECT doc_id, para_idx, string_split({m}, chr(1)) AS ps FROM {src})) WHERE trim(piece) <> ''"""


CTE["sents"] = sentence_cte("paras")
CTE["r_sents"] = sentence_cte("r_paras")
_TAGS = "[" + ", ".join(f"CASE WHEN {rx('text', any_of(ps))} THEN {i} END" for i, ps in enumerate(P.ELEMENT_PATTERNS.values())) + "]"
CTE["types"] = f"SELECT * FROM {values([(i, t) for i, t in enumerate(P.ELEMENT_TYPES)])} t(tno, type)"
CTE["ehits"] = f"""
 SELECT doc_id, part, idx, para_idx, sent_idx, text, tno FROM (SELECT *, unnest({_TAGS}) AS tno FROM (
   SELECT doc_id, 0 AS part, para_idx AS idx, para_idx, sent_idx, text FROM sents
   UNION ALL SELECT doc_id, 1, idx, para_idx, NULL, text FROM trt WHERE text <> '')) WHERE tno IS NOT NULL"""
CTE["elements"] = """
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, idx, sent_idx, tno) - 1 AS elem_seq, type, value, para_idx, sent_idx, confidence, in_table FROM (
  SELECT h.doc_id, h.part, h.idx, coalesce(h.sent_idx, 0) AS sent_ord, h.sent_idx, h.tno, t.type, left(trim(h.text), 160) AS value, h.para_idx, 0.8 AS confidence, h.part = 1 AS in_table FROM ehits h JOIN types t USING (tno)
  UNION ALL SELECT doc_id, -2, 0, 0, NULL, 0, 'citation', count(*) || ' 个引用角标', arg_min(para_idx, cite_idx), 1.0, false FROM cites GROUP BY doc_id
  UNION ALL SELECT doc_id, -1, 0, 0, NULL, 0, 'reference_list', count(*) || ' 条参考文献', arg_min(para_idx, first_seen), 1.0, false FROM refs GROUP BY doc_id)"""

# --- features
ALL_TYPES = ["citation", "reference_list", *P.ELEMENT_TYPES]
CTE["firsts"] = "SELECT doc_id, " + ", ".join(f"arg_min(para_idx, elem_seq) FILTER (WHERE type = '{t}') AS {t}" for t in ALL_TYPES) + " FROM elements GROUP BY doc_id"
CTE["docs"] = "SELECT DISTINCT doc_id, source FROM documents"
CTE["bodies"] = "SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS body FROM units GROUP BY doc_id"
CTE["ptext"] = "SELECT doc_id, string_agg(text, chr(10) ORDER BY para_idx) AS body FROM paras GROUP BY doc_id"
BODY_SIGNALS = ["named_test", "training", "ml_evidence", "multi_comparison", "multi_model", "multi_baseline", "single_baseline", "class_task", "class_metric", "hyper_search"]
CTE["sigs"] = "SELECT doc_id, " + ", ".join(f"{sig('body', n)} AS s_{n}" for n in BODY_SIGNALS) + " FROM bodies"
_BARE_NUM = r"regexp_replace(text, '\[\s*\d[\d\s,，\-–—]*\]', '', 'g')"
CTE["uflags"] = f"SELECT doc_id, bool_or({sig('text', 'split_word')} AND {sig('text', 'split_detail')}) AS detail, bool_or({sig('text', 'hyper_unit')} AND {sig(_BARE_NUM, 'hyper_range')}) AS ranged FROM units GROUP BY doc_id"
CTE["pflags"] = f"""
 SELECT doc_id, count(*) AS n_paras, max(para_idx) AS last_para, bool_or(is_heading AND {sig('s', 'intro')}) AS has_intro,
  bool_or({sig('text', 'baseline')}) AS any_base,
  max(CASE WHEN {sig('text', 'multi_comparison')} THEN para_idx END) AS multi_at,
  max(CASE WHEN {sig('text', 'model_word')} THEN para_idx END) AS model_at,
  max(CASE WHEN NOT is_heading AND NOT regexp_matches(text, '^\\s*\\[\\d+\\]') AND {sig('text', 'p_body')} THEN para_idx END) AS p_at,
  min(CASE WHEN NOT is_heading AND para_idx >= 3 AND {sig('text', 'baseline_body')} THEN para_idx END) AS base_at
 FROM paras GROUP BY doc_id"""
_STATE = ", ".join(
    f"last_value(CASE WHEN is_heading THEN CASE WHEN {rx('text', sp, False)} THEN 1 WHEN outline <= 1 THEN 0 END END IGNORE NULLS) OVER w AS in_{n}" for n, (sp, _) in P.SECTION_ANCHORS.items()
)
CTE["secstate"] = f"SELECT doc_id, para_idx, text, is_heading, {_STATE} FROM paras WINDOW w AS (PARTITION BY doc_id ORDER BY para_idx ROWS UNBOUNDED PRECEDING)"
CTE["sec"] = "SELECT doc_id, " + ", ".join(
    f"min(CASE WHEN NOT is_heading AND in_{n} = 1{'' if tp is None else ' AND ' + rx('text', tp, False)} THEN para_idx END) AS a_{n}" for n, (_, tp) in P.SECTION_ANCHORS.items()
) + " FROM secstate GROUP BY doc_id"
CTE["feat"] = """
 SELECT *, (data_split IS NOT NULL OR s_training) AS trains, (novel_module IS NOT NULL OR (metric IS NOT NULL AND s_ml_evidence)) AS ai
 FROM docs LEFT JOIN firsts USING (doc_id) LEFT JOIN sigs USING (doc_id) LEFT JOIN uflags USING (doc_id) LEFT JOIN pflags USING (doc_id) LEFT JOIN sec USING (doc_id)"""
CTE["ptype"] = f"""
 SELECT *, CASE WHEN title_strong OR strong_hits >= 2 OR (title_weak AND empirical_hits <= 3) OR (review_hits >= 3 AND empirical_hits <= review_hits) THEN 'review' WHEN empirical_hits >= 3 THEN 'empirical' ELSE 'unknown' END AS paper_type FROM (
  SELECT d.doc_id, len(regexp_extract_all(coalesce(p.body, ''), {q('(?i)' + P.SIGNALS['review'][0])})) AS review_hits, len(regexp_extract_all(coalesce(p.body, ''), {q('(?i)' + P.SIGNALS['strong_review'][0])})) AS strong_hits,
   len(regexp_extract_all(coalesce(p.body, ''), {q('(?i)' + P.SIGNALS['empirical'][0])})) AS empirical_hits,
   coalesce({sig('t.titles', 'strong_review')}, false) AS title_strong, coalesce({sig('t.titles', 'review')}, false) AS title_weak
  FROM docs d LEFT JOIN ptext p USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(s, ' ' ORDER BY para_idx) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS rn FROM paras WHERE is_heading) WHERE rn <= 5 GROUP BY doc_id) t USING (doc_id))"""

# --- the 17 rules
_DS = "coalesce(data_split, metric, novel_module, study_design)"
RULE_SQL = {
    "R-REF-01": """SELECT doc_id, 0 AS rno, cite_idx AS k, 'REF1_BAD' AS code, para_idx, nums AS arg0, marker AS arg1 FROM dangling
      UNION ALL SELECT c.doc_id, 0, 0, 'REF1_OK', arg_min(c.para_idx, c.cite_idx), NULL, NULL FROM cites c ANTI JOIN dangling d USING (doc_id) GROUP BY c.doc_id""",
    "R-REF-02": "SELECT doc_id, 1, 0, CASE WHEN reference_list IS NOT NULL THEN 'REF2_OK' ELSE 'REF2_BAD' END, coalesce(reference_list, citation), NULL, NULL FROM feat WHERE citation IS NOT NULL",
    "R-03": f"""SELECT u.doc_id, 2, u.pos, 'LEAK', u.para_idx, left(trim(u.text), 80), NULL FROM units u JOIN feat f USING (doc_id) WHERE (f.trains OR f.ai) AND {_DS} IS NOT NULL AND {sig('u.text', 'leak')}
      UNION ALL SELECT doc_id, 2, 0, CASE WHEN data_split IS NOT NULL AND detail THEN 'SPLIT_OK' WHEN data_split IS NOT NULL THEN 'SPLIT_VAGUE' ELSE 'SPLIT_NONE' END,
       CASE WHEN data_split IS NOT NULL AND detail THEN {_DS} ELSE coalesce(a_split_a, a_split_b, {_DS}) END, NULL, NULL
       FROM feat WHERE (trains OR ai) AND {_DS} IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM units WHERE {sig('text', 'leak')})""",
    "R-07": "SELECT doc_id, 3, 0, CASE WHEN s_named_test THEN 'TEST_OK' ELSE 'TEST_BAD' END, CASE WHEN s_named_test THEN coalesce(stat_test, p_value) ELSE coalesce(p_at, p_value) END, NULL, NULL FROM feat WHERE p_value IS NOT NULL",
    "R-09": "SELECT doc_id, 4, 0, CASE WHEN confidence_interval IS NOT NULL THEN 'CI_OK' ELSE 'CI_BAD' END, CASE WHEN confidence_interval IS NULL THEN coalesce(a_ci, stat_test, p_value, metric) ELSE coalesce(stat_test, p_value, metric) END, NULL, NULL FROM feat WHERE coalesce(stat_test, p_value, metric) IS NOT NULL",
    "R-02": "SELECT doc_id, 5, 0, CASE WHEN sample_size_rationale IS NOT NULL THEN 'SIZE_OK' ELSE 'SIZE_BAD' END, coalesce(sample_size, study_design), NULL, NULL FROM feat WHERE coalesce(sample_size, study_design) IS NOT NULL",
    "R-14": "SELECT doc_id, 6, 0, CASE WHEN reproducibility IS NOT NULL THEN 'REPRO_OK' ELSE 'REPRO_BAD' END, CASE WHEN reproducibility IS NULL THEN coalesce(a_repro, data_split, study_design, novel_module, 0) ELSE coalesce(data_split, study_design, novel_module, 0) END, NULL, NULL FROM feat WHERE trains OR ai",
    "R-08": "SELECT doc_id, 7, 0, CASE WHEN multiple_comparison IS NOT NULL THEN 'MULTI_OK' ELSE 'MULTI_BAD' END, coalesce(multi_at, baseline, metric, 0), NULL, NULL FROM feat WHERE ai AND s_multi_comparison",
    "R-04": """SELECT doc_id, 8, 0, CASE WHEN s_multi_model OR s_multi_baseline THEN 'BASE_MANY' WHEN s_single_baseline THEN 'BASE_ONE' WHEN any_base THEN 'BASE_OK' ELSE 'BASE_NONE' END,
       CASE WHEN s_multi_model OR s_multi_baseline THEN anchor WHEN s_single_baseline THEN coalesce(a_baseline, base_at, anchor) WHEN any_base THEN anchor ELSE coalesce(model_at, anchor) END, NULL, NULL
       FROM (SELECT *, coalesce(novel_module, metric, study_design, baseline) AS anchor FROM feat) WHERE ai AND anchor IS NOT NULL""",
    "R-05": "SELECT doc_id, 9, 0, CASE WHEN ablation IS NOT NULL THEN 'ABL_OK' ELSE 'ABL_BAD' END, coalesce(a_ablation, novel_module), NULL, NULL FROM feat WHERE novel_module IS NOT NULL",
    "R-11": "SELECT doc_id, 10, 0, 'OVER_BAD', overgeneralization, NULL, NULL FROM feat WHERE overgeneralization IS NOT NULL",
    "R-15": "SELECT doc_id, 11, 0, CASE WHEN limitation IS NOT NULL THEN 'LIM_OK' ELSE 'LIM_BAD' END, coalesce(limitation, a_limitation, last_para), NULL, NULL FROM feat WHERE n_paras >= 4",
    "R-01": "SELECT doc_id, 12, 0, CASE WHEN research_goal IS NOT NULL THEN 'GOAL_OK' ELSE 'GOAL_BAD' END, coalesce(study_design, metric, novel_module, 0), NULL, NULL FROM feat WHERE has_intro",
    "R-06": "SELECT doc_id, 13, 0, CASE WHEN s_class_task AND NOT s_class_metric THEN 'METRIC_MISFIT' WHEN metric IS NOT NULL THEN 'METRIC_OK' ELSE 'METRIC_BAD' END, coalesce(a_metric_a, a_metric_b, novel_module), NULL, NULL FROM feat WHERE novel_module IS NOT NULL",
    "R-10": "SELECT doc_id, 14, 0, CASE WHEN repeats IS NOT NULL OR confidence_interval IS NOT NULL THEN 'REP_OK' ELSE 'REP_BAD' END, CASE WHEN repeats IS NULL AND confidence_interval IS NULL THEN coalesce(a_repeats, metric) ELSE metric END, NULL, NULL FROM feat WHERE ai AND metric IS NOT NULL",
    "R-12": "SELECT doc_id, 15, 0, CASE WHEN s_hyper_search AND ranged THEN 'HYP_OK' WHEN s_hyper_search THEN 'HYP_NORANGE' ELSE 'HYP_BAD' END, CASE WHEN s_hyper_search AND NOT ranged THEN coalesce(a_hyper, hyperparameter) ELSE hyperparameter END, NULL, NULL FROM feat WHERE hyperparameter IS NOT NULL",
    "R-13": "SELECT doc_id, 16, 0, CASE WHEN preprocessing IS NOT NULL THEN 'PRE_OK' ELSE 'PRE_BAD' END, coalesce(metric, novel_module, data_split, study_design, 0), NULL, NULL FROM feat WHERE ai",
}
CTE["outcome"] = "\n UNION ALL ".join(RULE_SQL.values())


def _outcomes():
    from paperlens.operators.rules import OUTCOME_OF

    return f"SELECT * FROM {values([(c, *o) for c, o in OUTCOME_OF.items()])} t(code, item_id, verdict, severity)"


CTE["codes"] = _outcomes()
CTE["rulef"] = f"""
 SELECT o.doc_id, row_number() OVER (PARTITION BY o.doc_id ORDER BY o.rno, o.k) - 1 AS seq, c.item_id, o.code, c.verdict, c.severity,
  CASE WHEN c.item_id IN {inlist(P.DETERMINISTIC_ITEMS)} THEN 'deterministic' ELSE 'suspected' END AS certainty, o.para_idx, o.arg0, o.arg1 FROM outcome o JOIN codes c USING (code)"""
CTE["items"] = f"SELECT *, item_no - 1 AS k FROM {values([(i + 1, r[0], r[2], r[3], r[4], r[5]) for i, r in enumerate(P.CHECKLIST)])} t(item_no, item_id, severity_default, judge, title, description)"
CTE["requires"] = f"SELECT * FROM {values([(r[0], j, t) for r in P.CHECKLIST for j, t in enumerate(r[1])])} t(item_id, rpos, type)"
CTE["applic"] = f"SELECT p.doc_id, p.paper_type, i.* FROM ptype p, items i WHERE p.paper_type <> 'review' OR i.item_id IN {inlist(P.REVIEW_ALLOWED)}"
CTE["msgs"] = f"SELECT * FROM {values([(k, *v) for k, v in P.OUTCOMES.items()])} t(code, headline, description, suggestion)"

# --- numeric checks, on flat match rows
_RATIO = r"(?:^|[^\d.])(\d{1,3}(?:\s*[:：]\s*\d{1,3})+)(?:$|[^\d.])"
CTE["ratios"] = f"""
 SELECT doc_id, pos, para_idx, arg_min(total, k) AS total, arg_min(parts, k) AS parts FROM (SELECT doc_id, pos, para_idx, k, array_to_string(list_transform(regexp_extract_all(m, '\\d+'), lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ':') AS parts, list_sum(list_transform(regexp_extract_all(m, '\\d+'), lambda x: CAST(x AS INTEGER))) AS total FROM (
   SELECT doc_id, pos, para_idx, unnest(ms) AS m, unnest(range(len(ms))) AS k FROM (SELECT doc_id, pos, para_idx, regexp_extract_all(text, {q(_RATIO)}, 1) AS ms FROM units WHERE regexp_matches(text, {q(P.SPLIT_CONTEXT)}))))
 WHERE total > {P.RATIO_PARTS} AND total <> {P.RATIO_PERCENT} GROUP BY doc_id, pos, para_idx"""
# percent: guard characters are captured, then each hit is tested and runs are gaps-and-islands
_PCT = r"\d{1,3}(?:\.\d+)?\s*%"
CTE["pcts"] = f"""
 SELECT doc_id, pos, para_idx, text, unnest(ms) AS m, unnest(range(len(ms))) AS k, ps FROM (SELECT *, string_split(regexp_replace(text, {q('(' + _PCT + ')')}, chr(2), 'g'), chr(2)) AS ps, regexp_extract_all(text, {q(_PCT)}) AS ms FROM units WHERE regexp_matches(text, {q(P.SPLIT_CONTEXT)}) AND contains(text, '%'))"""
CTE["pct1"] = f"""
 SELECT *, ps[k+1] AS before, ps[k+2] AS after, array_to_string(list_transform(range(k+1), lambda j: ps[j+1] || CASE WHEN j < k THEN ms[j+1] ELSE '' END), '') AS lft FROM (
  SELECT p.*, regexp_extract_all(p.text, {q(_PCT)}) AS ms FROM pcts p)"""
CTE["pct2"] = rf"""
 SELECT doc_id, pos, para_idx, k, CAST(regexp_extract(m, '^[\d.]+') AS DOUBLE) AS v, before,
  (regexp_matches(right(lft, 20), '(?s)(?:{P.SPLIT_CONTEXT}).{{0,{P.SPLIT_WINDOW}}}$') OR regexp_matches(left(substr(text, length(lft) + length(m) + 1), 20), '(?s)^.{{0,{P.SPLIT_WINDOW}}}(?:{P.SPLIT_CONTEXT})'))
   AND NOT regexp_matches(right(lft, {P.METRIC_WINDOW}), {q(P.METRIC_CONTEXT)}) AS share
 FROM pct1 WHERE NOT regexp_matches(lft, '[\d.]$') AND NOT regexp_matches(after, '(?i)^\s*(?:CI|置信)')"""
CTE["pct3"] = f"""
 SELECT *, sum(CASE WHEN prev_k = k - 1 AND prev_share AND regexp_matches(before, {q(P.PERCENT_GAP)}) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, pos ORDER BY k) AS grp FROM (
  SELECT *, lag(k) OVER w AS prev_k, lag(share) OVER w AS prev_share FROM pct2 WINDOW w AS (PARTITION BY doc_id, pos ORDER BY k)) WHERE share"""
CTE["percents"] = f"""
 SELECT doc_id, pos, para_idx, arg_min(total, grp) AS total, arg_min(parts, grp) AS parts FROM (SELECT doc_id, pos, para_idx, grp, sum(v) AS total, count(*) AS n, string_agg(regexp_replace(CAST(v AS VARCHAR), '\\.0$', '') || '%', ' + ' ORDER BY k) AS parts FROM pct3 GROUP BY doc_id, pos, para_idx, grp) WHERE n >= 2 AND NOT (total BETWEEN {P.PERCENT_LOW} AND {P.PERCENT_HIGH}) GROUP BY doc_id, pos, para_idx"""
_CI = "(?i)" + P.CI_PAIR.replace(r"(?<![\d.])", r"(?:^|[^\d.])")
CTE["intervals"] = f"""
 SELECT doc_id, pos, para_idx, arg_min(txt, k) AS txt FROM (SELECT *, CAST(pt AS VARCHAR) || '|' || CAST(lo AS VARCHAR) || '|' || CAST(hi AS VARCHAR) AS txt FROM (
  SELECT doc_id, pos, para_idx, k, CAST(g1 AS DOUBLE) AS pt, least(CAST(g3 AS DOUBLE), CAST(g5 AS DOUBLE)) AS lo, greatest(CAST(g3 AS DOUBLE), CAST(g5 AS DOUBLE)) AS hi, g2, g4, g6 FROM (
   SELECT doc_id, pos, para_idx, unnest(range(len(regexp_extract_all(text, {q(_CI)}, 1)))) AS k, {', '.join(f"unnest(regexp_extract_all(text, {q(_CI)}, {g})) AS g{g}" for g in range(1, 7))} FROM units WHERE contains(text, '95')))
  WHERE coalesce(g2, '') = coalesce(g4, '') AND coalesce(g4, '') = coalesce(g6, '') AND NOT (pt BETWEEN lo AND hi)) GROUP BY doc_id, pos, para_idx"""
CTE["numeric"] = """
 SELECT n.*, left(trim(u.text, ' \t'), 80) AS quote FROM (
 SELECT doc_id, pos, 0 AS c, 'R-DATA-01' AS item_id, 'RATIO_BAD' AS code, para_idx, CAST(total AS VARCHAR) AS arg0, parts FROM ratios
 UNION ALL SELECT doc_id, pos, 1, 'R-DATA-02', 'PERCENT_BAD', para_idx, CAST(round(total, 4) AS VARCHAR), parts FROM percents
 UNION ALL SELECT doc_id, pos, 2, 'R-DATA-03', 'INTERVAL_BAD', para_idx, txt, NULL FROM intervals) n JOIN units u ON u.doc_id = n.doc_id AND u.pos = n.pos"""
_BARE_NO = lambda e: f"regexp_replace({e}, '\\.0$', '')"
CTE["numtext"] = f"""
 SELECT *, '原文：「' || quote || '」——' || CASE code
   WHEN 'RATIO_BAD' THEN '划分比例 ' || parts || ' 之和为 ' || arg0 || '，既不是按份数的 10，也不是按百分比的 100。'
   WHEN 'PERCENT_BAD' THEN '划分相关百分比 ' || parts || ' 之和为 ' || {_BARE_NO('arg0')} || '%，与 100% 不一致。'
   ELSE '点估计 ' || {_BARE_NO("split_part(arg0, '|', 1)")} || ' 不在 95% 置信区间 [' || {_BARE_NO("split_part(arg0, '|', 2)")} || ', ' || {_BARE_NO("split_part(arg0, '|', 3)")} || '] 内。' END AS description,
  CASE code WHEN 'RATIO_BAD' THEN '数据划分比例之和自洽性存疑' WHEN 'PERCENT_BAD' THEN '数据划分百分比合计自洽性存疑' ELSE '置信区间与点估计不一致' END AS headline,
  CASE code WHEN 'RATIO_BAD' THEN '核对训练/验证/测试集划分比例，使其之和为 10（份数）或 100（百分比）。' WHEN 'PERCENT_BAD' THEN '核对各组划分百分比，使其合计为 100%。' ELSE '核对点估计与置信区间上下限，确保点估计落在区间内。' END AS suggestion
 FROM numeric"""

# --- figures
_ZHN = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def zh(e):
    d = lambda x: "CASE " + x + " " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in _ZHN.items()) + " END"
    return f"""CASE WHEN regexp_matches({e}, '^[0-9]+$') THEN CAST({e} AS INTEGER) WHEN {e} = '十' THEN 10
      WHEN length({e}) = 2 AND {e}[1] = '十' THEN 10 + {d(e + '[2]')} WHEN length({e}) = 2 AND {e}[2] = '十' THEN 10 * {d(e + '[1]')}
      WHEN length({e}) = 3 AND {e}[2] = '十' THEN 10 * {d(e + '[1]')} + {d(e + '[3]')} WHEN length({e}) = 1 THEN {d(e)} END"""


def kindof(e):
    return f"CASE WHEN starts_with(lower({e}), 'supplementary') THEN CASE WHEN contains(lower({e}), 'table') THEN '表' ELSE '图' END WHEN contains(lower({e}), 'fig') OR contains({e}, '图') THEN '图' ELSE '表' END"


_CAP = q("(?i)" + P.CAPTION)
CTE["caps0"] = f"""
 SELECT doc_id, para_idx, text, {kindof(f'regexp_extract(s, {_CAP}, 1)')} AS kind, {zh(f'regexp_extract(s, {_CAP}, 2)')} AS number FROM paras
 WHERE regexp_matches(s, {_CAP}) AND (regexp_matches(regexp_extract(s, {_CAP}, 3), {q(P.CAPTION_SEPARATOR)}) OR (length(s) <= {P.CAPTION_MAX_PLAIN} AND NOT regexp_matches(regexp_extract(s, {_CAP}, 3), {q(P.CAPTION_BODY_VERB)})))
  AND NOT regexp_matches(regexp_extract(s, {_CAP}, 3), {q(P.CAPTION_SENTENCE_END)})"""
CTE["caps"] = "SELECT doc_id, kind, number, min(para_idx) AS para_idx, arg_min(text, para_idx) AS text FROM caps0 WHERE number IS NOT NULL GROUP BY doc_id, kind, number"
_MENT = rf"(?i)([{P.NOT_FIGURE_PREFIX}]?图|[{P.NOT_TABLE_PREFIX}]?表|附图|附表|Supplementary\s+(?:Fig(?:ure)?|Table)|Figure|Fig\.?|Table)\s*([0-9]+|[{P.ZH_NUMERALS}]+)(\s*(?:{P.QUANTITY_UNITS}))?"
_PRE = P.NOT_FIGURE_PREFIX + P.NOT_TABLE_PREFIX
CTE["ments0"] = f"""SELECT doc_id, para_idx, text, k, g1, g2, g3 FROM (SELECT doc_id, para_idx, text, unnest(range(len(regexp_extract_all(text, {q(_MENT)}, 1)))) AS k, {', '.join(f"unnest(regexp_extract_all(text, {q(_MENT)}, {g})) AS g{g}" for g in (1, 2, 3))} FROM paras)
 WHERE coalesce(g3, '') = '' AND NOT (length(g1) = 2 AND left(g1, 1) <> '附' AND regexp_matches(g1, '^[{_PRE}]'))"""
CTE["ments"] = f"SELECT m.doc_id, m.para_idx, m.text, m.k, {kindof('m.g1')} AS kind, {zh('m.g2')} AS number FROM ments0 m ANTI JOIN caps c ON c.doc_id = m.doc_id AND c.para_idx = m.para_idx"
CTE["figcount"] = "SELECT doc_id, count(*) AS figure_mentions FROM ments0 WHERE (regexp_matches(g2, '^[0-9]+$') OR contains(g1, '图')) GROUP BY doc_id"
CTE["nobj"] = "SELECT d.doc_id, coalesce(i.n, 0) AS n_img, coalesce(t.n, 0) AS n_tbl FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM img GROUP BY 1) i USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM tbl GROUP BY 1) t USING (doc_id)"


def samp(src):
    g = lambda i: f"unnest(regexp_extract_all(text, {q(P.SAMPLE_SIZE)}, {i})) AS g{i}"
    keys = "doc_id, para_idx" + (", kind, number, k" if src == "ments" else ", kind, number")
    return f"""SELECT {keys}, unit, arg_min(value, p) AS value, min(p) AS p FROM (SELECT {keys}, p, CASE WHEN g1 <> '' OR g3 IN {inlist(P.COUNT_UNITS)} THEN {q(P.COUNT_UNIT)} ELSE g3 END AS unit, CAST(replace(CASE WHEN g1 <> '' THEN g1 ELSE g2 END, ',', '') AS BIGINT) AS value
   FROM (SELECT {keys}, unnest(range(len(regexp_extract_all(text, {q(P.SAMPLE_SIZE)}, 1)))) AS p, {g(1)}, {g(2)}, {g(3)} FROM {src} WHERE number IS NOT NULL)) GROUP BY {keys}, unit"""


CTE["csamp"] = samp("caps")
CTE["msamp"] = samp("ments")
CTE["figure"] = """
 SELECT n.doc_id, 0 AS c, kind AS o1, 0 AS o2, 'CAPTION_MISSING' AS code, coalesce(p.last_para, 0) AS para_idx, kind AS arg0, CAST(n_obj AS VARCHAR) AS arg1, 0 AS o3, 0 AS o4 FROM (
   SELECT doc_id, '图' AS kind, n_img AS n_obj FROM nobj UNION ALL SELECT doc_id, '表', n_tbl FROM nobj) n ANTI JOIN caps c ON c.doc_id = n.doc_id AND c.kind = n.kind LEFT JOIN pflags p ON p.doc_id = n.doc_id WHERE n_obj > 0
 UNION ALL
 SELECT m.doc_id, 1, m.kind, m.number, 'MENTION_UNCAPTIONED', min(m.para_idx), m.kind || m.number, NULL, 0, 0 FROM ments m ANTI JOIN caps c ON c.doc_id = m.doc_id AND c.kind = m.kind AND c.number = m.number JOIN nobj n ON n.doc_id = m.doc_id
   WHERE m.number IS NOT NULL AND CASE WHEN m.kind = '图' THEN n_img ELSE n_tbl END > 0 GROUP BY m.doc_id, m.kind, m.number
 UNION ALL
 SELECT m.doc_id, 2, m.kind, m.number, 'SAMPLE_CONFLICT', m.para_idx, m.kind || m.number, c.value || '|' || m.value || '|' || m.unit, m.para_idx, m.k*100+m.p FROM msamp m JOIN csamp c ON c.doc_id = m.doc_id AND c.kind = m.kind AND c.number = m.number AND c.unit = m.unit JOIN nobj n ON n.doc_id = m.doc_id
   WHERE c.value <> m.value AND (n_img > 0 OR n_tbl > 0)"""


_OBJECT = lambda a, b: f"CASE arg0 WHEN '图' THEN '{a}' ELSE '{b}' END"
CTE["figtext"] = f"""
 SELECT *, CASE code
   WHEN 'CAPTION_MISSING' THEN '文档含 ' || arg1 || ' 个' || {_OBJECT('图片', '表格')} || '，但未识别到' || arg0 || '题'
   WHEN 'MENTION_UNCAPTIONED' THEN '正文引用了 ' || arg0 || '，但未找到对应题注' ELSE arg0 || ' 题注与正文的样本量不一致' END AS headline,
  CASE code
   WHEN 'CAPTION_MISSING' THEN '解析到 ' || arg1 || ' 个' || {_OBJECT('内嵌图片', '表格')} || '，但全文未检出「' || arg0 || '1」形式的题注（也可能题注版式未被识别），无法核对' || arg0 || '与正文的对应关系。'
   WHEN 'MENTION_UNCAPTIONED' THEN '正文第 ' || para_idx || ' 段引用了「' || arg0 || '」，但全文未检出同编号的题注，可能缺少图/表或题注编号不一致。'
   ELSE '题注声明 ' || split_part(arg1, '|', 1) || split_part(arg1, '|', 3) || '，而引用该图表的正文第 ' || para_idx || ' 段声明 ' || split_part(arg1, '|', 2) || split_part(arg1, '|', 3) || '，两处口径不一致，需核对题注或正文数值。' END AS description,
  CASE code
   WHEN 'CAPTION_MISSING' THEN '为每' || {_OBJECT('张图', '个表')} || '补充规范化题注（如「' || arg0 || '1 名称」），并在正文中引用。'
   WHEN 'MENTION_UNCAPTIONED' THEN '核对' || arg0 || '是否存在，并补齐题注或统一编号。' ELSE '核对' || arg0 || '对应的样本量，统一题注与正文的表述。' END AS suggestion
 FROM figure"""


def sql(final: str, order=None) -> str:
    """The final SELECT with exactly the CTEs it needs, in definition order."""
    need, todo = set(), [final]
    while todo:
        body = todo.pop()
        for name in CTE:
            if name not in need and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", body):
                need.add(name)
                todo.append(CTE[name])
    names = [n for n in CTE if n in need]
    if not names:
        return final
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in names) + "\n" + final


# --- model verdicts, draft findings, gates -------------------------------------------
CTE["vraw"] = f"""
 SELECT d.doc_id, i.k, row_number() OVER (PARTITION BY d.doc_id ORDER BY i.k) - 1 AS mseq,
  CASE WHEN (d.doc_id + i.k) % 11 = 0 THEN 'R-99' WHEN (d.doc_id + i.k) % 7 = 0 THEN i.title ELSE i.item_id END AS raw_id,
  ['pass','problem','uncertain','maybe','problem'][(d.doc_id*3 + i.k) % 5 + 1] AS verdict, coalesce(['high','mid','low',NULL][(d.doc_id + i.k*2) % 4 + 1], 'mid') AS severity,
  'H' || i.k AS headline, 'D' || d.doc_id || '-' || i.k AS description, 'S' || i.k AS suggestion
 FROM docs d, items i WHERE (d.doc_id + i.k) % 3 <> 0"""
CTE["verd"] = """
 SELECT v.*, coalesce(a.item_id, b.item_id, 'unknown') AS item_id FROM vraw v LEFT JOIN items a ON a.item_id = v.raw_id AND a.judge <> 'rule' LEFT JOIN items b ON b.title = v.raw_id AND b.judge <> 'rule' WHERE v.verdict <> 'maybe'"""
# both verdict sets are matched on the items that apply to the document; the others are all unknown
CTE["verda"] = "SELECT v.* EXCLUDE (item_id), coalesce(a.item_id, 'unknown') AS item_id FROM verd v LEFT JOIN applic a ON a.doc_id = v.doc_id AND a.item_id = v.item_id"
CTE["second"] = "SELECT *, ['problem','pass','problem'][(doc_id + k) % 3 + 1] AS verdict2 FROM verda"
CTE["dual"] = """
 SELECT v.* EXCLUDE (verdict), CASE WHEN s.verdict2 IS NOT NULL AND s.verdict2 <> v.verdict THEN 'uncertain' ELSE v.verdict END AS verdict,
  CASE WHEN s.verdict2 <> v.verdict THEN 'disagree' END AS dual_check, CASE WHEN s.verdict2 <> v.verdict THEN s.verdict2 END AS dual_verdict
 FROM verda v LEFT JOIN (SELECT doc_id, item_id, arg_max(verdict2, mseq) AS verdict2 FROM second GROUP BY ALL) s USING (doc_id, item_id)"""
CTE["noverd"] = "SELECT *, CAST(NULL AS VARCHAR) AS dual_check, CAST(NULL AS VARCHAR) AS dual_verdict FROM verd WHERE false"
CTE["verd1"] = "SELECT *, CAST(NULL AS VARCHAR) AS dual_check, CAST(NULL AS VARCHAR) AS dual_verdict FROM verd"
CTE["ef"] = "SELECT * FROM (SELECT doc_id, type, arg_min(para_idx, elem_seq) AS para_idx, arg_min(confidence, elem_seq) AS conf FROM elements GROUP BY doc_id, type)"
CTE["ev"] = "SELECT e.doc_id, r.item_id, list(e.para_idx ORDER BY r.rpos) AS eparas, list(e.type ORDER BY r.rpos) AS etypes, min(e.conf) >= 1.0 AS solid FROM requires r JOIN ef e USING (type) GROUP BY e.doc_id, r.item_id"
CTE["tabtypes"] = "SELECT DISTINCT doc_id, type FROM elements WHERE in_table"
CTE["demo"] = f"SELECT * FROM {values([(i, t) for i, ts in P.DEMOTE_EVIDENCE.items() for t in ts])} t(item_id, type)"
CTE["intab"] = "SELECT DISTINCT t.doc_id, d.item_id FROM tabtypes t JOIN demo d USING (type)"
_FMT = lambda c: f"replace(replace(m.{c}, '{{0}}', coalesce(r.arg0, '')), '{{1}}', coalesce(r.arg1, ''))"


def findings(n, verdicts, demote=True):
    """CTEs n0 (draft) .. n (scored) over one verdict relation."""
    CTE[n + "fold"] = f"SELECT doc_id, item_id, arg_max(verdict, mseq) AS llm_verdict, arg_min(description, mseq) AS d2, arg_min(suggestion, mseq) AS s2 FROM {verdicts} GROUP BY doc_id, item_id"
    CTE[n + "ext"] = f"SELECT v.* EXCLUDE (item_id), coalesce(a.item_id, 'unknown') AS item_id FROM {verdicts} v LEFT JOIN applic a ON a.doc_id = v.doc_id AND a.item_id = v.item_id"
    CTE[n + "0"] = f"""
 SELECT r.doc_id, 0 AS phase, r.seq, 'rule' AS engine, r.item_id, r.code, r.verdict, CASE WHEN r.verdict = 'problem' THEN r.severity_default ELSE r.severity END AS severity, r.certainty, [r.para_idx] AS anchors,
   {_FMT('headline')} AS headline, coalesce(nullif({_FMT('description')}, ''), f.d2, '') AS description, coalesce(nullif({_FMT('suggestion')}, ''), f.s2, '') AS suggestion,
   f.llm_verdict, coalesce(f.llm_verdict <> r.verdict, false) AS conflict, coalesce(r.verdict = 'pass' AND f.llm_verdict = 'problem', false) AS vetoed_llm, CAST(NULL AS VARCHAR) AS dual_check
  FROM (SELECT rulef.*, a.severity_default, row_number() OVER (PARTITION BY rulef.doc_id, rulef.item_id ORDER BY rulef.seq) AS nth FROM rulef JOIN applic a ON a.doc_id = rulef.doc_id AND a.item_id = rulef.item_id) r
  JOIN msgs m ON m.code = r.code LEFT JOIN {n}fold f ON f.doc_id = r.doc_id AND f.item_id = r.item_id AND r.nth = 1
 UNION ALL
 SELECT v.doc_id, 1, {1 << 40} + v.mseq, 'llm', v.item_id, NULL, v.verdict, v.severity, 'suspected', [], v.headline, v.description, v.suggestion, NULL, false, false, v.dual_check
  FROM {n}ext v WHERE v.item_id = 'unknown' OR NOT EXISTS (SELECT 1 FROM rulef r WHERE r.doc_id = v.doc_id AND r.item_id = v.item_id)
 UNION ALL
 SELECT u.doc_id, 2, {2 << 40} + row_number() OVER (PARTITION BY u.doc_id ORDER BY u.item_no) - 1, 'rule', u.item_id, 'UNASSESSED', 'not_applicable', 'low', 'undetermined', [], m.headline, replace(m.description, '{{0}}', u.title), '', NULL, false, false, NULL
  FROM (SELECT a.* FROM applic a ANTI JOIN rulef r ON r.doc_id = a.doc_id AND r.item_id = a.item_id) u JOIN msgs m ON m.code = 'UNASSESSED' WHERE NOT EXISTS (SELECT 1 FROM {n}fold f WHERE f.doc_id = u.doc_id AND f.item_id = u.item_id)
 UNION ALL
 SELECT x.doc_id, 3, {3 << 40} + row_number() OVER (PARTITION BY x.doc_id ORDER BY pos, c) - 1, 'rule', item_id, code, 'problem', 'low', 'deterministic', [para_idx], headline, description, suggestion, NULL, false, false, NULL FROM numtext x JOIN ptype p ON p.doc_id = x.doc_id AND p.paper_type <> 'review'
 UNION ALL
 SELECT doc_id, 4, {4 << 40} + row_number() OVER (PARTITION BY doc_id ORDER BY c, o1, o2, o3, o4) - 1, 'rule', 'R-FIG-01', code, 'problem', 'low', 'suspected', [para_idx], headline, description, suggestion, NULL, false, false, NULL FROM figtext"""
    CTE[n + "1"] = f"""
 SELECT f.* EXCLUDE (certainty, anchors, verdict, description), CASE WHEN core AND engine = 'rule' AND e.solid THEN 'deterministic' ELSE certainty END AS certainty,
  CASE WHEN len(anchors) > 0 OR NOT core THEN anchors ELSE coalesce(e.eparas[1:3], []) END AS anchors, CASE WHEN core THEN coalesce(e.etypes, []) ELSE [] END AS evidence,
  CASE WHEN lost THEN 'uncertain' ELSE verdict END AS verdict, CASE WHEN lost THEN {q(P.PREFIX_NO_EVIDENCE)} || description ELSE description END AS description, CASE WHEN lost THEN 'no_evidence' END AS gate1
 FROM (SELECT g.*, phase <= 1 AS core, (phase <= 1 AND engine = 'llm' AND g.verdict = 'problem' AND len(anchors) = 0 AND x.item_id IS NULL) AS lost FROM {n}0 g LEFT JOIN ev x ON x.doc_id = g.doc_id AND x.item_id = g.item_id) f LEFT JOIN ev e ON e.doc_id = f.doc_id AND e.item_id = f.item_id"""
    CTE[n + "2"] = f"""
 SELECT f.* EXCLUDE (verdict, description), CASE WHEN soft THEN 'uncertain' ELSE f.verdict END AS verdict, CASE WHEN soft THEN {q(P.PREFIX_ADVISORY)} || f.description ELSE f.description END AS description, soft AS advisory
 FROM (SELECT g.*, (engine = 'llm' AND verdict = 'problem' AND coalesce(i.judge, 'llm') = 'advisory') AS soft FROM {n}1 g LEFT JOIN items i ON i.item_id = g.item_id) f"""
    CTE[n + "3"] = f"""
 SELECT f.* EXCLUDE (verdict, description, gate1), CASE WHEN hit THEN 'uncertain' ELSE verdict END AS verdict, CASE WHEN hit THEN {q(P.PREFIX_FIGURES)} || description ELSE description END AS description, CASE WHEN hit THEN 'figures_unparsed' ELSE gate1 END AS evidence_gate
 FROM (SELECT g.*, ({'true' if demote else 'false'} AND fc.figure_mentions > 0 AND engine = 'rule' AND verdict = 'problem' AND g.item_id IN {inlist(P.DEMOTE_EVIDENCE)} AND t.item_id IS NULL) AS hit
   FROM {n}2 g LEFT JOIN figcount fc ON fc.doc_id = g.doc_id LEFT JOIN intab t ON t.doc_id = g.doc_id AND t.item_id = g.item_id) f"""
    fac = " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.GATE_FACTOR.items())
    CTE[n] = f"""
 SELECT f.*, CASE WHEN certainty = 'undetermined' THEN 'D' WHEN confidence >= {P.GRADE_A} THEN 'A' WHEN confidence >= {P.GRADE_B} THEN 'B' WHEN confidence >= {P.GRADE_C} THEN 'C' ELSE 'D' END AS grade FROM (
  SELECT f.*, p.paper_type, CASE WHEN certainty = 'undetermined' THEN 'not_evaluated' WHEN evidence_gate = 'no_evidence' THEN 'no_evidence' WHEN vetoed_llm THEN 'vetoed_llm' WHEN evidence_gate = 'rule_anchor_reuse' THEN 'rule_anchor_reuse' WHEN advisory THEN 'advisory' WHEN evidence_gate IS NOT NULL THEN evidence_gate ELSE 'direct' END AS gate_reason,
   CASE WHEN certainty = 'undetermined' THEN 0.0::DOUBLE ELSE round((CASE WHEN certainty = 'deterministic' THEN 1.0 WHEN engine = 'rule' THEN 0.8 ELSE 0.6 END)::DOUBLE * (CASE WHEN len(anchors) > 0 OR len(evidence) > 0 THEN 1.0 ELSE 0.5 END)::DOUBLE
     * (CASE WHEN dual_check = 'disagree' THEN 0.6 WHEN conflict AND verdict = 'problem' THEN 0.7 ELSE 1.0 END)::DOUBLE
     * least(CASE WHEN advisory THEN 0.6 ELSE 1.0 END, CASE WHEN vetoed_llm THEN 0.4 ELSE 1.0 END, coalesce(CASE evidence_gate {fac} END, 1.0))::DOUBLE, 4) END AS confidence
  FROM {n}3 f JOIN ptype p USING (doc_id)) f"""


findings("fr", "noverd")
findings("fm", "verd1")
findings("fd", "dual")
