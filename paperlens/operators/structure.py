"""Document structure: paragraphs, headings, sections, tables, images, citations, references.

``frame`` turns the block array of each document into the normalized arrays, inside the row.
"""

from pyspark.sql import Column, DataFrame, functions as F

from paperlens import packs
from paperlens.sources.intake import unnest
from paperlens.functions.text import ci, cs, is_blank, language, sentence_spans, strip


# --- headings ---------------------------------------------------------------

def numbering_level(s: Column) -> Column:
    depth = F.regexp_extract(s, cs(packs.NUMBERING), 1)
    return F.when(depth != "", F.least(F.size(F.split(depth, r"\.")), F.lit(4))).when(s.rlike(cs(packs.NUMBERING)), F.lit(1))


def style_level(style: Column) -> Column:
    return F.when(style == "Title", F.lit(0)).otherwise(F.coalesce(F.regexp_extract(style, r"(?:^|\s)(\d+)$", 1).try_cast("int"), F.lit(1)))


def heading_reason(s: Column) -> Column:
    """'numbering' / 'keyword' for an unstyled heading, null otherwise (s is stripped)."""
    numbered = s.rlike(cs(packs.NUMBERING))
    keyword = F.lower(s).rlike("^(?:" + "|".join(packs.SECTION_KEYWORDS) + ")")
    fits = (F.length(s) > 0) & (F.length(s) <= packs.HEADING_MAX) & ~s.rlike(ci(packs.CAPTION_START))
    return F.when(fits & numbered, "numbering").when(fits & keyword & ~s.rlike(cs(packs.TERMINAL)), "keyword")


def is_reference_heading(text: Column) -> Column:
    def tail(c):
        return F.regexp_replace(c, cs(packs.REFERENCE_TAIL), "")

    base = F.array(tail(F.regexp_replace(strip(text), cs(packs.REFERENCE_PREFIX), "")))
    bare = lambda b: tail(strip(F.regexp_replace(b, packs.REFERENCE_INLINE, "")))
    return F.exists(base, lambda b: F.lower(b).isin(packs.REFERENCE_TITLES) | F.lower(bare(b)).isin(packs.REFERENCE_TITLES))


def reference_number(text: Column) -> Column:
    """The number that an entry begins with; all digits of the match belong to one group."""
    entry = F.regexp_extract(text, cs(packs.REFERENCE_ITEM), 0)
    return F.regexp_replace(entry, cs(r"\D"), "").try_cast("bigint")


# --- citations --------------------------------------------------------------

SPELLED = 100_000
#: Numbers of one marker that a row holds written out, 80 MB of them.
MOST_NUMBERS = 10_000_000
EMPTY_RANGES = "array<struct<lo:bigint,hi:bigint>>"


def ranges(token: Column) -> Column:
    """'[1-3,5]' to the ranges (1, 3), (5, 5); a reversed range is none."""

    def part(p):
        ends = F.split(F.regexp_replace(p, r"\s", ""), "[-–—]")
        left = F.get(ends, F.lit(0)).try_cast("bigint")
        right = F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0))).try_cast("bigint")
        return F.when(left <= right, F.array(F.struct(left.alias("lo"), right.alias("hi")))).otherwise(F.array().cast(EMPTY_RANGES))

    return F.flatten(F.transform(F.regexp_extract_all(token, F.lit(cs(packs.RANGE_OR_NUMBER)), F.lit(0)), part))


def outside(found: Column, known: Column) -> Column:
    """The parts of the ranges that hold no known number, as ranges: their count is bounded by that of the known numbers."""

    def gaps(r):
        at = F.array_sort(F.array_distinct(F.filter(known, lambda n: n.between(r["lo"], r["hi"]))))
        starts = F.concat(F.array(r["lo"]), F.transform(at, lambda n: n + 1))
        ends = F.concat(F.transform(at, lambda n: n - 1), F.array(r["hi"]))
        return F.filter(F.zip_with(starts, ends, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))), lambda g: g["lo"] <= g["hi"])

    return F.flatten(F.transform(found, gaps))


def spelled(found: Column, separator=", ") -> Column:
    """Numbers of the ranges as text; a range of more than SPELLED numbers is written by its ends, as in '1-200000'."""

    def part(r):
        every = F.transform(F.sequence(r["lo"], F.least(r["hi"], r["lo"] + SPELLED)), lambda n: n.cast("string"))
        return F.when(r["hi"] - r["lo"] < SPELLED, every).otherwise(F.array(F.concat_ws("-", r["lo"].cast("string"), r["hi"].cast("string"))))

    return F.array_join(F.flatten(F.transform(found, part)), separator)


def expand_numbers(token: Column) -> Column:
    """'[1-3,5]' to [1,2,3,5]: every number of the marker; null if they exceed `MOST_NUMBERS`."""
    return expanded(ranges(token))


def expanded(found: Column) -> Column:
    """Every number of the ranges; null if they are more than `MOST_NUMBERS`, as a row cannot hold them."""
    wide = F.aggregate(found, F.lit(0).cast("double"), lambda n, r: n + (r["hi"].cast("double") - r["lo"].cast("double") + 1))
    return F.when(wide <= MOST_NUMBERS, F.flatten(F.transform(found, lambda r: F.sequence(r["lo"], r["hi"]))))


def citation_tokens(text: Column) -> Column:
    """Markers of one paragraph in order: bracket groups, and superscript numbers that are not mathematics.

    The entry number at the start of a reference line is not a marker.
    """
    sup = packs.SUPERSCRIPTS
    near = packs.MATH_NEIGHBOURS.replace("]", r"\]").replace("-", r"\-")
    pattern = cs(rf"{packs.CITATION_BRACKET}|(?<![\p{{L}}\p{{N}}{near}])[{sup}]{{1,3}}(?![%{near}{sup}])")
    body = F.regexp_replace(text, cs(r"^\s*\[\s*\d+\s*\]"), "")
    found = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), lambda m: F.translate(m, sup, packs.PLAIN_DIGITS))
    return F.when(text.rlike(rf"[\[{sup}]"), found).when(text.isNotNull(), F.array().cast("array<string>"))


# --- the per-document frame --------------------------------------------------

def block_kind(text: Column) -> Column:
    return F.when(is_blank(text), "blank").when(text.contains("![") & text.rlike(r"^\s*!\["), "image").when(text.contains(" | "), "table").otherwise("para")


def _paragraphs(blocks: Column) -> Column:
    kept = F.transform(
        F.filter(blocks, lambda b: b["kind"] == "para"),
        lambda b: F.struct(b["idx"].alias("para_idx"), b["text"].alias("text"), b["style"].alias("style"), strip(b["text"]).alias("s")),
    )

    def told(p):
        styled = (p["style"] == "Title") | p["style"].startswith("Heading")
        # a step of its own, so that the patterns are tried once, not once per field
        return p.withField("styled", styled).withField("reason", F.when(styled, "style").otherwise(heading_reason(p["s"])))

    def build(p):
        styled, reason = p["styled"], p["reason"]
        return F.struct(
            p["para_idx"].alias("para_idx"),
            p["text"].alias("text"),
            F.when(reason.isNotNull() & ~styled & (p["style"] == "Normal"), "HeuristicHeading").otherwise(p["style"]).alias("style"),
            reason.isNotNull().alias("is_heading"),
            reason.alias("reason"),
            F.when(styled, style_level(p["style"])).when(reason.isNotNull(), F.coalesce(numbering_level(p["s"]), F.lit(1))).alias("level"),
        )

    return F.transform(F.transform(kept, told), build)


def _tables(blocks: Column, paras: Column) -> Column:
    """Table grids.  The k-th start of a run of table lines pairs with the k-th end, so rows are slices."""

    def at(i):
        return F.get(blocks, i)["kind"]

    pos = F.sequence(F.lit(0), F.size(blocks) - 1)
    starts = F.filter(pos, lambda i: (at(i) == "table") & ((i == 0) | (at(i - 1) != "table")))
    ends = F.filter(pos, lambda i: (at(i) == "table") & ~F.coalesce(at(i + 1) == "table", F.lit(False)))
    none = F.lit(None)

    def shape(t, k):
        lines = F.slice(blocks, t["lo"] + 1, t["hi"] - t["lo"] + 1)
        rows = F.transform(lines, lambda b: F.transform(F.split(strip(b["text"]), r" \| "), strip))
        idx = F.get(blocks, t["lo"])["idx"]
        before = F.try_element_at(F.filter(paras, lambda p: p["para_idx"] < idx), F.lit(-1))
        return F.struct(k.alias("tbl_idx"), rows.alias("raw"), F.array_max(F.transform(rows, lambda r: F.size(r))).alias("n_cols"), before.alias("before"))

    def build(t):
        first = F.filter(F.get(t["raw"], F.lit(0)), lambda c: c != "")
        caption = strip(t["before"]["text"])
        return F.struct(
            t["tbl_idx"].alias("tbl_idx"),
            F.when(caption.rlike(ci(packs.TABLE_CAPTION_START)), caption).otherwise("").alias("caption"),
            F.transform(t["raw"], lambda r: F.concat(r, F.array_repeat(none.cast("string"), t["n_cols"] - F.size(r)))).alias("rows"),
            F.when((F.size(t["raw"]) >= 2) & (F.size(first) > 0) & ~F.exists(first, lambda c: c.rlike(r"\d")), 1).otherwise(0).alias("header_rows"),
            F.size(t["raw"]).alias("n_rows"),
            t["n_cols"].alias("n_cols"),
            F.coalesce(t["before"]["para_idx"], F.lit(0)).alias("anchor"),
        )

    return F.transform(F.transform(F.arrays_zip(starts.alias("lo"), ends.alias("hi")), shape), build)


def _images(blocks: Column, paras: Column) -> Column:
    def is_caption(p):
        return strip(p["text"]).rlike(ci(packs.CAPTION_START))

    def build(b, k):
        ahead = F.filter(paras, lambda p: p["para_idx"].between(b["idx"] + 1, b["idx"] + packs.CAPTION_LOOKAHEAD) & is_caption(p))
        behind = F.filter(paras, lambda p: p["para_idx"].between(b["idx"] - packs.CAPTION_LOOKBEHIND, b["idx"] - 1) & is_caption(p))
        caption = F.coalesce(F.try_element_at(ahead, F.lit(1)), F.try_element_at(behind, F.lit(-1)))
        path = F.regexp_extract(b["text"], r"\]\(([^)\s]+)", 1)
        ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
        return F.struct(
            k.alias("img_idx"),
            path.alias("path"),
            F.when(ext == "jpg", "image/jpeg").otherwise(F.concat(F.lit("image/"), ext)).alias("media_type"),
            F.coalesce(strip(caption["text"]), F.lit("")).alias("caption"),
            caption["para_idx"].alias("caption_para"),
            nearest_paragraph(paras, b["idx"]).alias("anchor"),
        )

    return F.transform(F.filter(blocks, lambda b: b["kind"] == "image"), build)


def nearest_paragraph(paras: Column, idx: Column) -> Column:
    """As-of: last paragraph at or before idx, else the first one, else 0."""
    before = F.try_element_at(F.filter(paras, lambda p: p["para_idx"] <= idx), F.lit(-1))
    return F.coalesce(before["para_idx"], F.try_element_at(paras, F.lit(1))["para_idx"], F.lit(0))


def _references(paras: Column) -> Column:
    def entries(start):
        tail = F.filter(paras, lambda p: p["para_idx"] > start)
        numbered = F.transform(tail, lambda p: F.struct(reference_number(p["text"]).alias("number"), strip(p["text"]).alias("text"), p["para_idx"].alias("para_idx")))
        return F.filter(numbered, lambda r: r["number"].isNotNull())

    # the heading is looked for once, as an element of its own; within the condition it would be once per paragraph
    start = F.array_min(F.transform(F.filter(paras, lambda p: p["is_heading"] & is_reference_heading(p["text"])), lambda p: p["para_idx"]))
    found = F.get(F.transform(F.array(start), entries), F.lit(0))
    return F.coalesce(found, F.array().cast("array<struct<number:bigint,text:string,para_idx:int>>"))


def _citations(paras: Column, known: Column) -> Column:
    marks = F.flatten(
        F.transform(
            paras,
            lambda p: F.transform(
                citation_tokens(p["text"]),
                lambda m: F.struct(p["para_idx"].alias("para_idx"), m.alias("marker"), ranges(m).alias("numbers")),
            ),
        )
    )
    def told(known):
        return F.transform(
            F.filter(marks, lambda m: F.size(m["numbers"]) > 0),
            lambda m, i: F.struct(
                i.alias("cite_idx"),
                m["para_idx"].alias("para_idx"),
                m["marker"].alias("marker"),
                m["numbers"].alias("numbers"),
                outside(m["numbers"], known).alias("unresolved"),
            ),
        )

    return F.get(F.transform(F.array(known), told), F.lit(0))  # the known numbers are listed once, not once per marker


def row_text(row: Column) -> Column:
    return F.array_join(F.filter(row, lambda c: c.isNotNull() & (c != "")), " | ")


def frame(blocks: DataFrame) -> DataFrame:
    """doc_id, source, paras, tables, images, refs (all entries, last wins), cites, table_rows."""
    kinds = blocks.withColumn(
        "blocks",
        F.transform("blocks", lambda b: F.struct(b["idx"].alias("idx"), b["text"].alias("text"), b["style"].alias("style"), F.when((b["style"] == "Title") | b["style"].startswith("Heading"), F.when(is_blank(b["text"]), "blank").otherwise("para")).otherwise(block_kind(b["text"])).alias("kind"))),
    )
    b, p = F.col("blocks"), F.col("paras")
    out = kinds.withColumn("paras", _paragraphs(b))
    out = out.withColumns({"tables": _tables(b, p), "images": _images(b, p), "refs": _references(p)})
    known = F.transform("refs", lambda r: r["number"])
    rows = F.flatten(F.transform("tables", lambda t: F.transform(t["rows"], lambda r: F.struct(t["anchor"].alias("para_idx"), row_text(r).alias("text")))))
    return out.withColumns({"cites": _citations(p, known), "table_rows": F.filter(rows, lambda r: r["text"] != "")}).drop("blocks")


# --- flat tables -------------------------------------------------------------

def paragraphs(fr: DataFrame) -> DataFrame:
    return unnest(fr, "paras", "doc_id")


def sentences(fr: DataFrame) -> DataFrame:
    return unnest(unnest(fr, "paras", "doc_id").select("doc_id", "para_idx", "text"), sentence_spans(F.col("text")), "doc_id", "para_idx")


def sections(fr: DataFrame) -> DataFrame:
    return paragraphs(fr).filter("is_heading").select(
        "doc_id",
        "para_idx",
        strip(F.col("text")).alias("title"),
        "level",
        F.when(F.col("reason") == "style", 1.0).otherwise(0.7).alias("confidence"),
        (F.col("reason") != "style").alias("needs_review"),
    )


def section_extent(fr: DataFrame) -> DataFrame:
    """Each body paragraph with the heading it stands under and that section's exclusive end.

    Sections are slices between consecutive heading positions: linear, no window, no shuffle.
    """
    size = F.size("paras")
    heads = F.filter(F.sequence(F.lit(0), size), lambda i: (i < size) & F.get("paras", i)["is_heading"])
    spans = F.transform(
        F.concat(F.array(F.lit(-1)), heads),
        lambda h, k: F.struct(h.alias("lo"), F.coalesce(F.get(F.col("heads"), k), size).alias("hi")),
    )
    return (
        fr.select("doc_id", F.transform("paras", lambda p: F.struct(p["para_idx"].alias("para_idx"), p["is_heading"].alias("is_heading"))).alias("paras"))
        .withColumn("heads", heads)
        .select(
            "doc_id",
            F.explode_outer(
                F.flatten(
                    F.transform(
                        spans,
                        lambda s: F.transform(
                            F.slice("paras", s["lo"] + 2, s["hi"] - s["lo"] - 1),
                            lambda p: F.struct(
                                p["para_idx"].alias("para_idx"),
                                F.when(s["lo"] >= 0, F.get("paras", s["lo"])["para_idx"]).alias("section_idx"),
                                F.get("paras", s["hi"])["para_idx"].alias("section_end"),
                            ),
                        ),
                    )
                )
            ).alias("u"),
        )
        .select("doc_id", "u.*")
        .filter(F.col("para_idx").isNotNull())
    )


def tables(fr: DataFrame) -> DataFrame:
    return unnest(fr, "tables", "doc_id")


def images(fr: DataFrame) -> DataFrame:
    return unnest(fr, "images", "doc_id")


def citation_ranges(fr: DataFrame) -> DataFrame:
    """One row per marker; `numbers` and `unresolved` are ranges, whatever their width."""
    return unnest(fr, "cites", "doc_id")


def citations(fr: DataFrame) -> DataFrame:
    """One row per marker with every number written out.  A range wider than an array can hold gives null for its marker's
    numbers; its ends are in `citation_ranges`."""
    return citation_ranges(fr).withColumns({c: expanded(F.col(c)) for c in ("numbers", "unresolved")})


def references(fr: DataFrame) -> DataFrame:
    """One row per (document, number); the last entry of a number wins."""
    entries = unnest(fr, "refs", "doc_id")
    return entries.groupBy("doc_id", "number").agg(F.max_by(F.struct("text", "para_idx"), "para_idx").alias("e")).select("doc_id", "number", "e.*")


def unit_array() -> Column:
    """The review units of a frame's row: paragraphs, then table rows."""
    return F.concat(
        F.transform("paras", lambda p: F.struct(p["para_idx"].alias("para_idx"), p["text"].alias("text"), p["is_heading"].alias("is_heading"), F.lit("paragraph").alias("kind"))),
        F.transform("table_rows", lambda r: F.struct(r["para_idx"].alias("para_idx"), r["text"].alias("text"), F.lit(False).alias("is_heading"), F.lit("table").alias("kind"))),
    )


def units(fr: DataFrame) -> DataFrame:
    """Review units as rows, each with a paragraph anchor and its position."""
    return unnest(fr, unit_array(), "doc_id", pos="pos")


def counters(fr: DataFrame) -> DataFrame:
    """Per-document counters and parse warnings (codes)."""
    heuristic = F.size(F.filter("paras", lambda p: p["is_heading"] & (p["reason"] != "style")))
    n = {
        "paragraph_count": F.size("paras"),
        "section_count": F.size(F.filter("paras", lambda p: p["is_heading"])),
        "heuristic_headings": heuristic,
        "table_count": F.size("tables"),
        "table_rows": F.aggregate("tables", F.lit(0), lambda a, t: a + t["n_rows"]),
        "image_count": F.size("images"),
        "reference_count": F.size(F.array_distinct(F.transform("refs", lambda r: r["number"]))),
        "citation_count": F.size("cites"),
        "language": language(F.array_join(F.transform("paras", lambda p: p["text"]), "\n")),
    }
    out = fr.select("doc_id", *[c.alias(k) for k, c in n.items()])
    warn = F.array_compact(
        F.array(
            F.when(F.col("section_count") == 0, "no_sections"),
            F.when(F.col("heuristic_headings") > 0, "heuristic_headings"),
            F.when(F.col("image_count") > 0, "images_not_read"),
            F.when(F.col("table_count") > 0, "tables_moved"),
            F.when(F.col("reference_count") == 0, "no_references"),
        )
    )
    return out.withColumn("warnings", warn)


def labelled_blocks(fr: DataFrame) -> DataFrame:
    """Paragraphs with tables put back after their anchor: (doc_id, para_idx, kind, tbl_idx, line)."""
    label = lambda idx: F.concat(F.lit("[P"), idx.cast("string"), F.lit("] "))
    paras = F.transform(
        "paras",
        lambda p: F.struct(p["para_idx"].alias("para_idx"), F.lit(0).alias("kind"), F.lit(-1).alias("tbl_idx"), F.concat(label(p["para_idx"]), strip(p["text"])).alias("line")),
    )
    grids = F.transform(
        F.filter("tables", lambda t: F.exists("paras", lambda p: p["para_idx"] == t["anchor"])),
        lambda t: F.struct(
            t["anchor"].alias("para_idx"),
            F.lit(1).alias("kind"),
            t["tbl_idx"].alias("tbl_idx"),
            F.concat(
                label(t["anchor"]),
                F.when(t["caption"] != "", F.concat(F.lit("[表] "), t["caption"], F.lit("\n"))).otherwise("[表]\n"),
                F.array_join(F.transform(t["rows"], lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n"),
            ).alias("line"),
        ),
    )
    return unnest(fr, F.concat(paras, grids), "doc_id")
