"""Method-fact extraction, anchors and paper type, all inside the document row."""

import re
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paperlens import packs
from paperlens.sources.intake import unnest
from paperlens.functions.text import HAN, cs, gated, needs_han, seeds, sentences, shortened, signal, signal_pattern, strip, triggers

ELEMENT = "array<struct<type:string,value:string,para_idx:int,sent_idx:int,confidence:double,in_table:boolean>>"


def folded(pattern: str) -> str:
    """The pattern in lower case, but for escapes: \\D, \\S, \\W, \\B and \\p{Lu} keep their meaning."""
    return re.sub(r"(\\(?:[pP]\{[^}]*\}|.))|([^\\]+)", lambda m: m[1] or m[2].lower(), pattern, flags=re.DOTALL)


#: Signals that are looked for in the whole text of a document.  Each has a bit in the marks of a text, the types have the next ones.
BODY_SIGNALS = ["named_test", "training", "ml_evidence", "multi_comparison", "multi_model", "multi_baseline", "single_baseline", "class_task", "class_metric", "hyper_search"]
KIND_SIGNALS = ["review", "strong_review", "empirical"]
SIGNAL_BITS = {n: 1 << i for i, n in enumerate([*BODY_SIGNALS, *KIND_SIGNALS])}
ALL = -1
#: Size of the table from a text to what it announces.
SLOTS = 4096


def _bits(patterns):
    return {k: 1 << len(SIGNAL_BITS) + i for i, k in enumerate(patterns)}


def marked(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(F.lit(bits).cast("bigint")) != 0


def marks(text: Column, patterns=packs.ELEMENT_PATTERNS) -> Column:
    """The bits of the signals and types that the text may hold, or with one of its lines; what has no bit does not hit.

    Every match holds a plain text on one line.  One pass over the text, lower-cased once, finds out whether there is any, another one
    which.  Four letters count as letters of ASCII when case is folded; where one is, everything is tried.
    """
    kinds = [(SIGNAL_BITS[n], [folded(packs.SIGNALS[n][0])]) for n in SIGNAL_BITS] + [(bit, list(map(folded, patterns[k]))) for k, bit in _bits(patterns).items()]
    every = sum((ps for _, ps in kinds), [])
    found, (seed, wide) = triggers(dict(kinds)) if len(kinds) < 64 else None, seeds(every)
    if found is None or seed is None:
        return F.when(text.isNotNull(), F.lit(ALL).cast("bigint"))
    pattern, table = found
    slots = [0] * SLOTS  # texts that share a slot announce what either does
    for t, bits in table.items():
        slots[zlib.crc32(t.encode()) % SLOTS] |= reduce(int.__or__, bits)
    masks = F.expr(f"array({', '.join(f'{m}L' for m in slots)})")
    none = F.lit(0).cast("bigint")
    slot = lambda t: (F.crc32(t) % SLOTS).cast("int")
    which = lambda x: F.aggregate(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), none, lambda m, t: m.bitwiseOR(F.get(masks, slot(t))))

    def of(x):
        beyond = F.octet_length(x["text"]) > F.length(x["text"])
        return (
            F.when(beyond & x["text"].rlike("[ıİKſ]"), F.lit(ALL).cast("bigint"))
            .when((beyond & x["text"].rlike(f"{HAN[:-1]}{wide}]")) | x["low"].rlike(seed), which(x["low"]))
            .when(x["text"].isNotNull(), none)
        )

    return F.get(F.transform(F.array(F.struct(text.alias("text"), F.lower(text).alias("low"))), of), F.lit(0))


def tag(text: Column, patterns=packs.ELEMENT_PATTERNS, mask: Column | None = None) -> Column:
    """Types whose pattern set hits the text; each type at most once, in pack order.

    The text is lower-cased once instead of once per pattern, and only the types that its marks announce are tried: the same
    hits for a fraction of the work.  `mask` holds the marks where they are known.
    """

    def kinds(t):
        hits = [F.when(marked(t["mask"], bit) & t["low"].rlike(cs(gated(list(map(folded, patterns[k]))))), F.lit(k)) for k, bit in _bits(patterns).items()]
        some = marked(t["mask"], sum(_bits(patterns).values()))
        return F.when(some, F.array_compact(F.array(*hits))).otherwise(F.array().cast("array<string>"))

    given = F.array(F.struct(F.lower(text).alias("low"), (marks(text, patterns) if mask is None else mask).alias("mask")))
    return F.get(F.transform(given, kinds), F.lit(0))


def _halves(patterns):
    """The folded patterns that need a Han character, and the others."""
    return [{k: [folded(p) for p in ps if needs_han(p) == han] for k, ps in patterns.items()} for han in (True, False)]


def _worth(low, half):
    """Does a pattern of the half hit?  Most texts fail on what each of its matches needs."""
    every = sum(half.values(), [])
    if not every:
        return F.lit(False)
    hit = low.rlike(cs(gated(every)))
    if all(map(needs_han, every)):
        return low.rlike(HAN) & hit
    seed, wide = seeds(every)
    return hit if seed is None or wide else low.rlike(seed) & hit


def has_vocabulary(text: Column, patterns=packs.ELEMENT_PATTERNS) -> Column:
    """Does any pattern hit the text?  What hits a sentence hits its paragraph, as no pattern looks beyond its match."""
    return F.exists(F.transform(F.array(text), lambda x: F.lower(x)), lambda x: reduce(lambda a, b: a | b, [_worth(x, half) for half in _halves(patterns)]))


def with_marks(fr: DataFrame, patterns=packs.ELEMENT_PATTERNS) -> DataFrame:
    """Adds ``marks``, those of each paragraph and then of each table row."""
    texts = F.concat(F.transform("paras", lambda p: p["text"]), F.transform("table_rows", lambda r: r["text"]))
    return fr.withColumn("marks", F.transform(texts, lambda t: marks(t, patterns)))


def _lines(with_rows: bool) -> Column:
    """The paragraphs, and the table rows, one to a line; those without a mark are shortened."""
    texts = F.transform("paras", lambda p: p["text"])
    texts = F.concat(texts, F.transform("table_rows", lambda r: r["text"])) if with_rows else texts
    masks = F.col("marks") if with_rows else F.slice("marks", 1, F.size("paras"))
    return F.array_join(F.zip_with(texts, masks, lambda t, m: shortened(t, m != 0)), "\n")


def announced() -> Column:
    """The marks of all lines of the document in one."""
    return F.aggregate("marks", F.lit(0).cast("bigint"), lambda a, m: a.bitwiseOR(F.coalesce(m, F.lit(0).cast("bigint"))))


def _tagged(unit: Column, in_table: bool, patterns) -> Column:
    return F.transform(
        tag(unit["text"], patterns, unit["mask"]),
        lambda t: F.struct(
            t.alias("type"),
            F.left(strip(unit["text"]), F.lit(160)).alias("value"),
            unit["para_idx"].alias("para_idx"),
            unit["sent_idx"].alias("sent_idx"),
            F.lit(0.8).alias("confidence"),
            F.lit(in_table).alias("in_table"),
        ),
    )


def with_elements(fr: DataFrame, patterns=packs.ELEMENT_PATTERNS) -> DataFrame:
    """Adds ``elements``: structural ones first, then sentence by sentence, then table rows."""

    def structural(name, arr, what, first_para):
        return F.when(
            F.size(arr) > 0,
            F.array(
                F.struct(
                    F.lit(name).alias("type"),
                    F.concat(F.size(arr).cast("string"), F.lit(what)).alias("value"),
                    first_para.alias("para_idx"),
                    F.lit(None).cast("int").alias("sent_idx"),
                    F.lit(1.0).alias("confidence"),
                    F.lit(False).alias("in_table"),
                )
            ),
        ).otherwise(F.array().cast(ELEMENT))

    numbers = F.array_distinct(F.transform("refs", lambda r: r["number"]))
    first_ref = F.try_element_at(F.filter("refs", lambda r: r["number"] == F.get("refs", F.lit(0))["number"]), F.lit(-1))["para_idx"]
    fr = with_marks(fr, patterns)
    some = lambda u: marked(u["mask"], sum(_bits(patterns).values()))
    unit = lambda u, m: F.struct(u["para_idx"], F.lit(None).cast("int").alias("sent_idx"), u["text"], m.alias("mask"))
    n = F.size("paras")
    told = F.filter(F.zip_with("paras", F.slice("marks", 1, n), unit), some)

    def spoken_in(p):
        def of(ss):
            own = lambda s: F.when(F.size(ss) == 1, p["mask"]).otherwise(marks(s, patterns))
            return F.transform(ss, lambda s, i: F.struct(p["para_idx"].alias("para_idx"), i.alias("sent_idx"), s.alias("text"), own(s).alias("mask")))

        return F.get(F.transform(F.array(sentences(p["text"])), of), F.lit(0))

    spoken = F.flatten(F.transform(told, spoken_in))
    rows = F.filter(F.zip_with("table_rows", F.slice("marks", n + 1, F.size("table_rows")), unit), some)
    return fr.withColumn(
        "elements",
        F.concat(
            structural("citation", F.col("cites"), " 个引用角标", F.get("cites", F.lit(0))["para_idx"]),
            structural("reference_list", numbers, " 条参考文献", first_ref),
            F.flatten(F.transform(spoken, lambda u: _tagged(u, False, patterns))),
            F.flatten(F.transform(rows, lambda u: _tagged(u, True, patterns))),
        ),
    )


def element_rows(tagged: DataFrame) -> DataFrame:
    return unnest(tagged, "elements", "doc_id", pos="elem_seq")


def has(kind: str) -> Column:
    return F.exists("elements", lambda e: e["type"] == kind)


def first_of(kind: str) -> Column:
    return F.try_element_at(F.filter("elements", lambda e: e["type"] == kind), F.lit(1))


def anchor_for(*kinds: str) -> Column:
    """Paragraph of the first element of the first type present, in priority order."""
    return F.coalesce(*[F.col("first")[k] for k in kinds])


def with_features(tagged: DataFrame, types=(*packs.ELEMENT_TYPES, "citation", "reference_list")) -> DataFrame:
    """Adds ``first`` (struct type -> first anchor paragraph, null when absent) and the document-level signals."""
    if "marks" not in tagged.columns:
        tagged = with_marks(tagged)
    out = tagged.withColumns({"first": F.struct(*[first_of(t)["para_idx"].alias(t) for t in types]), "body": _lines(True), "_said": announced()})
    out = out.withColumn("sig", F.struct(*[(marked(F.col("_said"), SIGNAL_BITS[n]) & signal(F.col("body"), n)).alias(n) for n in BODY_SIGNALS]))
    present = {t: F.col("first")[t].isNotNull() for t in types}
    trains = present["data_split"] | F.col("sig.training")
    ai = present["novel_module"] | (present["metric"] & F.col("sig.ml_evidence"))
    intro = F.exists("paras", lambda p: p["is_heading"] & signal(strip(p["text"]), "intro"))
    return out.withColumns({"trains_model": trains, "ai_empirical": ai, "has_intro": intro}).drop("body", "_said")


# --- anchors ------------------------------------------------------------------

def first_para(cond) -> Column:
    return F.try_element_at(F.filter("paras", cond), F.lit(1))["para_idx"]


def last_para(cond) -> Column:
    return F.try_element_at(F.filter("paras", cond), F.lit(-1))["para_idx"]


def section_anchor(name: str) -> Column:
    """First matching body paragraph inside a matching section.

    A state machine over the ordered paragraphs: a matching heading opens the section, a
    non-matching one of styled level <= 1 (unstyled counts as 0) closes it.
    """
    section, text = packs.SECTION_ANCHORS[name]
    outline = F.regexp_extract

    def step(acc, p):
        level = F.coalesce(outline(p["style"], r"^Heading (\d+)$", 1).try_cast("int"), F.lit(0))
        opens = p["text"].rlike(cs(section))
        hit = acc["inside"] if text is None else acc["inside"] & p["text"].rlike(cs(text))
        state = lambda inside, at: F.struct(inside.alias("inside"), at.alias("at"))
        return (
            F.when(acc["at"].isNotNull(), acc)
            .when(p["is_heading"], state(opens | (acc["inside"] & (level > 1)), acc["at"]))
            .when(hit, state(acc["inside"], p["para_idx"]))
            .otherwise(acc)
        )

    start = F.struct(F.lit(False).alias("inside"), F.lit(None).cast("int").alias("at"))
    return F.aggregate("paras", start, step, lambda acc: acc["at"])


def first_body_anchor(name: str, skip_first: int = 3) -> Column:
    return first_para(lambda p: ~p["is_heading"] & (p["para_idx"] >= skip_first) & signal(p["text"], name))


def last_body_anchor(name: str) -> Column:
    return last_para(lambda p: ~p["is_heading"] & ~p["text"].rlike(cs(r"^\s*\[\d+\]")) & signal(p["text"], name))


# --- paper type -----------------------------------------------------------------

def paper_type(fr: DataFrame) -> DataFrame:
    """Adds review_hits, strong_hits, empirical_hits, title_strong, title_weak, paper_type."""

    def hits(name):
        return F.when(marked(F.col("_said"), SIGNAL_BITS[name]), F.regexp_count("_spoken", F.lit(signal_pattern(name)))).when(F.col("_said").isNotNull(), 0)

    titles = F.array_join(F.slice(F.transform(F.filter("paras", lambda p: p["is_heading"]), lambda p: strip(p["text"])), 1, 5), " ")
    if "marks" not in fr.columns:
        fr = with_marks(fr)
    out = fr.withColumns({"_spoken": _lines(False), "_said": announced()}).withColumns(
        {
            "review_hits": hits("review"),
            "strong_hits": hits("strong_review"),
            "empirical_hits": hits("empirical"),
            "title_strong": signal(titles, "strong_review"),
            "title_weak": signal(titles, "review"),
        }
    )
    c = F.col
    review = (
        c("title_strong")
        | (c("strong_hits") >= 2)
        | (c("title_weak") & (c("empirical_hits") <= 3))
        | ((c("review_hits") >= 3) & (c("empirical_hits") <= c("review_hits")))
    )
    return out.withColumn("paper_type", F.when(review, "review").when(c("empirical_hits") >= 3, "empirical").otherwise("unknown")).drop("_spoken", "_said")


def applicable(item_id: Column, kind: Column) -> Column:
    return (kind != "review") | item_id.isin(packs.REVIEW_ALLOWED)
