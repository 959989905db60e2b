"""Numeric self-consistency and figure/table-text consistency, inside the document row."""

from pyspark.sql import Column, DataFrame, functions as F

from paperlens import packs
from paperlens.functions.text import HAN, ci, cs, strip, zh_number
from paperlens.sources.intake import unnest

CHECK = "array<struct<item_id:string,code:string,para_idx:int,arg0:string,arg1:string,parts:string,quote:string>>"


def _check(item, code, para, arg0, arg1=None, parts=None, quote=None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    return F.struct(
        F.lit(item).alias("item_id"),
        F.lit(code).alias("code"),
        para.alias("para_idx"),
        arg0.cast("string").alias("arg0"),
        text(arg1).alias("arg1"),
        text(parts).alias("parts"),
        text(quote).alias("quote"),
    )


# --- numeric checks on one unit of text ---------------------------------------

#: Characters looked at on either side of a percentage, and as many segments as surely hold them.
NEAR = 20
NEAR_SEGMENTS = NEAR // 2 + 1

def plain(number: Column) -> Column:
    """A double as text, whole numbers without their point."""
    return F.regexp_replace(number.cast("string"), r"\.0$", "")


def bad_ratio(text: Column) -> Column:
    """total and parts of the first a:b[:c...] chain that is neither parts of 10 nor of 100; null when fine."""

    def chain(m):
        parts = F.transform(F.split(m, r"\s*[:：]\s*"), lambda x: strip(x).cast("int"))
        return F.struct(F.aggregate(parts, F.lit(0), lambda a, x: a + x).alias("total"), F.array_join(parts.cast("array<string>"), ":").alias("parts"))

    chains = F.transform(F.regexp_extract_all(text, F.lit(cs(packs.RATIO_CHAIN)), F.lit(1)), chain)
    bad = F.filter(chains, lambda s: (s["total"] > packs.RATIO_PARTS) & (s["total"] != packs.RATIO_PERCENT))
    return F.when(text.rlike(packs.SPLIT_CONTEXT), F.try_element_at(bad, F.lit(1)))


def bad_percent(text: Column) -> Column:
    """total and parts of the first run of adjacent split shares whose sum is not about 100; null when fine.

    regexp functions return no positions, so the text is taken as segments: a percentage with the text behind it.  As a
    percentage has two characters at least, `NEAR_SEGMENTS` of them hold all that is looked at on either side, and a run is
    two positions, not a list that grows: work is linear in the percentages of a unit.
    A percentage that is not a share always ends a run, because connectors hold no digits.
    """
    p = ci(packs.PERCENT)
    hits = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    values = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda v: v.cast("double"))
    found = F.filter(F.array(F.struct(hits.alias("hits"), values.alias("values"), F.split(text, p).alias("pieces"))), lambda t: F.size(t["hits"]) >= 2)
    # a second step, so that the segments are built once, not once per percentage; the first is the text before all
    whole = F.transform(
        found, lambda t: t.withField("segments", F.zip_with(F.concat(F.array(F.lit("")), t["hits"]), t["pieces"], lambda h, s: F.concat(h, s)))
    )

    def look(t):
        def share(k):
            behind = F.greatest(k + 1 - NEAR_SEGMENTS, F.lit(0))
            left = F.array_join(F.slice(t["segments"], behind + 1, k + 1 - behind), "")
            right = F.concat(F.get(t["pieces"], k + 1), F.array_join(F.slice(t["segments"], k + 3, F.lit(NEAR_SEGMENTS)), ""))
            near = F.right(left, F.lit(NEAR)).rlike(f"(?s)(?:{packs.SPLIT_CONTEXT}).{{0,{packs.SPLIT_WINDOW}}}$") | F.left(right, F.lit(NEAR)).rlike(
                f"(?s)^.{{0,{packs.SPLIT_WINDOW}}}(?:{packs.SPLIT_CONTEXT})"
            )
            return near & ~F.right(left, F.lit(packs.METRIC_WINDOW)).rlike(packs.METRIC_CONTEXT)

        steps = F.transform(
            t["values"],
            lambda v, k: F.struct(
                k.alias("k"), v.alias("v"), share(k).alias("share"), F.get(t["pieces"], k).rlike(cs(packs.PERCENT_GAP)).alias("joined")
            ),
        )
        span = "struct<first:int,n:int,sum:double>"
        run = lambda first, n, total: F.struct(first.alias("first"), n.alias("n"), total.alias("sum")).cast(span)
        state = lambda r, bad: F.struct(r.alias("run"), bad.alias("bad"))
        none = run(F.lit(0), F.lit(0), F.lit(0.0))
        off = lambda r: (r["n"] >= 2) & ~r["sum"].between(packs.PERCENT_LOW, packs.PERCENT_HIGH)
        closed = lambda s: F.coalesce(s["bad"], F.when(off(s["run"]), s["run"]))
        bad = F.aggregate(
            steps,
            state(none, F.lit(None).cast(span)),
            lambda s, x: F.when(x["share"] & x["joined"] & (s["run"]["n"] > 0), state(run(s["run"]["first"], s["run"]["n"] + 1, s["run"]["sum"] + x["v"]), s["bad"]))
            .when(x["share"], state(run(x["k"], F.lit(1), x["v"]), closed(s)))
            .otherwise(state(none, closed(s))),
            closed,
        )
        parts = lambda r: F.array_join(F.transform(F.slice(t["values"], r["first"] + 1, r["n"]), lambda v: F.concat(plain(v), F.lit("%"))), " + ")
        runs = F.filter(F.array(bad), lambda r: r.isNotNull())
        return F.try_element_at(F.transform(runs, lambda r: F.struct(F.round(r["sum"], 4).alias("total"), parts(r).alias("parts"))), F.lit(1))

    return F.when(text.rlike(packs.SPLIT_CONTEXT), F.get(F.transform(whole, look), F.lit(0)))


def bad_interval(text: Column) -> Column:
    """'point|low|high' of the first estimate outside its own 95% interval; null when fine."""
    p = ci(packs.CI_PAIR)

    def parts(m):
        g = lambda i: F.regexp_extract(m, p, i)
        lo, hi = g(3).cast("double"), g(5).cast("double")
        same = (g(2) == g(4)) & (g(4) == g(6))
        return F.struct(g(1).cast("double").alias("point"), F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi"), same.alias("same"))

    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), parts), lambda x: x["same"] & ~x["point"].between(x["lo"], x["hi"]))
    told = F.transform(found, lambda x: F.concat_ws("|", x["point"].cast("string"), x["lo"].cast("string"), x["hi"].cast("string")))
    return F.when(text.contains("95") & text.contains("%"), F.try_element_at(told, F.lit(1)))  # no estimate goes without these


def with_numeric(fr: DataFrame) -> DataFrame:
    """Adds ``numeric``: up to three results per unit, in unit order.  A result goes through a one-element array, so that
    each check is evaluated once; ``quote`` is the beginning of the unit, as reports print it."""

    def checks(u):
        quote = F.left(strip(u["text"]), F.lit(packs.CHECK_QUOTE))

        def of(result, item, code, arg0, parts):
            found = F.filter(F.array(result), lambda r: r.isNotNull())
            return F.transform(found, lambda r: _check(item, code, u["para_idx"], arg0(r), None, parts(r), quote))

        total, parts, none = (lambda r: r["total"]), (lambda r: r["parts"]), (lambda r: None)
        return F.concat(
            of(bad_ratio(u["text"]), "R-DATA-01", "RATIO_BAD", total, parts),
            of(bad_percent(u["text"]), "R-DATA-02", "PERCENT_BAD", total, parts),
            of(bad_interval(u["text"]), "R-DATA-03", "INTERVAL_BAD", lambda r: r, none),
        )

    unit = lambda u: F.struct(u["para_idx"].alias("para_idx"), u["text"].alias("text"))
    # a split is spoken of in Han characters, an interval names its 95%; a text of letters of one byte has none of the former
    splits = lambda t: (F.octet_length(t) > F.length(t)) & t.rlike(f"(?={HAN}){packs.SPLIT_CONTEXT}")
    worth = lambda t: t.rlike("[0-9]") & (splits(t) | (t.contains("95") & t.contains("%")))
    digits = F.filter(F.concat(F.transform("paras", unit), F.transform("table_rows", unit)), lambda u: worth(u["text"]))
    return fr.withColumn("numeric", F.flatten(F.transform(digits, checks)))


# --- figures and tables ---------------------------------------------------------

_ZH = packs.ZH_NUMERALS
_NOT_QUANTITY = rf"(?!\s*(?:{packs.QUANTITY_UNITS}))"
_FIG, _TAB = rf"(?<![{packs.NOT_FIGURE_PREFIX}])图", rf"(?<![{packs.NOT_TABLE_PREFIX}])表"
FIGURE_MENTION = rf"(?:{_FIG}\s*\d++|{_FIG}\s*[{_ZH}]++|附图\s*\d++|Figure\s*\d++|Fig\.?\s*\d++|{_TAB}\s*\d++|Table\s*\d++|Supplementary\s+(?:Fig|Table)){_NOT_QUANTITY}"
REFERENCE = rf"(Supplementary\s+(?:Fig(?:ure)?|Table)|附图|附表|Fig\.?|Figure|Table|{_FIG}|{_TAB})\s*(\d++|[{_ZH}]++){_NOT_QUANTITY}"
#: What every mention holds; the cases are spelled out, as folding them is what costs most.
NAMES_FIGURE = "[图表]|[Ff][Iiıİ][Gg]|[Tt][Aa][Bb]"


def bucket(kind: Column) -> Column:
    low = F.lower(kind)
    return F.when(low.startswith("supplementary"), F.when(low.contains("table"), "表").otherwise("图")).otherwise(
        F.when(low.contains("fig") | kind.contains("图"), "图").otherwise("表")
    )


def samples(text: Column) -> Column:
    """array<struct<unit,value>>: first statement of each unit; count-like units are one unit."""
    g = lambda i: F.regexp_extract_all(text, F.lit(cs(packs.SAMPLE_SIZE)), F.lit(i)).alias(f"g{i}")
    found = F.transform(
        F.arrays_zip(g(1), g(2), g(3)),
        lambda z: F.struct(
            F.when((z["g1"] != "") | z["g3"].isin(packs.COUNT_UNITS), packs.COUNT_UNIT).otherwise(z["g3"]).alias("unit"),
            F.regexp_replace(F.when(z["g1"] != "", z["g1"]).otherwise(z["g2"]), ",", "").try_cast("bigint").alias("value"),
        ),
    )
    return F.aggregate(
        found,
        F.array().cast("array<struct<unit:string,value:bigint>>"),
        lambda acc, s: F.when(F.exists(acc, lambda o: o["unit"] == s["unit"]), acc).otherwise(F.array_append(acc, s)),
    )


def with_captions(fr: DataFrame) -> DataFrame:
    """Adds ``captions`` (first paragraph of each kind and number) and ``mentions`` outside those."""

    def parse(p):
        s = strip(p["text"])
        rest = F.regexp_extract(s, ci(packs.CAPTION), 3)
        plain = (F.length(s) <= packs.CAPTION_MAX_PLAIN) & ~rest.rlike(cs(packs.CAPTION_BODY_VERB))
        ok = s.rlike(ci(packs.CAPTION)) & (rest.rlike(cs(packs.CAPTION_SEPARATOR)) | plain) & ~rest.rlike(cs(packs.CAPTION_SENTENCE_END))
        return F.when(
            ok,
            F.struct(
                bucket(F.regexp_extract(s, ci(packs.CAPTION), 1)).alias("kind"),
                zh_number(F.regexp_extract(s, ci(packs.CAPTION), 2)).alias("number"),
                p["para_idx"].alias("para_idx"),
                samples(p["text"]).alias("samples"),
            ),
        )

    worth = F.filter("paras", lambda p: p["text"].rlike(ci(packs.CAPTION)))
    parsed = F.filter(F.array_compact(F.transform(worth, parse)), lambda c: c["number"].isNotNull())
    out = fr.withColumn("_caps", parsed).withColumn(
        "captions",
        F.filter("_caps", lambda c, i: ~F.exists(F.slice("_caps", F.lit(1), i), lambda o: (o["kind"] == c["kind"]) & (o["number"] == c["number"]))),
    )
    g = lambda t, i: F.regexp_extract_all(t, F.lit(ci(REFERENCE)), F.lit(i))
    numbered = lambda t: t.rlike(NAMES_FIGURE) & t.rlike(rf"(?U)[\d{_ZH}]|(?i)supplementary")
    body = F.filter("_named", lambda p: p["text"].rlike(ci(REFERENCE)) & ~F.exists("captions", lambda c: c["para_idx"] == p["para_idx"]))
    found = F.flatten(
        F.transform(
            body,
            lambda p: F.transform(
                F.arrays_zip(g(p["text"], 1).alias("k"), g(p["text"], 2).alias("n")),
                lambda z: F.struct(bucket(z["k"]).alias("kind"), zh_number(z["n"]).alias("number"), p["para_idx"].alias("para_idx"), samples(p["text"]).alias("samples")),
            ),
        )
    )
    return out.withColumn("_named", F.filter("paras", lambda p: numbered(p["text"]))).withColumns(
        {
            "mentions": F.filter(found, lambda m: m["number"].isNotNull()),
            "figure_mentions": F.aggregate("_named", F.lit(0), lambda a, p: a + F.regexp_count(p["text"], F.lit(ci(FIGURE_MENTION)))),
        }
    ).drop("_caps", "_named")


def with_figure_checks(captioned: DataFrame) -> DataFrame:
    """Adds ``figure``: caption missing, mention without caption, sample-size conflict."""
    last = F.coalesce(F.try_element_at("paras", F.lit(-1))["para_idx"], F.lit(0))
    same = lambda a, b: (a["kind"] == b["kind"]) & (a["number"] == b["number"])
    label = lambda k: F.concat(k["kind"], k["number"].cast("string"))

    def seen(kind):
        return F.size("images") if kind == "图" else F.size("tables")

    missing = [
        F.when(
            (seen(k) > 0) & ~F.exists("captions", lambda c: c["kind"] == k),
            _check("R-FIG-01", "CAPTION_MISSING", last, F.lit(k), seen(k)),
        )
        for k in ("图", "表")
    ]
    loose = F.filter(
        "mentions",
        lambda m: ~F.exists("captions", lambda c: same(c, m)) & (F.when(m["kind"] == "图", F.size("images")).otherwise(F.size("tables")) > 0),
    )
    keys = F.array_sort(F.array_distinct(F.transform(loose, lambda m: F.struct(m["kind"].alias("kind"), m["number"].alias("number")))))
    orphans = F.transform(
        keys,
        lambda k: _check("R-FIG-01", "MENTION_UNCAPTIONED", F.try_element_at(F.filter("mentions", lambda m: same(m, k)), F.lit(1))["para_idx"], label(k)),
    )
    ordered = F.array_sort(F.transform("captions", lambda c: F.struct(c["kind"].alias("kind"), c["number"].alias("number"), c["samples"].alias("samples"))))

    def conflicts(c):
        def of(m):
            pairs = F.transform(
                m["samples"],
                lambda s: F.struct(
                    s["unit"].alias("unit"),
                    s["value"].alias("value"),
                    F.try_element_at(F.filter(c["samples"], lambda o: o["unit"] == s["unit"]), F.lit(1))["value"].alias("other"),
                ),
            )
            return F.transform(
                F.filter(pairs, lambda s: s["other"] != s["value"]),
                lambda s: _check("R-FIG-01", "SAMPLE_CONFLICT", m["para_idx"], label(c), F.concat_ws("|", s["other"].cast("string"), s["value"].cast("string"), s["unit"])),
            )

        return F.flatten(F.transform(F.filter("mentions", lambda m: same(m, c)), of))

    found = F.concat(F.array_compact(F.array(*missing)), orphans, F.flatten(F.transform(ordered, conflicts)))
    return captioned.withColumn("figure", F.when((F.size("images") > 0) | (F.size("tables") > 0), found).otherwise(F.array().cast(CHECK)))


def check_rows(df: DataFrame, column: str) -> DataFrame:
    return unnest(df, column, "doc_id", pos="seq")
