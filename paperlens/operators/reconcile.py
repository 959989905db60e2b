"""Reconciling rule findings with model verdicts that arrive as a table."""

from pyspark.sql import DataFrame, Window, functions as F

from paperlens import packs
from paperlens.functions.text import squeeze
from paperlens.operators.elements import applicable
from paperlens.operators.structure import unit_array
from paperlens.sources.intake import unnest


def normalize_ids(verdicts: DataFrame, items=packs.CHECKLIST) -> DataFrame:
    """raw_id -> item_id: exact id, else by title, else 'unknown'; only items a model may judge."""
    sent = [r for r in items if r[3] != "rule"]
    by_title = F.create_map(*[F.lit(x) for r in sent for x in (r[4], r[0])])
    exact = F.col("raw_id").isin([r[0] for r in sent])
    return verdicts.withColumn("item_id", F.when(exact, F.col("raw_id")).otherwise(F.coalesce(F.try_element_at(by_title, F.col("raw_id")), F.lit("unknown"))))


def restrict(verdicts: DataFrame, kinds: DataFrame) -> DataFrame:
    """Items that do not apply to the document's paper type become 'unknown'.  kinds(doc_id, paper_type)."""
    item = F.when(applicable(F.col("item_id"), F.coalesce("paper_type", F.lit(""))), F.col("item_id")).otherwise("unknown")
    return verdicts.join(kinds.select("doc_id", "paper_type"), "doc_id", "left").withColumn("item_id", item).drop("paper_type")


def dual_check(first: DataFrame, second: DataFrame) -> DataFrame:
    """Disagreement with a second verdict set turns the verdict to uncertain; the last second verdict counts."""
    other = second.groupBy("doc_id", "item_id").agg(F.max_by("verdict", "mseq").alias("dual_verdict"))
    j = first.join(other, ["doc_id", "item_id"], "left")
    clash = F.col("dual_verdict").isNotNull() & (F.col("dual_verdict") != F.col("verdict"))
    return j.withColumns(
        {
            "verdict": F.when(clash, "uncertain").otherwise(F.col("verdict")),
            "dual_check": F.when(clash, "disagree"),
            "dual_verdict": F.when(clash, F.col("dual_verdict")),
        }
    )


def tagged_verdicts(verdicts: DataFrame | None, doc_ids: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """Every verdict row (``extra``) and every image reading (``reading``), plus one carrier row per document with the
    per-item summary of its verdicts (``folds``).

    The summary is aggregated map-side to at most one entry per known item, so a document with a
    flood of verdict rows never has them gathered in one group.  Since every document has a carrier,
    the plan can use an inner join on doc_id, which adaptive execution may split on either side.
    """
    rows = doc_ids
    if verdicts is not None:
        cols = ["item_id", "mseq", "verdict", "severity", "headline", "description", "suggestion", "dual_check", "dual_verdict"]
        for c in ("dual_check", "dual_verdict"):
            if c not in verdicts.columns:
                verdicts = verdicts.withColumn(c, F.lit(None).cast("string"))
        folds = (
            verdicts.groupBy("doc_id", "item_id")
            .agg(
                F.max_by("verdict", "mseq").alias("llm_verdict"),
                F.min_by(F.nullif("description", F.lit("")), F.when(F.col("description") != "", F.col("mseq"))).alias("description"),
                F.min_by(F.nullif("suggestion", F.lit("")), F.when(F.col("suggestion") != "", F.col("mseq"))).alias("suggestion"),
            )
            .groupBy("doc_id")
            .agg(F.collect_list(F.struct("item_id", "llm_verdict", "description", "suggestion")).alias("folds"))
        )
        carriers = doc_ids.join(folds, "doc_id", "left")
        rows = verdicts.select("doc_id", F.struct(*cols).alias("extra")).unionByName(carriers, allowMissingColumns=True)
    if readings is not None:
        rows = rows.unionByName(readings.select("doc_id", F.struct("img_idx", "values", "concern").alias("reading")), allowMissingColumns=True)
    return rows


def pending_quotes(findings: DataFrame, max_items=packs.VERIFY_MAX_ITEMS) -> DataFrame:
    """The first ``max_items`` model problems without an anchor, per document (the feature's own limit).

    Spark turns row_number() <= n into a per-partition limit before the shuffle, so a hot
    document sends at most n rows per task.
    """
    waiting = findings.filter((F.col("engine") == "llm") & (F.col("verdict") == "problem") & (F.size("anchors") == 0))
    w = Window.partitionBy("doc_id").orderBy("seq")
    return waiting.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max_items)


def quote_supports(quote, item_id):
    words = F.create_map(*[x for k, ws in packs.ITEM_KEYWORDS.items() for x in (F.lit(k), F.array(*[F.lit(w.lower()) for w in ws]))])
    return F.coalesce(F.exists(F.try_element_at(words, item_id), lambda w: F.lower(quote).contains(w)), F.lit(False))


def asked_quotes(pending: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotes that name the topic of their finding, with the form that is looked for (`needle`).

    pending(doc_id, seq, rn, item_id) meets quotes(doc_id, rn, quote); `position` orders several quotes of a finding.
    """
    if "position" not in quotes.columns:
        quotes = quotes.withColumn("position", F.lit(0))
    asked = pending.select("doc_id", "seq", "rn", "item_id").join(quotes.select("doc_id", "rn", "position", "quote"), ["doc_id", "rn"])
    asked = asked.filter(quote_supports(F.col("quote"), F.col("item_id"))).withColumn("needle", squeeze(F.col("quote")))
    return asked.filter(F.length("needle") >= packs.QUOTE_MIN)


def last_quote(found: DataFrame) -> DataFrame:
    """(doc_id, seq, item_id, para_idx, quote): of the quotes found for one finding the one with the largest `position`
    counts (without positions the largest text)."""
    last = F.max_by(F.struct("para_idx", "quote"), F.struct("position", "quote")).alias("w")
    shown = F.left("w.quote", F.lit(packs.QUOTE_SHOWN)).alias("quote")
    return found.groupBy("doc_id", "seq", "item_id").agg(last).select("doc_id", "seq", "item_id", "w.para_idx", shown)


def verify_quotes(pending: DataFrame, quotes: DataFrame, units: DataFrame) -> DataFrame:
    """Quotes that stand in a unit (doc_id, pos, para_idx, text); the first unit in order wins (paragraphs, then table rows).

    For units that are a table of their own; `verify_quotes_in_rows` leaves the texts in their documents' rows.
    """
    hay = units.select("doc_id", "pos", "para_idx", squeeze(F.col("text")).alias("hay"))
    found = asked_quotes(pending, quotes).join(hay, "doc_id").filter(F.col("hay").contains(F.col("needle")))
    return last_quote(found.groupBy("doc_id", "seq", "item_id", "position", "quote").agg(F.min_by("para_idx", "pos").alias("para_idx")))


def beside_texts(fr: DataFrame, asked: DataFrame, *columns: str) -> DataFrame:
    """doc_id and, of every document with rows in `asked`, these rows with `para_idx`: of the first unit with the needle.

    The rows of a document, few and short, go to its texts as one array; the texts stay in their row, and every unit is
    squeezed once.  They are not shuffled if Spark broadcasts the arrays, or if the frame comes from a table bucketed by
    doc_id (`sinks.save_bucketed`).
    """
    arrays = asked.groupBy("doc_id").agg(F.collect_set(F.struct(*columns, "needle")).alias("asked"))
    hays = F.transform(unit_array(), lambda u: F.struct(u["para_idx"].alias("para_idx"), squeeze(u["text"]).alias("hay")))
    j = fr.select("doc_id", hays.alias("hays")).join(arrays, "doc_id")

    def look(x):
        place = lambda q: F.try_element_at(F.filter(x["hays"], lambda h: h["hay"].contains(q["needle"])), F.lit(1))["para_idx"]
        return F.transform(x["asked"], lambda q: F.struct(*[q[c].alias(c) for c in columns], place(q).alias("para_idx")))

    once = F.array(F.struct(F.col("asked"), F.col("hays")))
    return unnest(j, F.flatten(F.transform(once, look)), "doc_id").filter(F.col("para_idx").isNotNull())


def verify_quotes_in_rows(pending: DataFrame, quotes: DataFrame, fr: DataFrame) -> DataFrame:
    """As `verify_quotes`, against the units in the rows of a frame."""
    return last_quote(beside_texts(fr, asked_quotes(pending, quotes), "seq", "item_id", "position", "quote"))


def apply_quotes(findings: DataFrame, verified: DataFrame) -> DataFrame:
    v = verified.select("doc_id", "seq", F.col("para_idx").alias("_at"), F.col("quote").alias("verified_quote"))
    return (
        findings.join(v, ["doc_id", "seq"], "left")
        .withColumns(
            {
                "anchors": F.when(F.col("_at").isNotNull(), F.array("_at")).otherwise(F.col("anchors")),
                "evidence_gate": F.when(F.col("_at").isNotNull(), "quote_verified").otherwise(F.col("evidence_gate")),
            }
        )
        .drop("_at")
    )


def usage_notes(parsed: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """Per document: valid and invalid entry counts and note codes."""
    n = parsed.groupBy("doc_id").agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"))
    return n.withColumn("notes", F.array_compact(F.array(F.lit("routed_by_tier"), F.when(F.col("n_invalid") > 0, "invalid_dropped"))))
