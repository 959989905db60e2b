"""The review plan: frame -> facts -> draft findings -> gates -> scored findings.

Rules-only, the whole plan is a map over documents with no shuffle.  With model verdicts, image readings or both
there is one join on doc_id.  Step order is part of the semantics: merge, verify, evidence, tiers,
unassessed, then the extra checks and the image readings, then demotion, then scoring.
"""

from pyspark.sql import DataFrame, functions as F

from paperlens import packs
from paperlens.functions.text import literal_map
from paperlens.operators import checks, elements, gates, reconcile, rules
from paperlens.sources.intake import unnest
from paperlens.sources.verdicts import image_texts

FACT = "array<struct<type:string,para_idx:int,confidence:double>>"
STRUCTURAL = ("citation", "reference_list")
#: `seq` holds the phase above these bits, so the entries of a phase cannot run into the next.
PHASE_BITS = 40


def document_facts(fr: DataFrame, use_elements=True) -> DataFrame:
    """One compact row per document: paper type, rule findings, checks, first facts, table facts."""
    tagged = elements.with_elements(fr) if use_elements else fr.withColumn("elements", F.array().cast(elements.ELEMENT))
    f = rules.with_findings(elements.with_features(tagged))
    f = checks.with_figure_checks(checks.with_captions(checks.with_numeric(elements.paper_type(f))))
    types = [*STRUCTURAL, *packs.ELEMENT_TYPES]
    firsts = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("first")[t].isNotNull(),
                    F.struct(F.lit(t).alias("type"), F.col("first")[t].alias("para_idx"), F.lit(1.0 if t in STRUCTURAL else 0.8).alias("confidence")),
                )
                for t in types
            ]
        )
    )
    in_tables = F.array_distinct(F.transform(F.filter("elements", lambda e: e["in_table"]), lambda e: e["type"]))
    return f.select(
        "doc_id", "source", "paper_type", "findings", "numeric", "figure", "figure_mentions",
        firsts.cast(FACT).alias("facts"), in_tables.alias("table_types"), F.size("tables").alias("n_tables"),
        F.transform(F.slice("images", 1, packs.IMAGES_MAX), lambda i: F.struct(i["img_idx"], i["caption"], i["anchor"])).alias("images"),
    )


def _message(code, pos, arg0, arg1):
    table = literal_map({k: v[pos] for k, v in packs.OUTCOMES.items()})
    text = F.coalesce(F.try_element_at(table, code), F.lit(""))
    return F.replace(F.replace(text, F.lit("{0}"), F.coalesce(arg0, F.lit(""))), F.lit("{1}"), F.coalesce(arg1, F.lit("")))


def _check_text(c, pos):
    """One text of a check's finding; the quoted passage goes in last, so that braces in it stay as they are."""
    table = literal_map({k: v[pos] for k, v in packs.CHECK_TEXT.items()})
    text = F.element_at(table, F.when(c["code"] == "CAPTION_MISSING", F.concat(c["code"], c["arg0"])).otherwise(c["code"]))
    args = F.split(F.concat_ws("|", c["arg0"], c["arg1"]), r"\|")
    fill = {f"{{{i}}}": checks.plain(F.get(args, F.lit(i))) for i in range(4)}
    fill |= {"{parts}": c["parts"], "{para}": c["para_idx"].cast("string"), "{quote}": c["quote"]}
    for mark, value in fill.items():
        text = F.replace(text, F.lit(mark), F.coalesce(value, F.lit("")))
    return text


def _finding(phase, seq, engine, item, code, verdict, severity, certainty, anchors, headline, description, suggestion, **prov):
    text = lambda k: prov.get(k, F.lit(None)).cast("string").alias(k)
    flag = lambda k: prov.get(k, F.lit(False)).alias(k)
    return F.struct(
        F.lit(phase).alias("phase"),
        (F.lit(phase << PHASE_BITS).cast("bigint") + seq).alias("seq"),
        F.lit(engine).alias("engine"),
        item.alias("item_id"),
        code.cast("string").alias("code"),
        verdict.alias("verdict"),
        severity.alias("severity"),
        certainty.alias("certainty"),
        anchors.cast("array<int>").alias("anchors"),
        headline.alias("headline"),
        description.alias("description"),
        suggestion.alias("suggestion"),
        text("llm_verdict"), flag("merged"), flag("conflict"), flag("vetoed_llm"), flag("advisory"),
        text("evidence_gate"), text("dual_check"), text("dual_verdict"),
        prov.get("rule_anchors", F.array()).cast("array<int>").alias("rule_anchors"),
    )


def draft(fc: DataFrame, verdicts: DataFrame | None = None, items=packs.CHECKLIST, mark_unassessed=True, readings: DataFrame | None = None) -> DataFrame:
    """Findings rows before gating.  phase 0 rule, 1 model, 2 unassessed, 3 numeric, 4 figure, 5 image reading.

    A reading takes caption and anchor from its image, which the document's row holds; one of an image that the document
    lacks gives no finding.
    """
    fold_type = "array<struct<item_id:string,llm_verdict:string,description:string,suggestion:string>>"
    kind = F.col("paper_type")
    no_folds = F.array().cast(fold_type)
    if verdicts is None and readings is None:
        j = fc.withColumn("folds", no_folds)
    else:
        j = fc.join(reconcile.tagged_verdicts(verdicts, fc.select("doc_id"), readings), "doc_id")
        j = j.withColumn("folds", no_folds if verdicts is None else F.coalesce("folds", no_folds))
    ruled = F.filter("findings", lambda f: elements.applicable(f["item_id"], kind))

    def merged(f, i):
        first = ~F.exists(F.slice("findings", F.lit(1), f["seq"]), lambda o: o["item_id"] == f["item_id"])
        m = F.when(first, F.try_element_at(F.filter("folds", lambda m: m["item_id"] == f["item_id"]), F.lit(1)))
        own = lambda pos: F.nullif(_message(f["code"], pos, f["arg0"], f["arg1"]), F.lit(""))
        severity = F.when(f["verdict"] == "problem", F.coalesce(gates.lookup(items, 2, f["item_id"]), f["severity"])).otherwise(f["severity"])
        return _finding(
            0, f["seq"], "rule", f["item_id"], f["code"], f["verdict"], severity, f["certainty"], F.array(f["para_idx"]),
            _message(f["code"], 0, f["arg0"], f["arg1"]),
            F.coalesce(own(1), m["description"], F.lit("")),
            F.coalesce(own(2), m["suggestion"], F.lit("")),
            llm_verdict=m["llm_verdict"],
            merged=m.isNotNull(),
            conflict=F.coalesce(m["llm_verdict"] != f["verdict"], F.lit(False)),
            vetoed_llm=F.coalesce((f["verdict"] == "pass") & (m["llm_verdict"] == "problem"), F.lit(False)),
        )

    ids = F.array(*[F.lit(r[0]) for r in items])
    missing = F.filter(
        ids,
        lambda i: F.lit(mark_unassessed)
        & elements.applicable(i, kind)
        & ~F.exists("findings", lambda f: f["item_id"] == i)
        & ~F.exists("folds", lambda m: m["item_id"] == i),
    )
    blank = F.lit("")
    unassessed = F.transform(
        missing,
        lambda i, k: _finding(
            2, k, "rule", i, F.lit("UNASSESSED"), F.lit("not_applicable"), F.lit("low"), F.lit("undetermined"), F.array(),
            _message(F.lit("UNASSESSED"), 0, blank, blank), _message(F.lit("UNASSESSED"), 1, gates.lookup(items, 4, i), blank), blank,
        ),
    )
    def extra_check(phase, certainty):
        return lambda c, i: _finding(
            phase, i, "rule", c["item_id"], c["code"], F.lit("problem"), F.lit("low"), F.lit(certainty), F.array(c["para_idx"]),
            _check_text(c, 0), _check_text(c, 1), _check_text(c, 2),
        )

    numeric = F.transform(F.filter("numeric", lambda c: kind != "review"), extra_check(3, "deterministic"))
    figure = F.transform("figure", extra_check(4, "suspected"))
    carrier = F.concat(F.transform(ruled, merged), unassessed, numeric, figure)
    rows = carrier
    if readings is not None:
        image = F.filter("images", lambda i: i["img_idx"] == F.col("reading.img_idx"))

        def read(i):
            headline, description = image_texts(i["img_idx"], i["caption"], F.col("reading.values"), F.col("reading.concern"))
            return _finding(
                5, i["img_idx"], "llm", F.lit(packs.IMAGE_ITEM), F.when(F.size("reading.values") > 0, packs.IMAGE_CODE), F.lit("uncertain"), F.lit("low"), F.lit("suspected"), F.array(i["anchor"]),
                headline, description, F.lit(packs.IMAGE_SUGGESTION), advisory=F.lit(True), evidence_gate=F.lit("vision_read"),
            )

        rows = F.when(F.col("reading").isNotNull(), F.transform(image, read)).otherwise(rows)
    if verdicts is not None:
        item = F.when(elements.applicable(F.col("extra.item_id"), kind), F.col("extra.item_id")).otherwise("unknown")
        keep = (item == "unknown") | ~F.exists("findings", lambda f: f["item_id"] == item)
        e = lambda c: F.col(f"extra.{c}")
        model = _finding(
            1, e("mseq"), "llm", item, F.lit(None), e("verdict"), e("severity"), F.lit("suspected"), F.array(),
            e("headline"), e("description"), e("suggestion"), dual_check=e("dual_check"), dual_verdict=e("dual_verdict"),
        )
        rows = F.when(F.col("extra").isNull(), rows).when(keep, F.array(model))
    return unnest(j, rows, "doc_id", "source", "paper_type", "facts", "table_types", "figure_mentions", "n_tables")


def review(
    fr: DataFrame | None = None,
    verdicts: DataFrame | None = None,
    second: DataFrame | None = None,
    quotes: DataFrame | None = None,
    items=packs.CHECKLIST,
    demote=False,
    force_advisory=False,
    use_elements=True,
    use_gates=True,
    facts: DataFrame | None = None,
    readings: DataFrame | None = None,
) -> DataFrame:
    """Scored findings, one row each; ``facts`` may be given in place of the frame.

    ``verdicts`` and ``second`` come from reconcile.normalize_ids, ``readings`` from verdicts.parse_readings.
    """
    fc = document_facts(fr, use_elements) if facts is None else facts
    if verdicts is not None and second is not None:
        verdicts = reconcile.dual_check(reconcile.restrict(verdicts, fc), reconcile.restrict(second, fc))
    f = draft(fc, verdicts, items, mark_unassessed=use_gates, readings=readings)
    if quotes is not None:
        f = reconcile.apply_quotes(f, reconcile.verify_quotes_in_rows(reconcile.pending_quotes(f), quotes, fr))
    if use_gates:
        f = gates.judge_tiers(gates.attach_evidence(f, items), items, force_advisory)
    else:
        f = f.withColumn("evidence", F.array().cast("array<string>"))
    if demote:
        f = gates.demote_for_figures(f)
    return gates.score(f).drop("facts", "rule_anchors")
