"""Evidence gate, judge tiers, figure demotion, confidence, grade, quality card.

All row-level columns over the findings table; only the card and the counts aggregate.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paperlens import packs
from paperlens.functions.text import literal_map


def requires_of(item_id: Column, items=packs.CHECKLIST) -> Column:
    return F.coalesce(F.try_element_at(literal_map({r[0]: r[1] for r in items}), item_id), F.array().cast("array<string>"))


def lookup(items, pos: int, item_id: Column) -> Column:
    return F.try_element_at(literal_map({r[0]: r[pos] for r in items}), item_id)


def attach_evidence(findings: DataFrame, items=packs.CHECKLIST) -> DataFrame:
    """First element of each required type becomes evidence and, failing own anchors, the anchor (at most 3).

    Needs ``facts`` array<struct<type,para_idx,confidence>> (first element per type) and
    ``rule_anchors`` array<int> (anchors of the item's rule findings) on each row.
    """
    core = F.col("phase") <= 1
    matched = F.flatten(F.transform(requires_of(F.col("item_id"), items), lambda t: F.filter("facts", lambda e: e["type"] == t)))
    f = findings.withColumn("_m", F.when(core, matched).otherwise(F.slice("facts", 1, 0)))
    own = F.size("anchors") > 0
    borrowed = F.slice(F.transform("_m", lambda e: e["para_idx"]), 1, 3)
    bare = core & (F.col("engine") == "llm") & (F.col("verdict") == "problem") & ~own & (F.size("_m") == 0)
    reuse = bare & (F.size("rule_anchors") > 0)
    lost = bare & ~reuse
    solid = core & (F.col("engine") == "rule") & (F.size("_m") > 0) & F.forall("_m", lambda e: e["confidence"] >= 1.0)
    return f.withColumns(
        {
            "evidence": F.transform("_m", lambda e: e["type"]),
            "certainty": F.when(solid, "deterministic").otherwise(F.col("certainty")),
            "anchors": F.when(own, F.col("anchors")).when(reuse, F.slice("rule_anchors", 1, 3)).otherwise(borrowed),
            "verdict": F.when(lost, "uncertain").otherwise(F.col("verdict")),
            "description": F.when(lost, F.concat(F.lit(packs.PREFIX_NO_EVIDENCE), "description")).otherwise(F.col("description")),
            "evidence_gate": F.when(reuse, "rule_anchor_reuse").when(lost, "no_evidence").otherwise(F.col("evidence_gate")),
        }
    ).drop("_m")


def judge_tiers(findings: DataFrame, items=packs.CHECKLIST, force_advisory=False) -> DataFrame:
    tier = F.coalesce(lookup(items, 3, F.col("item_id")), F.lit("llm"))
    soft = (F.col("engine") == "llm") & (F.col("verdict") == "problem") & (F.lit(force_advisory) | (tier == "advisory"))
    return findings.withColumns(
        {
            "verdict": F.when(soft, "uncertain").otherwise(F.col("verdict")),
            "description": F.when(soft, F.concat(F.lit(packs.PREFIX_ADVISORY), "description")).otherwise(F.col("description")),
            "advisory": F.col("advisory") | soft,
        }
    )


def demote_for_figures(findings: DataFrame) -> DataFrame:
    """Rule problems that may rest on a figure become uncertain unless a table of the document holds the evidence."""
    in_table = reduce(
        lambda a, b: a | b,
        [(F.col("item_id") == i) & F.arrays_overlap("table_types", F.array(*[F.lit(t) for t in ts])) for i, ts in packs.DEMOTE_EVIDENCE.items()],
    )
    hit = (
        (F.col("figure_mentions") > 0)
        & (F.col("engine") == "rule")
        & (F.col("verdict") == "problem")
        & F.col("item_id").isin(list(packs.DEMOTE_EVIDENCE))
        & ~in_table
    )
    return findings.withColumns(
        {
            "verdict": F.when(hit, "uncertain").otherwise(F.col("verdict")),
            "description": F.when(hit, F.concat(F.lit(packs.PREFIX_FIGURES), "description")).otherwise(F.col("description")),
            "evidence_gate": F.when(hit, "figures_unparsed").otherwise(F.col("evidence_gate")),
        }
    )


def score(findings: DataFrame) -> DataFrame:
    """Adds gate_reason, confidence, grade."""
    flags = F.array_distinct(
        F.array_compact(F.array(F.col("evidence_gate"), F.when(F.col("advisory"), "advisory"), F.when(F.col("vetoed_llm"), "vetoed_llm")))
    )
    factor = literal_map(packs.GATE_FACTOR)
    f = findings.withColumn("_flags", flags)
    open_ = F.col("certainty") == "undetermined"
    base = F.when(F.col("certainty") == "deterministic", 1.0).when(F.col("engine") == "rule", packs.BASE_CONFIDENCE["rule"]).otherwise(packs.BASE_CONFIDENCE["llm"])
    evidence = F.when((F.size("anchors") > 0) | (F.size("evidence") > 0), 1.0).otherwise(0.5)
    consistency = F.when(F.col("dual_check") == "disagree", 0.6).when(F.col("conflict") & (F.col("verdict") == "problem"), 0.7).otherwise(1.0)
    gate = F.coalesce(F.array_min(F.transform("_flags", lambda x: F.element_at(factor, x))), F.lit(1.0))
    reason = F.coalesce(*[F.when(F.array_contains("_flags", r), r) for r in packs.GATE_PRIORITY], F.lit("direct"))
    f = f.withColumns(
        {
            "gate_reason": F.when(open_, "not_evaluated").otherwise(reason),
            "confidence": F.when(open_, 0.0).otherwise(F.round(base * evidence * consistency * gate, 4)),
        }
    )
    c = F.col("confidence")
    grade = F.when(open_, "D").when(c >= packs.GRADE_A, "A").when(c >= packs.GRADE_B, "B").when(c >= packs.GRADE_C, "C").otherwise("D")
    return f.withColumn("grade", grade).drop("_flags")


def count_columns() -> list[Column]:
    """Aggregates of `counts`."""
    problem = F.col("verdict") == "problem"
    agg = {f"n_{s}": F.count_if(problem & (F.col("severity") == s)) for s in packs.SEVERITIES}
    agg["n_total"] = F.count_if(problem)
    agg |= {f"n_{v}": F.count_if(F.col("verdict") == v) for v in ("pass", "not_applicable", "uncertain")}
    agg |= {f"n_{c}": F.count_if(F.col("certainty") == c) for c in ("deterministic", "suspected", "undetermined")}
    agg["n_assessed"] = F.count_if(F.col("certainty") != "undetermined")
    return [v.alias(k) for k, v in agg.items()]


def counts(findings: DataFrame) -> DataFrame:
    """Per-document counts: severities of problems, other verdicts, certainty, assessed."""
    return findings.groupBy("doc_id").agg(*count_columns())


def quality_columns(items=packs.CHECKLIST) -> list[Column]:
    """Aggregates of `quality`, before `with_review_rate`."""
    assessed = F.col("certainty") != "undetermined"
    known = F.col("item_id").isin([r[0] for r in items]) & ((F.col("paper_type") != "review") | F.col("item_id").isin(packs.REVIEW_ALLOWED))
    total = F.when(F.first("paper_type") == "review", len([r for r in items if r[0] in packs.REVIEW_ALLOWED])).otherwise(len(items))
    # confidences have four decimals: their mean is taken in whole ten-thousandths, half up, so that it depends on no order of adding
    units, n = F.sum(F.when(assessed, F.round(F.col("confidence") * 10_000).cast("bigint"))), F.count_if(assessed)
    mean = F.floor(F.try_divide(2 * units + n, 2 * n)) / 10_000
    return [
        *[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCD"],
        F.coalesce(mean, F.lit(0.0)).alias("avg_confidence"),
        F.size(F.collect_set(F.when(assessed & known, F.col("item_id")))).cast("bigint").alias("assessed_items"),
        total.cast("bigint").alias("_items"),
    ]


def with_review_rate(out: DataFrame) -> DataFrame:
    out = out.withColumn("applicable_items", F.greatest("_items", "assessed_items")).drop("_items")
    return out.withColumn("review_rate", F.round(F.col("assessed_items") / F.col("applicable_items"), 4))


def quality(findings: DataFrame, items=packs.CHECKLIST) -> DataFrame:
    """Quality card per document: grades, mean confidence, assessed / applicable items, review rate."""
    return with_review_rate(findings.groupBy("doc_id").agg(*quality_columns(items)))


def gate_reasons(findings: DataFrame) -> DataFrame:
    return findings.groupBy("doc_id", "gate_reason").agg(F.count("*").alias("n"))
