"""The 17 checklist rules as expressions over one feature row per document.

Each rule yields array<struct<code,para_idx,arg0,arg1>>; a null or empty array means "not evaluated".
"""

from pyspark.sql import Column, DataFrame, functions as F

from paperlens import packs
from paperlens.sources.intake import unnest
from paperlens.functions.text import cs, literal_map, signal, strip
from paperlens.operators import structure
from paperlens.operators.elements import anchor_for, first_body_anchor, last_body_anchor, last_para, section_anchor

OUTCOME_OF = {  # code -> (item, verdict, severity)
    "REF1_BAD": ("R-REF-01", "problem", "low"), "REF1_OK": ("R-REF-01", "pass", "low"),
    "REF2_BAD": ("R-REF-02", "problem", "mid"), "REF2_OK": ("R-REF-02", "pass", "low"),
    "LEAK": ("R-03", "problem", "high"), "SPLIT_VAGUE": ("R-03", "problem", "high"),
    "SPLIT_NONE": ("R-03", "problem", "high"), "SPLIT_OK": ("R-03", "pass", "low"),
    "TEST_BAD": ("R-07", "problem", "high"), "TEST_OK": ("R-07", "pass", "low"),
    "CI_BAD": ("R-09", "problem", "mid"), "CI_OK": ("R-09", "pass", "low"),
    "SIZE_BAD": ("R-02", "problem", "low"), "SIZE_OK": ("R-02", "pass", "low"),
    "REPRO_BAD": ("R-14", "problem", "low"), "REPRO_OK": ("R-14", "pass", "low"),
    "MULTI_BAD": ("R-08", "problem", "mid"), "MULTI_OK": ("R-08", "pass", "low"),
    "BASE_MANY": ("R-04", "pass", "low"), "BASE_ONE": ("R-04", "problem", "mid"),
    "BASE_OK": ("R-04", "pass", "low"), "BASE_NONE": ("R-04", "problem", "mid"),
    "ABL_BAD": ("R-05", "problem", "mid"), "ABL_OK": ("R-05", "pass", "low"),
    "OVER_BAD": ("R-11", "problem", "low"),
    "LIM_BAD": ("R-15", "problem", "low"), "LIM_OK": ("R-15", "pass", "low"),
    "GOAL_BAD": ("R-01", "problem", "mid"), "GOAL_OK": ("R-01", "pass", "low"),
    "METRIC_MISFIT": ("R-06", "problem", "mid"), "METRIC_BAD": ("R-06", "problem", "mid"), "METRIC_OK": ("R-06", "pass", "low"),
    "REP_BAD": ("R-10", "problem", "mid"), "REP_OK": ("R-10", "pass", "low"),
    "HYP_OK": ("R-12", "pass", "low"), "HYP_NORANGE": ("R-12", "problem", "mid"), "HYP_BAD": ("R-12", "problem", "mid"),
    "PRE_BAD": ("R-13", "problem", "mid"), "PRE_OK": ("R-13", "pass", "low"),
}

RESULT = "array<struct<code:string,para_idx:int,arg0:string,arg1:string>>"


def _seen(kind: str) -> Column:
    return F.col("first")[kind].isNotNull()


def _out(code, para: Column, arg0=None, arg1=None) -> Column:
    text = lambda a: F.lit(None).cast("string") if a is None else a
    return F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), para.alias("para_idx"), text(arg0).alias("arg0"), text(arg1).alias("arg1"))


def _one(condition: Column, code: Column, para: Column) -> Column:
    return F.when(condition, F.array(_out(code, para)))


def _pick(condition: Column, good: str, bad: str) -> Column:
    return F.when(condition, good).otherwise(bad)


def _units_any(cond) -> Column:
    return F.exists("paras", lambda p: cond(p["text"])) | F.exists("table_rows", lambda r: cond(r["text"]))


def dangling_citations():
    bad = F.filter("cites", lambda c: F.size(c["unresolved"]) > 0)
    listed = lambda c: F.concat(F.lit("["), structure.spelled(c["unresolved"]), F.lit("]"))
    return F.when(F.size(bad) > 0, F.transform(bad, lambda c: _out("REF1_BAD", c["para_idx"], listed(c), c["marker"]))).when(
        F.size("cites") > 0, F.array(_out("REF1_OK", F.get("cites", F.lit(0))["para_idx"]))
    )


def missing_references():
    found = _seen("reference_list")
    return _one(F.size("cites") > 0, _pick(found, "REF2_OK", "REF2_BAD"), F.when(found, F.col("first.reference_list")).otherwise(F.get("cites", F.lit(0))["para_idx"]))


def data_split():
    anchor = anchor_for("data_split", "metric", "novel_module", "study_design")
    leak = lambda u: signal(u["text"], "leak")
    unit = lambda u: F.struct(u["para_idx"].alias("para_idx"), u["text"].alias("text"))
    leaks = F.concat(F.transform(F.filter("paras", leak), unit), F.transform(F.filter("table_rows", leak), unit))
    detail = _units_any(lambda t: signal(t, "split_word") & signal(t, "split_detail"))
    where = F.coalesce(section_anchor("split_a"), section_anchor("split_b"), anchor)
    split = _seen("data_split")
    return F.when(
        (F.col("trains_model") | F.col("ai_empirical")) & anchor.isNotNull(),
        F.when(F.size(leaks) > 0, F.transform(leaks, lambda u: _out("LEAK", u["para_idx"], F.left(strip(u["text"]), F.lit(80)))))
        .when(split & detail, F.array(_out("SPLIT_OK", anchor)))
        .otherwise(F.array(_out(_pick(split, "SPLIT_VAGUE", "SPLIT_NONE"), where))),
    )


def stat_test():
    named = F.col("sig.named_test")
    return _one(
        _seen("p_value"),
        _pick(named, "TEST_OK", "TEST_BAD"),
        F.when(named, anchor_for("stat_test", "p_value")).otherwise(F.coalesce(last_body_anchor("p_body"), anchor_for("p_value"))),
    )


def interval():
    anchor = anchor_for("stat_test", "p_value", "metric")
    ok = _seen("confidence_interval")
    return _one(anchor.isNotNull(), _pick(ok, "CI_OK", "CI_BAD"), F.when(ok, anchor).otherwise(F.coalesce(section_anchor("ci"), anchor)))


def sample_size():
    anchor = anchor_for("sample_size", "study_design")
    return _one(anchor.isNotNull(), _pick(_seen("sample_size_rationale"), "SIZE_OK", "SIZE_BAD"), anchor)


def reproducibility():
    anchor = F.coalesce(anchor_for("data_split", "study_design", "novel_module"), F.lit(0))
    ok = _seen("reproducibility")
    return _one(F.col("trains_model") | F.col("ai_empirical"), _pick(ok, "REPRO_OK", "REPRO_BAD"), F.when(ok, anchor).otherwise(F.coalesce(section_anchor("repro"), anchor)))


def multiple_comparison():
    at = F.coalesce(last_para(lambda p: signal(p["text"], "multi_comparison")), anchor_for("baseline", "metric"), F.lit(0))
    return _one(F.col("ai_empirical") & F.col("sig.multi_comparison"), _pick(_seen("multiple_comparison"), "MULTI_OK", "MULTI_BAD"), at)


def baselines():
    anchor = anchor_for("novel_module", "metric", "study_design", "baseline")
    many = F.col("sig.multi_model") | F.col("sig.multi_baseline")
    one = F.col("sig.single_baseline")
    some = F.exists("paras", lambda p: signal(p["text"], "baseline"))
    code = F.when(many, "BASE_MANY").when(one, "BASE_ONE").when(some, "BASE_OK").otherwise("BASE_NONE")
    at = (
        F.when(many, anchor)
        .when(one, F.coalesce(section_anchor("baseline"), first_body_anchor("baseline_body"), anchor))
        .when(some, anchor)
        .otherwise(F.coalesce(last_para(lambda p: signal(p["text"], "model_word")), anchor))
    )
    return _one(F.col("ai_empirical") & anchor.isNotNull(), code, at)


def ablation():
    return _one(_seen("novel_module"), _pick(_seen("ablation"), "ABL_OK", "ABL_BAD"), F.coalesce(section_anchor("ablation"), anchor_for("novel_module")))


def overgeneralization():
    return _one(_seen("overgeneralization"), F.lit("OVER_BAD"), anchor_for("overgeneralization"))


def limitation():
    ok = _seen("limitation")
    last = F.coalesce(F.try_element_at("paras", F.lit(-1))["para_idx"], F.lit(0))
    return _one(F.size("paras") >= 4, _pick(ok, "LIM_OK", "LIM_BAD"), F.when(ok, anchor_for("limitation")).otherwise(F.coalesce(section_anchor("limitation"), last)))


def research_goal():
    return _one(F.col("has_intro"), _pick(_seen("research_goal"), "GOAL_OK", "GOAL_BAD"), F.coalesce(anchor_for("study_design", "metric", "novel_module"), F.lit(0)))


def metric_reported():
    misfit = F.col("sig.class_task") & ~F.col("sig.class_metric")
    code = F.when(misfit, "METRIC_MISFIT").when(_seen("metric"), "METRIC_OK").otherwise("METRIC_BAD")
    return _one(_seen("novel_module"), code, F.coalesce(section_anchor("metric_a"), section_anchor("metric_b"), anchor_for("novel_module")))


def repeats_reported():
    ok = _seen("repeats") | _seen("confidence_interval")
    anchor = anchor_for("metric")
    return _one(F.col("ai_empirical") & _seen("metric"), _pick(ok, "REP_OK", "REP_BAD"), F.when(ok, anchor).otherwise(F.coalesce(section_anchor("repeats"), anchor)))


def hyperparameters():
    bare = lambda t: F.regexp_replace(t, cs(r"\[\s*\d[\d\s,，\-–—]*\]"), "")
    ranged = _units_any(lambda t: signal(t, "hyper_unit") & signal(bare(t), "hyper_range"))
    searched = F.col("sig.hyper_search")
    anchor = anchor_for("hyperparameter")
    code = F.when(searched & ranged, "HYP_OK").when(searched, "HYP_NORANGE").otherwise("HYP_BAD")
    return _one(_seen("hyperparameter"), code, F.when(code == "HYP_NORANGE", F.coalesce(section_anchor("hyper"), anchor)).otherwise(anchor))


def preprocessing():
    return _one(F.col("ai_empirical"), _pick(_seen("preprocessing"), "PRE_OK", "PRE_BAD"), F.coalesce(anchor_for("metric", "novel_module", "data_split", "study_design"), F.lit(0)))


RULES = [
    dangling_citations, missing_references, data_split, stat_test, interval, sample_size, reproducibility,
    multiple_comparison, baselines, ablation, overgeneralization, limitation, research_goal, metric_reported,
    repeats_reported, hyperparameters, preprocessing,
]


def _lookup(code: Column, pos: int) -> Column:
    return F.element_at(literal_map({c: o[pos] for c, o in OUTCOME_OF.items()}), code)


def with_findings(features: DataFrame) -> DataFrame:
    """Adds ``findings``: ordered array of rule outcomes with item, verdict, severity, certainty."""
    none = F.array().cast(RESULT)
    outcomes = F.concat(*[F.coalesce(rule(), none) for rule in RULES])
    return features.withColumn(
        "findings",
        F.transform(
            outcomes,
            lambda o, i: F.struct(
                i.alias("seq"),
                _lookup(o["code"], 0).alias("item_id"),
                o["code"].alias("code"),
                _lookup(o["code"], 1).alias("verdict"),
                _lookup(o["code"], 2).alias("severity"),
                F.when(_lookup(o["code"], 0).isin(packs.DETERMINISTIC_ITEMS), "deterministic").otherwise("suspected").alias("certainty"),
                o["para_idx"].alias("para_idx"),
                o["arg0"].alias("arg0"),
                o["arg1"].alias("arg1"),
            ),
        ),
    )


def finding_rows(found: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One row per finding; problem severities come from the checklist when it is given."""
    rows = unnest(found, "findings", "doc_id")
    if items is None:
        return rows
    sev = items.select("item_id", F.col("severity_default").alias("_sev"))
    return rows.join(sev, "item_id", "left").withColumn("severity", F.when(F.col("verdict") == "problem", F.coalesce("_sev", "severity")).otherwise(F.col("severity"))).drop("_sev")
