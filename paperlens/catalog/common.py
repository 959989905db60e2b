"""Frames shared by the registered queries."""

from paperlens.operators import elements, rules, structure
from paperlens.plans import flagship
from paperlens.plans import review as review_plan
from paperlens.sources.intake import read, spread, text_blocks
from paperlens.sources.sinks import staged

_STAGED = {}


_PLANS = {}


def planned(spark, d, name, build):
    """The plan (not the data) of a frame, built once: composing the review takes seconds of driver time."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _PLANS:
        _PLANS[key] = build()
    return _PLANS[key]


def overlay_frame(spark, d):
    return planned(spark, d, "overlay", lambda: flagship.overlay_frame(spark, d))


def docs(spark, d):
    return spread(read(spark, d, "documents"))


def raw_frame(spark, d):
    return structure.frame(text_blocks(docs(spark, d)))


def tagged(spark, d):
    return planned(spark, d, "tagged", lambda: elements.with_elements(overlay_frame(spark, d)))


def ruled(spark, d):
    return planned(spark, d, "ruled", lambda: rules.with_findings(elements.with_features(tagged(spark, d))))


def facts(spark, d):
    return planned(spark, d, "facts", lambda: review_plan.document_facts(overlay_frame(spark, d)))


def once(spark, d, name, build):
    """A table written once per application and folder, as a corpus job would keep it."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STAGED:
        _STAGED[key] = staged(build())
    return _STAGED[key]


def rule_rows(spark, d):
    return once(spark, d, "rule_rows", lambda: rules.finding_rows(ruled(spark, d)))


def kept_facts(spark, d):
    """The documents' facts, one compact row each, written once: all that is costly about a review.  The findings, many and
    wide rows with their texts, are made from them where they are read, with the columns that are asked for."""
    return once(spark, d, "facts", lambda: facts(spark, d))


def scored(spark, d):
    """Scored rules-only findings with figure demotion on."""
    return planned(spark, d, "scored", lambda: review_plan.review(facts=kept_facts(spark, d), demote=True))
