"""Flagship query: findings per checklist item and verdict over the corpus."""

from pyspark.sql import DataFrame, functions as F

from paperlens.operators import elements, rules, structure
from paperlens.sources.intake import overlay_blocks, read, spread


def overlay_frame(spark, sf_dir) -> DataFrame:
    return structure.frame(overlay_blocks(spread(read(spark, sf_dir, "documents"))))


def findings_by_item(spark, sf_dir) -> DataFrame:
    found = rules.with_findings(elements.with_features(elements.with_elements(overlay_frame(spark, sf_dir))))
    return rules.finding_rows(found).groupBy("item_id", "verdict").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))
