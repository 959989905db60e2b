"""Mixing sources to target weights by weighted fair queueing.

Every document gets a place in its source's shuffled order, and a virtual finish time: words of its source up to and
including it, divided by the source's target.  A source whose target exceeds its size is queued again, epoch after
epoch, up to `most` times.  Documents are then taken in global order of finish time until the budget is used.

Scale: only (source, shuffle key, size) moves.  A source is cut into hash buckets of about `BUCKET` rows, so that a
source with a third of all rows is many tasks; the running sum is bucket totals plus a window inside a bucket.  The
global cut is found the same way over ranges of finish time.  Tables of bucket totals have one row per `BUCKET` rows.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source without words has
target 0.  Equal shuffle keys (rows repeated in doc_id and size) are ordered by size, and rows equal in both are
interchangeable: each takes its own place, so totals agree between reruns.  Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlens.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
BUCKET = 50_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and a shuffle key that depends on doc_id alone."""
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("size"), key.alias("key"))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.0, most: int = 3) -> DataFrame:
    """Per source: source_size, source_rows, target and the total budget.

    The water level L solves sum(min(most * size, L * weight)) = budget.  With the sources in the order of the level
    that fills them, the level for "the first k are full" grows up to the true k and falls after it, so L is the largest.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("bigint")
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumns(
        {
            "full_before": F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "weight_from": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(everything) * F.lit(float(budget)),
        }
    )
    level = F.max((F.col("total") - F.col("full_before")) / F.col("weight_from")).over(everything)
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight")))
    return s.select("source", "source_size", "source_rows", "target", "total")


def finishing(sizes: DataFrame, t: DataFrame, most: int) -> DataFrame:
    """Every document with its source's columns and `finish`, its virtual finish time in each epoch."""
    # sources are few, but nothing bounds them: joins are left to Spark's size check
    d = sizes.join(t.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    parts = F.ceil(F.col("source_rows") / F.lit(BUCKET))
    d = d.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * parts / F.lit(1 << 32)))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    totals = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce(before, F.lit(0)).alias("before"))
    d = d.withColumn("upto", F.sum("size").over(inside))
    d = d.join(totals, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    upto = F.col("upto") + F.col("before")
    epochs = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: (upto + e * F.col("source_size")) / F.col("target"))
    # a document without words is never due; its source may have no target at all
    return d.withColumn("finish", F.when(F.col("size") > 0, epochs).otherwise(F.array().cast("array<double>"))).drop("_source", "_bucket", "before", "upto", "bucket")


def place(finish: Column) -> Column:
    return F.struct(finish.alias("finish"), "key", "doc_id", "size")


def last_taken(d: DataFrame):
    """Place, in the global order, of the last document within the budget; None if none is.

    Words are counted in ranges of finish time, one per `BUCKET` rows; only the range that crosses the budget is ordered.
    A unit of time uses one budget of words, so ranges of equal width hold about equal work.
    """
    queue = d.select("key", "doc_id", "size", "total", "source_rows", F.explode("finish").alias("finish"))
    spans = max(1, d.count() // BUCKET)
    queue = queue.withColumn("span", F.floor(F.col("finish") * spans))
    spans = queue.groupBy("span").agg(F.sum("size").alias("words"), F.max("total").alias("total"))
    upto = F.sum("words").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, 0))
    spans = spans.withColumn("upto", upto).filter("upto > total").orderBy("span").limit(1)
    crossing = spans.first()
    if crossing is None:
        return d.select(F.explode("finish").alias("finish"), "key", "doc_id", "size").agg(F.max(place(F.col("finish")))).first()[0]
    room = crossing["total"] - (crossing["upto"] - crossing["words"])
    inside = queue.filter(F.col("span") == crossing["span"]).withColumn("place", place(F.col("finish")))
    run = F.sum("size").over(Window.partitionBy("span").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("run", run).filter(F.col("run") <= room).agg(F.max("place")).first()[0]
    if found is not None:
        return found
    return queue.filter(F.col("span") < crossing["span"]).agg(F.max(place(F.col("finish")))).first()[0]


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = 1.0, most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (times taken) and taken (words taken), one row per input row."""
    sizes = stored(sized(docs), "mix-sizes")
    d = finishing(sizes, targets(sizes, weights, budget, most), most)
    last = last_taken(d)
    if last is None:
        copies = F.lit(0)
    else:
        kinds = dict(sizes.dtypes)
        bound = F.struct(F.lit(last["finish"]).cast("double").alias("finish"), F.lit(last["key"]).alias("key"), F.lit(last["doc_id"]).cast(kinds["doc_id"]).alias("doc_id"), F.lit(last["size"]).cast("bigint").alias("size"))
        copies = F.size(F.filter("finish", lambda f: place(f) <= bound))
    out = d.withColumn("copies", copies.cast("bigint"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
