"""Order statistics and running state that stay spread out when one key holds a third of the rows."""

from pyspark.sql import DataFrame, Window, functions as F

#: Of a sketch: its ranks are off by less than 1 / ACCURACY of the group.
ACCURACY = 10_000


def nearest_rank(df: DataFrame, group: str, value: str, percents, accuracy=ACCURACY) -> DataFrame:
    """Exact percentile: the value at index round-half-even(p/100*(n-1)) of the sorted group.

    A sketch per group gives two values with the rank for certain between them, however the values are spread.  One pass
    counts what is below the lower one; only what lies between them, some 4/accuracy of a group, is shuffled, pre-counted
    by value, and ordered.  The rank of a sketch is rounded otherwise than the one asked for, by up to 1.5 rows, which is more
    than the edges leave in a group of few rows; such a group, of less than 2 * accuracy rows, is ordered whole.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).alias("_v"))
    edges = [e for p in percents for e in (p / 100 - 2 / accuracy, p / 100 + 2 / accuracy)]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(min(1.0, max(0.0, e))) for e in edges]), accuracy)
    stats = rows.groupBy("_g").agg(F.count("*").alias("total"), F.min("_v").alias("least"), F.max("_v").alias("most"), sketch.alias("edges"))

    def edge(k):
        end = F.col("most" if k % 2 else "least")
        return end if edges[k] <= 0 or edges[k] >= 1 else F.when(F.col("total") < 2 * accuracy, end).otherwise(F.get("edges", F.lit(k)))

    rank = lambda p: F.bround(F.lit(p / 100) * (F.col("total") - 1)).cast("bigint")
    asked = [F.struct(F.lit(float(p)).alias("pct"), rank(float(p)).alias("idx"), edge(2 * i).alias("lo"), edge(2 * i + 1).alias("hi")) for i, p in enumerate(percents)]
    want = stats.select(F.col("_g").alias("_w"), F.explode(F.array(*asked)).alias("a")).select("_w", "a.*")
    j = rows.join(want, F.col("_g").eqNullSafe(F.col("_w")))
    below = j.groupBy("_g", "pct").agg(F.count_if(F.col("_v") < F.col("lo")).alias("below")).toDF("_bg", "_bp", "below")
    near = j.filter(F.col("_v").between(F.col("lo"), F.col("hi"))).groupBy("_g", "pct", "idx", "_v").agg(F.count("*").alias("n"))
    near = near.join(below, F.col("_g").eqNullSafe(F.col("_bg")) & (F.col("pct") == F.col("_bp")))
    seen = F.sum("n").over(Window.partitionBy("_g", "pct").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
    near = near.withColumn("from", F.col("below") + F.coalesce(seen, F.lit(0)))
    hit = near.filter((F.col("idx") >= F.col("from")) & (F.col("idx") < F.col("from") + F.col("n")))
    return hit.select(F.col("_g").alias(group), "pct", F.col("_v").alias(value))


def previous_row(df: DataFrame, key: str, ts: str, tie: str, what: str, block="1 hour") -> DataFrame:
    """Adds ``previous``: of ``what``, the value of the row before in the order of (ts, tie), per key, in (key, block) pieces.

    The first row of a block takes the last value of the blocks before it, from a table with one row per (key, block).
    """
    d = df.withColumns({"_blk": F.window(ts, block)["start"], "_what": F.struct(F.col(what).alias("value"))})
    ends = d.groupBy(key, "_blk").agg(F.max_by("_what", F.struct(ts, tie)).alias("_end"))
    ends = ends.withColumn("_carry", F.lag("_end").over(Window.partitionBy(key).orderBy("_blk"))).drop("_end")
    own = F.lag("_what").over(Window.partitionBy(key, "_blk").orderBy(ts, tie))
    d = rejoin(d.withColumn("_own", own), ends, key, "_blk")
    return d.withColumn("previous", F.coalesce("_own", "_carry")["value"]).drop("_own", "_carry", "_blk", "_what")


def previous_time(df: DataFrame, key: str, ts: str, tie: str, block="1 hour") -> DataFrame:
    """Adds ``prev_ts`` per key without ordering a whole key in one task.

    ``lag`` runs inside (key, time block); the first row of a block takes the latest time of the
    blocks before it, from a table with one row per (key, block).
    """
    blk = F.window(ts, block)["start"]
    d = df.withColumn("_blk", blk)
    ends = d.groupBy(key, "_blk").agg(F.max(ts).alias("_end"))
    ends = ends.withColumn("_carry", F.lag("_end").over(Window.partitionBy(key).orderBy("_blk"))).drop("_end")
    own = F.lag(ts).over(Window.partitionBy(key, "_blk").orderBy(ts, tie))
    return rejoin(d.withColumn("_own", own), ends, key, "_blk").withColumn("prev_ts", F.coalesce("_own", "_carry")).drop("_own", "_carry", "_blk")


def rejoin(rows: DataFrame, ends: DataFrame, key: str, block: str) -> DataFrame:
    """Rows with the columns of their block; a null key is a key like any other."""
    ends = ends.withColumnsRenamed({key: "_key", block: "_block"})
    return rows.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col(block) == F.col("_block"))).drop("_key", "_block")


def running_total(df: DataFrame, key: str, order: str, amount, name: str, block=4096) -> DataFrame:
    """Inclusive running sum per key in blocks of ``order`` (an integer), with block offsets added back."""
    d = df.withColumns({"_b": F.floor(F.col(order) / block), "_a": amount})
    off = d.groupBy(key, "_b").agg(F.sum("_a").alias("_s"))
    w = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = off.withColumn("_o", F.coalesce(F.sum("_s").over(w), F.lit(0))).drop("_s")
    inner = F.sum("_a").over(Window.partitionBy(key, "_b").orderBy(order))
    return d.withColumn("_i", inner).join(off, [key, "_b"]).withColumn(name, F.col("_i") + F.col("_o")).drop("_b", "_a", "_i", "_o")
