"""Sinks: findings and reports to Parquet, Markdown to text, and staged intermediate tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, functions as F


def save(df: DataFrame, path: str, by: str = "paper_type", mode="append"):
    df.write.mode(mode).partitionBy(by).parquet(path)


def save_bucketed(df: DataFrame, name: str, key: str = "doc_id", buckets: int = 64) -> DataFrame:
    """The rows as a table bucketed by `key`: joins on it leave them where they are.  Returns the table's rows."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def save_latest(rows: DataFrame, arrived: DataFrame, path: str, version: int, key: str = "doc_id", buckets: int = 64) -> None:
    """Replace, in a table kept by `key`, all rows of the keys that arrived, unless a later version of a key is there.

    The table is cut into hash buckets; only those of the arrived keys are read and written again (dynamic partition
    overwrite), after their new rows were written elsewhere, so a batch that is saved twice, or again after a failure,
    changes nothing.  ``rows`` are the new rows, ``arrived`` names the keys (each should have a row, for a key without any
    leaves no version behind).  A null key is a key like any other.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = rows.withColumns({"version": F.lit(version).cast("bigint"), "bucket": bucket})
    new.limit(0).write.mode("append").partitionBy("bucket").parquet(path)  # the folder
    keys = staged(arrived.select(F.col(key).alias("_key")).distinct())
    touched = [r[0] for r in keys.select(F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int")).distinct().collect()]  # buckets at most
    old = spark.read.schema(new.schema).parquet(path).filter(F.col("bucket").isin(touched))
    of = lambda names: F.col(key).eqNullSafe(names["_key"])
    later = old.filter(F.col("version") > version)
    held = later.select(F.col(key).alias("_key")).distinct()
    stay = old.join(keys, of(keys), "left_anti").unionByName(later.join(keys, of(keys), "left_semi"))
    out = staged(stay.unionByName(new.join(held, of(held), "left_anti")))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_latest(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket", "version")


def save_markdown(reports: DataFrame, path: str, buckets=64):
    """Markdown reports as text files, spread over a fixed number of folders by document."""
    out = reports.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), F.col("markdown").alias("value"))
    out.write.mode("append").partitionBy("bucket").text(path)


def report_listing(reports: DataFrame, json_column: str, order: str) -> DataFrame:
    """Stored report JSON to name and counts, newest first."""
    r = reports.withColumns(
        {"document_name": F.get_json_object(json_column, "$.document_name"), "total": F.get_json_object(json_column, "$.counts.total").cast("bigint")}
    )
    return r.drop(json_column).orderBy(F.desc(order))


def shared_folder(spark) -> str:
    """The cluster's checkpoint folder; a folder of our own only where none is set on one machine (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="paperlens-"))
    return sc.getCheckpointDir()


def new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
