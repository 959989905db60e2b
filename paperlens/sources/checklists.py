"""Checklist and ground-truth files."""

from pyspark.sql import DataFrame, functions as F

from paperlens import packs

ITEM_SCHEMA = (
    "id string, version string, category string, templates array<string>, requires array<string>, severity_default string, "
    "judge string, title string, description string, suggestion_template string, source_refs array<string>, revision_template string"
)
TRUTH_SCHEMA = (
    "sample_id string, title string, source string, license string, language string, note string, type string, "
    "items array<struct<checklist_item_id:string,severity_expected:string,anchor:struct<paragraph_index:int,sentence_index:int>,note:string>>"
)
MAX_CHECKLIST_ROWS = 10_000


class ChecklistError(ValueError):
    pass


def default_checklist(spark) -> DataFrame:
    rows = [(i, sev, judge, title, text, tmpl, [f"element:{t}" for t in req]) for i, req, sev, judge, title, text, tmpl in packs.CHECKLIST]
    return spark.createDataFrame(rows, "item_id string, severity_default string, judge string, title string, description string, templates array<string>, requires array<string>")


def read_checklists(spark, path: str) -> DataFrame:
    """All checklist files under a path: file stem and item columns.  Accepts {"items": [...]} or a bare array."""
    wrapped = spark.read.option("multiLine", True).schema(f"items array<struct<{_struct(ITEM_SCHEMA)}>>, {ITEM_SCHEMA}").json(path)
    stem = F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)
    nested = wrapped.select(stem.alias("checklist"), F.explode("items").alias("i")).select("checklist", "i.*")
    bare = wrapped.filter(F.col("items").isNull()).select(stem.alias("checklist"), *[c.split()[0] for c in _fields(ITEM_SCHEMA)])
    return nested.unionByName(bare).withColumnRenamed("id", "item_id")


def read_items(spark, folder: str) -> DataFrame:
    """Checklists stored as one folder of JSON lines per checklist (checklist=<name>)."""
    return spark.read.schema(ITEM_SCHEMA + ", checklist string").json(folder).withColumnRenamed("id", "item_id")


def _fields(ddl):
    return [f.strip() for f in ddl.split(", ")]


def _struct(ddl):
    return ",".join(f.replace(" ", ":", 1) for f in _fields(ddl))


def invalid_items(items: DataFrame) -> DataFrame:
    """Rows that break the item contract: no id or title, unknown severity or judge, duplicate id."""
    bad = (
        F.col("item_id").isNull()
        | F.col("title").isNull()
        | ~F.coalesce(F.col("severity_default").isin(packs.SEVERITIES), F.lit(False))
        | ~F.coalesce(F.col("judge").isin("rule", "llm", "advisory"), F.lit(True))
    )
    broken = items.filter(bad).select("checklist", "item_id", F.lit("schema").alias("problem"))
    twice = items.groupBy("checklist", "item_id").count().filter("count > 1").select("checklist", "item_id", F.lit("duplicate").alias("problem"))
    return broken.unionByName(twice)


def load_checklist(spark, path: str, min_items=1):
    """Validated checklist as the tuple rows the plans take.  A checklist is configuration, not data: its size is checked."""
    items = read_checklists(spark, path)
    problems = invalid_items(items).limit(1).collect()
    if problems:
        raise ChecklistError(f"checklist item {problems[0]['item_id']}: {problems[0]['problem']}")
    rows = items.limit(MAX_CHECKLIST_ROWS + 1).collect()
    if len(rows) > MAX_CHECKLIST_ROWS or len(rows) < min_items:
        raise ChecklistError(f"checklist has {len(rows)} items, expected {min_items} to {MAX_CHECKLIST_ROWS}")
    req = lambda r: [x.split(":", 1)[1] for x in (r["requires"] or []) if x.startswith("element:")]
    return [(r["item_id"], req(r), r["severity_default"], r["judge"] or "llm", r["title"], r["description"] or "", r["templates"] or []) for r in rows]


def required_types(items: DataFrame) -> DataFrame:
    keep = F.filter("requires", lambda r: r.startswith("element:"))
    return items.select("item_id", F.explode(F.transform(keep, lambda r: F.substring_index(r, ":", -1))).alias("type"))


def for_template(items: DataFrame, template: str) -> DataFrame:
    return items.filter((F.size("templates") == 0) | F.array_contains("templates", template))


GROUPS = ["fixture", "real", "review", "empirical", "planted"]


def _explode_truth(t: DataFrame) -> DataFrame:
    t = t.filter(F.col("items").isNotNull())
    return t.select("sample_id", F.when(F.col("type").isin(GROUPS), F.col("type")).otherwise("fixture").alias("grp"), F.inline("items")).select(
        "sample_id", "grp", F.col("checklist_item_id").alias("item_id"), F.col("severity_expected").alias("severity"), F.col("anchor.paragraph_index").alias("para_idx")
    )


def read_truth(spark, path: str) -> DataFrame:
    """Ground-truth files exploded to (sample_id, grp, item_id, severity, para_idx); files without items are skipped."""
    return _explode_truth(spark.read.option("multiLine", True).schema(TRUTH_SCHEMA).json(path))


def truth_rows(df: DataFrame, column: str) -> DataFrame:
    """The same from a column of JSON texts."""
    return _explode_truth(df.select(F.from_json(column, TRUTH_SCHEMA).alias("t")).select("t.*"))
