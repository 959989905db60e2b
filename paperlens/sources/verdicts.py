"""Externally supplied model output: verdict payloads, image readings, quotes.  No model is called."""

from pyspark.sql import Column, DataFrame, functions as F

from paperlens import packs
from paperlens.functions.text import strip

#: Lengths that the texts of an entry are cut to (limits of the contract).
HEADLINE_MAX, DESCRIPTION_MAX, SUGGESTION_MAX = 200, 2000, 1000


def synthetic_payloads(documents: DataFrame) -> DataFrame:
    """Verdict payload per document by formula (stands in for a model): doc_id, content (JSON array).

    Some entries use the item title, some an unknown id, some an illegal verdict.
    """
    ids = F.array(*[F.lit(i) for i in packs.ITEM_IDS])
    titles = F.array(*[F.lit(r[4]) for r in packs.CHECKLIST])
    d = F.col("doc_id")
    entry = lambda k: F.struct(
        F.when((d + k) % 11 == 0, "R-99").when((d + k) % 7 == 0, F.get(titles, k)).otherwise(F.get(ids, k)).alias("checklist_item_id"),
        F.get(F.array(*[F.lit(v) for v in ("pass", "problem", "uncertain", "maybe", "problem")]), F.pmod(d * 3 + k, F.lit(5)).cast("int")).alias("verdict"),
        F.get(F.array(F.lit("high"), F.lit("mid"), F.lit("low"), F.lit(None)), F.pmod(d + k * 2, F.lit(4)).cast("int")).alias("severity"),
        F.concat(F.lit("H"), k.cast("string")).alias("headline"),
        F.concat(F.lit("D"), d.cast("string"), F.lit("-"), k.cast("string")).alias("description"),
        F.concat(F.lit("S"), k.cast("string")).alias("suggestion"),
    )
    picked = F.filter(F.sequence(F.lit(0), F.lit(len(packs.ITEM_IDS) - 1)), lambda k: (d + k) % 3 != 0)
    return documents.select("doc_id", F.to_json(F.transform(picked, entry)).alias("content"))


def _entries(content: Column) -> Column:
    """Entries of a bare array or of {"findings": [...]} as array<variant>.

    A text that is no variant as a whole (an object that repeats a key) is taken apart first, so that only the entry
    with the repeated key is lost to the contract; a text that is no JSON has no entries.
    """
    whole = F.try_parse_json(content)
    shape = F.schema_of_variant(whole)
    direct = F.when(shape.startswith("ARRAY"), F.try_variant_get(whole, "$", "array<variant>")).when(shape.startswith("OBJECT"), F.try_variant_get(whole, "$.findings", "array<variant>"))
    pieces = F.coalesce(F.when(content.rlike(r"^\s*\["), F.from_json(content, "array<string>")), F.from_json(F.get_json_object(content, "$.findings"), "array<string>"))
    return F.when(whole.isNotNull(), direct).otherwise(F.transform(pieces, F.try_parse_json))


def parse_verdicts(payloads: DataFrame, content="content") -> DataFrame:
    """One row per entry with a ``valid`` flag; accepts a bare array or {"findings": [...]}.

    An entry is judged alone: one that is no object, lacks its id or verdict, or holds a value of another type or
    outside the vocabulary, is invalid and leaves the others alone.  Null counts as missing for the severity only.
    """
    rows = payloads.select("doc_id", F.posexplode_outer(_entries(F.col(content))).alias("mseq", "e")).filter(F.col("mseq").isNotNull())
    fields = ("checklist_item_id", "verdict", "severity", "headline", "description", "suggestion")
    at = {n: F.try_variant_get("e", f"$.{n}", "variant") for n in fields}
    kind = {n: F.schema_of_variant(at[n]) for n in fields}
    read = {n: F.when(kind[n] == "STRING", F.try_variant_get("e", f"$.{n}", "string")) for n in fields}
    valid = (
        read["checklist_item_id"].isNotNull()
        & F.coalesce(read["verdict"].isin(packs.VERDICTS), F.lit(False))
        & (kind["severity"].isNull() | (kind["severity"] == "VOID") | F.coalesce(read["severity"].isin(packs.SEVERITIES), F.lit(False)))
    )
    for n in fields[3:]:
        valid = valid & (kind[n].isNull() | (kind[n] == "STRING"))
    text = lambda n, most: F.left(F.coalesce(read[n], F.lit("")), F.lit(most)).alias(n)
    return rows.select(
        "doc_id",
        "mseq",
        read["checklist_item_id"].alias("raw_id"),
        read["verdict"].alias("verdict"),
        F.coalesce(read["severity"], F.lit("mid")).alias("severity"),
        text("headline", HEADLINE_MAX),
        text("description", DESCRIPTION_MAX),
        text("suggestion", SUGGESTION_MAX),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def parse_readings(readings: DataFrame, max_images=packs.IMAGES_MAX, max_bytes=packs.IMAGE_BYTES_MAX) -> DataFrame:
    """Readings (doc_id, img_idx, byte_size, content JSON) that say something: values and concern beside their other columns.

    Only the first ``max_images`` images of a document are read; images without bytes and oversized ones are skipped
    (limits of the feature).  A content that is no object, or without a value and a concern, says nothing; so does a null
    number or size.  Values of any kind are taken as text; blank ones and null go.  One pass, no shuffle.
    """
    read = (F.col("img_idx").between(0, max_images - 1)) & F.col("byte_size").between(1, max_bytes)
    parsed = readings.filter(read).withColumn("p", F.from_json("content", "struct<values:array<string>,concern:string>"))
    values = F.filter(F.coalesce("p.values", F.array().cast("array<string>")), lambda v: v.isNotNull() & (strip(v) != ""))
    out = parsed.withColumns({"values": F.slice(values, 1, packs.IMAGE_VALUES_MAX), "concern": F.nullif("p.concern", F.lit(""))}).drop("p", "content", "byte_size")
    return out.filter((F.size("values") > 0) | F.col("concern").isNotNull())


def image_texts(img_idx: Column, caption: Column, values: Column, concern: Column) -> tuple[Column, Column]:
    """Headline and description of the finding that a reading becomes."""
    fill = lambda text, value: F.replace(F.lit(text), F.lit("{0}"), value)
    label = F.coalesce(F.nullif(caption, F.lit("")), fill(packs.IMAGE_LABEL, (img_idx + 1).cast("string")))
    found = fill(packs.IMAGE_VALUES, F.when(F.size(values) > 0, F.array_join(values, "、")).otherwise(packs.IMAGE_NO_VALUES))
    doubt = F.coalesce(fill(packs.IMAGE_DOUBT, concern), F.lit(""))
    return fill(packs.IMAGE_HEADLINE, label), F.concat(found, doubt, F.lit(packs.IMAGE_ENDING))


def image_findings(readings: DataFrame, max_images=packs.IMAGES_MAX, max_bytes=packs.IMAGE_BYTES_MAX) -> DataFrame:
    """Findings of readings that carry their image's caption and anchor, without a review (see plans.review for one)."""
    kept = parse_readings(readings, max_images, max_bytes)
    headline, description = image_texts(F.col("img_idx"), F.col("caption"), F.col("values"), F.col("concern"))
    return kept.select(
        "doc_id", "img_idx", F.lit(packs.IMAGE_ITEM).alias("item_id"), F.lit("uncertain").alias("verdict"),
        headline.alias("headline"), description.alias("description"), "anchor", F.size("values").alias("n_values"),
    )
