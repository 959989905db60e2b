"""Method-section excerpts from HTML pages."""

from pyspark.sql import Column, DataFrame, functions as F

from paperlens import packs
from paperlens.functions.text import strip
from paperlens.sources.intake import html_blocks


def excerpts(pages: DataFrame, keys=packs.SECTION_KEYS, min_para=packs.EXCERPT_MIN_PARA, min_fallback=packs.EXCERPT_MIN_FALLBACK, limit=packs.EXCERPT_MAX) -> DataFrame:
    """Text of the sections with a method-like title, else of all long paragraphs, cut to the excerpt size."""
    b = html_blocks(pages)
    rows = F.transform("blocks", lambda x: F.struct(F.regexp_replace(strip(x["text"]), r"\s+", " ").alias("t"), x["style"].startswith("Heading").alias("h")))
    b = b.withColumn("rows", F.filter(rows, lambda r: r["t"] != ""))
    title_ok = lambda t: F.lower(t).rlike("(" + "|".join(keys) + ")")

    def take(minimum: int, everywhere: bool) -> Column:
        # sections are separated by a newline, paragraphs of one section by a space
        def step(s, r):
            use = ~r["h"] & (s["on"] | F.lit(everywhere)) & (F.length(r["t"]) > minimum)
            gap = F.when(s["fresh"] & ~F.lit(everywhere), "\n").otherwise(" ")
            return F.struct(
                F.when(r["h"], title_ok(r["t"])).otherwise(s["on"]).alias("on"),
                (r["h"] | (s["fresh"] & ~use)).alias("fresh"),
                F.when(use & s["text"].isNotNull(), F.concat(s["text"], gap, r["t"])).when(use, r["t"]).otherwise(s["text"]).alias("text"),
            )

        start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("fresh"), F.lit(None).cast("string").alias("text"))
        return F.aggregate("rows", start, step, lambda s: F.coalesce(s["text"], F.lit("")))

    b = b.withColumns({"picked": take(min_para, False), "all_text": take(min_fallback, True)})
    full = F.when(F.col("picked") != "", F.col("picked")).otherwise(F.col("all_text"))
    return b.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), (F.col("picked") != "").alias("from_section"), F.left(full, F.lit(limit)).alias("excerpt"))
