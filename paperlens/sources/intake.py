"""Raw documents and pages to ordered blocks (array<struct<idx,text,style>> per document).

A document is one input cell, so its blocks stay in one row and one task: everything up to
the findings table is a map over documents with no shuffle and no group to be skewed.
"""

from pyspark.sql import DataFrame, functions as F

from paperlens import packs
from paperlens.functions.text import cs, strip


def read(spark, sf_dir, table) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input with fewer splits than cores; a large scan is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 3) if df.rdd.getNumPartitions() < cores else df


def unnest(df: DataFrame, array, *keep, pos=None) -> DataFrame:
    """Rows of an array<struct> column beside the kept columns.

    The outer form plus a filter on the generated column is deliberate: plain ``explode`` makes
    the optimizer derive ``size(array) > 0`` and push it below the projections that compute the
    array, which evaluates the whole expression twice.
    """
    if pos is None:
        out = df.select(*keep, F.explode_outer(array).alias("_u"))
        return out.filter(F.col("_u").isNotNull()).select(*keep, "_u.*")
    out = df.select(*keep, F.posexplode_outer(array).alias(pos, "_u"))
    return out.filter(F.col("_u").isNotNull()).select(*keep, pos, "_u.*")


def text_blocks(documents: DataFrame) -> DataFrame:
    """Plain text: one block per line; blank lines keep their index."""
    return documents.select(
        "doc_id",
        "source",
        F.transform(
            F.split("text", "\n"),
            lambda t, i: F.struct(i.alias("idx"), t.alias("text"), F.lit("Normal").alias("style")),
        ).alias("blocks"),
    )


def overlay_blocks(documents: DataFrame, bank=packs.BANK, headings=packs.HEADINGS) -> DataFrame:
    """Documents with methodology text woven in: line i becomes block 3i, a bank sentence or
    heading block 3i+1, and block 3i+2 is a table row after a table caption, otherwise blank.

    The choice is arithmetic on (doc_id, i), so any SQL engine can rebuild the same table.
    """
    bank_col = F.array(*[F.lit(b) for b in bank])
    head_text = F.array(*[F.lit(t) for t, _ in headings])
    head_style = F.array(*[F.lit(s) for _, s in headings])

    n = packs.BLOCKS_PER_LINE

    def weave(line, i):
        pick = F.pmod(F.col("doc_id") * packs.BANK_STRIDE_DOC + i * packs.BANK_STRIDE_LINE, F.lit(len(bank))).cast("int")
        head = F.pmod(F.col("doc_id") + F.floor(i / packs.HEADING_EVERY), F.lit(len(headings))).cast("int")
        is_head = i % packs.HEADING_EVERY == 0
        return F.array(
            F.struct((i * n).alias("idx"), line.alias("text"), F.lit("Normal").alias("style")),
            F.struct(
                (i * n + 1).alias("idx"),
                F.when(is_head, F.get(head_text, head)).otherwise(F.get(bank_col, pick)).alias("text"),
                F.when(is_head, F.get(head_style, head)).otherwise(F.lit("Normal")).alias("style"),
            ),
            F.struct(
                (i * n + 2).alias("idx"),
                F.when(~is_head & (pick == packs.TABLE_CAPTION_PICK), packs.TABLE_ROW).otherwise("").alias("text"),
                F.lit("Normal").alias("style"),
            ),
        )

    return documents.select("doc_id", "source", F.flatten(F.transform(F.split("text", "\n"), weave)).alias("blocks"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """HTML: block tags become line breaks, h1..h6 become styled headings, other tags go."""
    body = F.regexp_replace("html", r"(?is)<(script|style|title|head)\b.*?</\1>|<!--.*?-->", "")
    marked = F.regexp_replace(body, r"(?i)<h([1-6])[^>]*>", "\n\u0001$1")
    marked = F.regexp_replace(marked, r"(?i)</?(?:p|div|li|ul|ol|tr|table|br|article|section|nav|footer|header|h[1-6])\b[^>]*>", "\n")
    plain = F.regexp_replace(marked, r"<[^>]*>", "")
    return pages.select(
        F.col("page_id").alias("doc_id"),
        F.col("url").alias("source"),
        F.transform(
            F.split(plain, "\n"),
            lambda t, i: F.struct(
                i.alias("idx"),
                F.regexp_replace(t, r"^\u0001[1-6]", "").alias("text"),
                F.when(t.rlike(r"^\u0001[1-6]"), F.concat(F.lit("Heading "), F.substr(t, F.lit(2), F.lit(1)))).otherwise("Normal").alias("style"),
            ),
        ).alias("blocks"),
    )


def admission(files: DataFrame, max_mb=50, max_pages=0, allowed=(".docx",), magic="PK\u0003\u0004") -> DataFrame:
    """Reject code of each upload; the first failing screen wins, null means accepted.

    Input columns: name, size, head, total_bytes, packed_bytes, pages.
    """
    ext = F.when(F.instr("name", ".") > 0, F.concat(F.lit("."), F.element_at(F.split(F.lower("name"), r"\."), -1))).otherwise("")
    limit = packs.MAX_UNCOMPRESSED_MB * 1024 * 1024
    code = (
        F.when(ext == ".pdf", "pdf_not_supported")
        .when(~ext.isin(*allowed), "unsupported_file_type")
        .when(F.col("size") <= 0, "empty_file")
        .when(F.col("size") > max_mb * 1024 * 1024, "file_too_large")
        .when(~F.col("head").startswith(magic), "file_content_mismatch")
        .when(
            (F.col("total_bytes") > limit) | (F.col("total_bytes") / F.greatest("packed_bytes", F.lit(1)) > packs.MAX_RATIO),
            "file_too_large_uncompressed",
        )
        .when((F.lit(max_pages) > 0) & (F.col("pages") > max_pages), "too_many_pages")
    )
    return files.withColumn("reject_code", code)


def page_uploads(pages: DataFrame) -> DataFrame:
    """Web pages in the shape ``admission`` screens: path as file name, markup over text as packing ratio."""
    plain = F.length(F.regexp_replace("html", r"<[^>]*>", ""))
    return pages.select(
        "page_id",
        F.regexp_replace("url", r"[?#].*$", "").alias("name"),
        F.length("html").alias("size"),
        F.left("html", F.lit(15)).alias("head"),
        F.length("html").alias("total_bytes"),
        plain.alias("packed_bytes"),
        F.regexp_count("html", F.lit("<p>")).alias("pages"),
    )


def block_rows(blocks: DataFrame) -> DataFrame:
    """One row per non-blank block; blank blocks only consume their index."""
    return (
        unnest(blocks, "blocks", "doc_id")
        .select("doc_id", F.col("idx").alias("para_idx"), "style", strip(F.col("text")).alias("text"))
        .filter(F.col("text").rlike(cs(r"\S")))
    )
