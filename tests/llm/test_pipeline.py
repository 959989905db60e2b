"""The pipeline's stages: what each must drop, and what it must leave alone."""

from pyspark.sql import functions as F

import corpus_pipeline
from paperlens.llm import decontaminate, near


def test_stages(corpus, nothing, spark, tmp_path):
    docs, rows = corpus
    d = str(tmp_path)
    piece = " ".join(rows[10][1].split()[:14])
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, piece), (2, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns and stage(spark, nothing, d).count() == 0
    lines = corpus_pipeline.repeated_lines(spark, docs, d)
    assert lines.count() == len(rows)
    single = corpus_pipeline.near_duplicates(spark, docs, d)
    # exactly one row of every group, by a brute-force grouping of the fingerprints
    fp = {r.text: r.fp for r in near.fingerprints(docs.select("text", F.col("text").alias("whole")), "whole", "text").collect()}
    root = linked(set(fp.values()), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert sorted(root[fp[r.text]] for r in single.collect()) == sorted(set(root.values()))
    bad = {r.doc_id for r in decontaminate.decontaminate(docs, spark.read.parquet(f"{d}/benchmark.parquet")).filter("contaminated").collect()}
    clean = corpus_pipeline.benchmark_passages(spark, docs, d)
    assert bad == {10} and sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(str(r[0]) for r in rows if r[0] not in bad)
    mixed = corpus_pipeline.mixed(spark, docs, d)
    assert mixed.filter("copies < 1 or taken <> copies * size").count() == 0 and mixed.agg(F.sum("taken")).first()[0] > 0
    # a whole run: null and repeated ids, and columns named as the operators name theirs
    own = {c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in ("n_lines", "n_kept", "toxic_score", "score", "fp", "_row", "bytes", "target", "key")}
    named = docs.withColumns(own)
    named.write.parquet(f"{d}/documents.parquet")
    out = corpus_pipeline.run(spark, d)
    assert set(out.columns) == set(mixed.columns) and 0 < out.count() <= len(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, named, d)
        assert kept.columns == named.columns and kept.count() > 0
        assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in kept.select("doc_id", *own).collect() for c in own), name
    empty = f"{d}/empty"
    nothing.write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def linked(nodes, near_enough):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near_enough(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}
