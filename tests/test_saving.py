"""Rows kept by id: the latest version wins, replays change nothing."""

from paperlens.sources.sinks import read_latest, save_latest
from paperlens.streaming.intake_stream import read_reviewed, review_stream

KIND = "doc_id bigint, v string"


def test_latest_wins(spark, tmp_path):
    path = f"{tmp_path}/kept"

    def save(version, rows):
        df = spark.createDataFrame(rows, KIND)
        save_latest(df, df, path, version, buckets=3)
        return sorted(map(tuple, read_latest(spark, path).collect()), key=str)

    first = [(1, "a"), (1, "b"), (2, "c"), (None, "n"), *((k, "x") for k in range(10, 40))]
    want = sorted(first, key=str)
    assert save(0, first) == want
    assert save(0, first) == want  # the batch again
    want = sorted([r for r in first if r[0] not in (1, None)] + [(1, "z"), (None, "m")], key=str)
    assert save(1, [(1, "z"), (None, "m")]) == want
    assert save(0, first) == want  # an earlier batch, replayed
    assert save(2, [(2, "c2"), (50, "new")]) == sorted([r for r in want if r[0] != 2] + [(2, "c2"), (50, "new")], key=str)
    assert len(save(3, [])) == len(want) + 1


def test_a_document_that_comes_twice_has_one_review(spark, tmp_path):
    d, kind = str(tmp_path), "doc_id bigint, text string, source string"
    for rows in ([(1, "准确率 0.9。", "s"), (2, "普通文本。", "s")], [(1, "本文综述研究进展。", "s"), (3, "普通文本。", "s"), (3, "普通文本。", "s")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{d}/in")
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
        review_stream(stream, f"{d}/out", f"{d}/log").awaitTermination()
    kinds = {(r.doc_id, r.paper_type): r["count"] for r in read_reviewed(spark, f"{d}/out").groupBy("doc_id", "paper_type").count().collect()}
    assert set(kinds) == {(1, "review"), (2, "unknown"), (3, "unknown")} and kinds[2, "unknown"] == kinds[3, "unknown"]
    review_stream(spark.readStream.schema(kind).parquet(f"{d}/in"), f"{d}/out", f"{d}/log-of-a-rerun").awaitTermination()
    assert read_reviewed(spark, f"{d}/out").filter("doc_id = 3").count() == kinds[3, "unknown"]
