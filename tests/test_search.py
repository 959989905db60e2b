"""Top-k search by blocks against brute force."""

import random

import pytest

from paperlens.operators import search_index

CHUNK = "doc_id bigint, pos int, para_idx int, tokens array<string>"


def corpus(rnd):
    # a few words are everywhere, most are rare; whole chunks repeat
    words = [f"w{i}" for i in range(60)]
    pick = lambda n: sorted({words[min(int(rnd.expovariate(0.12)), 59)] for _ in range(n)})
    chunks = [(i // 5, i % 5, i % 7, pick(rnd.randint(0, 14))) for i in range(400)]
    chunks += [(*c[:2], rnd.randint(0, 6), chunks[3][3]) for c in chunks[:60]] + [(None, 0, 0, chunks[3][3]), (9, 9, 9, None)]
    queries = [(i, " ".join(pick(rnd.randint(1, 9)))) for i in range(30)] + [(90, None), (91, "!!"), (92, "absent words"), (0, "w0 w1"), (93, " ".join(chunks[3][3]))]
    return chunks, queries


def brute(chunks, queries, k, least):
    want = []
    for key, text in queries:
        terms = {t for t in (text or "").split() if t[:1].isalpha() and len(t) > 1}
        hits = [(-len(terms & set(c[3] or [])), c[2], c[0] is not None, c[0] or 0, c[1]) for c in chunks]
        want += [(key, None if not h[2] else h[3], h[4], h[1], -h[0]) for h in sorted(h for h in hits if -h[0] >= max(1, least))[:k]]
    return want


@pytest.mark.parametrize("block,size,k,least", [(4096, 4096, 4, 1), (16, 4096, 4, 1), (16, 7, 1, 1), (50, 3, 20, 3)])
def test_search_matches_brute_force(spark, monkeypatch, block, size, k, least):
    monkeypatch.setattr(search_index, "BLOCK", block)
    monkeypatch.setattr(search_index, "SET", size)
    chunks, queries = corpus(random.Random(k))
    queries = [q for q in queries if q[0] != 0 or q[1] != "w0 w1"]
    blocks = search_index.index_blocks(spark.createDataFrame(chunks, CHUNK))
    asked = spark.createDataFrame(queries, "query_id bigint, text string")
    got = search_index.search(blocks, asked, k, least)
    rows = got.orderBy("query_id", "rank").collect()
    assert sorted((r.query_id, r.rank, r.overlap, r.para_idx) for r in rows) == sorted((q, n, o, p) for q, n, o, p in numbered(brute(chunks, queries, k, least)))
    assert sorted(map(str, ((r.query_id, r.doc_id, r.pos, r.para_idx, r.overlap) for r in rows))) == sorted(map(str, brute(chunks, queries, k, least)))
    assert search_index.search(blocks.limit(0), asked, k).count() == 0 and search_index.search(blocks, asked.limit(0), k).count() == 0


def numbered(rows):
    seen = {}
    for q, _, _, para, overlap in rows:
        seen[q] = seen.get(q, 0) + 1
        yield q, seen[q], overlap, para


def test_only_the_best_are_shuffled(spark, tmp_path):
    chunks, queries = corpus(random.Random(1))
    tasks, k = 6, 2
    spark.createDataFrame(queries, "query_id bigint, text string").write.parquet(f"{tmp_path}/queries")
    search_index.index_blocks(spark.createDataFrame(chunks, CHUNK).repartition(tasks)).write.parquet(f"{tmp_path}/blocks")
    blocks, asked = spark.read.parquet(f"{tmp_path}/blocks"), spark.read.parquet(f"{tmp_path}/queries")
    kept = search_index.scanned(blocks, asked, k)
    assert 0 < kept.count() <= tasks * k * len(queries)
    # the blocks stay where they are: the sets of queries go to them
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("hashpartitioning") == 1
