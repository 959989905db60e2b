"""Top-k search by an inverted index in blocks.

A block holds up to `BLOCK` chunks: its terms, each with the postings of the chunks that hold it, and what orders equal
scores.  A score is the number of distinct query terms in a chunk over the square root of the query's length, so the terms
that a block holds of a query bound every score in it.  While a task scans its blocks it keeps the best k of every query;
with the k-th of them overlapping in t terms,

* a block with fewer than t of the query's m terms is skipped, and
* in a block with m' of them only chunks in the postings of the m' - t + 1 rarest can reach t: those are the candidates,
  and the frequent terms are only looked up for them.

What the rarest terms leave out cannot enter the best k, so the result is exact.  A task sends at most k rows a query.
Queries are dealt into sets of `SET`; Spark broadcasts them if they are small by its own check, else it shuffles blocks and
sets by the number of the set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from paperlens.functions.text import tokens

BLOCK, SET = 4096, 4096


def lists(flat: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)


def index_blocks(chunks: DataFrame) -> DataFrame:
    """chunks(doc_id, pos, para_idx, tokens) as blocks, in one pass without a shuffle; write it to search it often."""
    kind = chunks.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "pos", "para_idx", "terms", "starts", "postings"]

    def block(rows: pa.RecordBatch) -> pa.RecordBatch:
        held = rows.column("tokens").fill_null(pa.scalar([], pa.list_(pa.string())))
        coded = held.flatten().dictionary_encode()
        chunk = np.repeat(np.arange(rows.num_rows, dtype=np.int32), held.value_lengths().to_numpy(zero_copy_only=False))
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1)).astype(np.int32)
        one = lambda column: lists(column, np.array([0, len(column)]))
        columns = [one(rows.column(n)) for n in names[:3]]
        columns += [one(coded.dictionary), one(pa.array(starts)), one(pa.array(chunk[order]))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield block(batch.slice(at, BLOCK))

    rows = chunks.select("doc_id", F.col("pos").cast("int"), F.col("para_idx").cast("int"), "tokens")
    return rows.mapInArrow(run, f"doc_id array<{kind}>, pos array<int>, para_idx array<int>, terms array<string>, starts array<int>, postings array<int>")


def query_sets(queries: DataFrame, min_overlap: int) -> tuple[int, DataFrame]:
    """The number of sets, and queries(query_id, text) as rows of about `SET` queries; those without a term find nothing."""
    q = queries.select("query_id", tokens(F.coalesce("text", F.lit(""))).alias("terms")).filter(F.size("terms") >= max(1, min_overlap))
    n = max(1, -(-q.count() // SET))
    dealt = q.withColumn("set", F.pmod(F.xxhash64("query_id", "terms"), F.lit(n)).cast("int"))
    return n, dealt.groupBy("set").agg(F.collect_list(F.struct("query_id", "terms")).alias("queries"))


class Scan:
    """The best k of every query of a set, over the blocks of a task."""

    def __init__(self, queries: list[dict], k: int, least: int):
        self.queries, self.k, self.least = queries, k, least
        flat = [t for q in queries for t in q["terms"]]
        coded = pa.array(flat, pa.string()).dictionary_encode()
        self.vocabulary = coded.dictionary
        ends = np.cumsum([len(q["terms"]) for q in queries])
        self.terms = np.split(coded.indices.to_numpy(zero_copy_only=False), ends[:-1])
        self.best: list[list[tuple]] = [[] for _ in queries]

    def block(self, row: dict[str, pa.Array]):
        at = pc.index_in(self.vocabulary, row["terms"]).fill_null(-1).to_numpy(zero_copy_only=False)
        starts, postings = row["starts"].to_numpy(zero_copy_only=False), row["postings"].to_numpy(zero_copy_only=False)
        para, pos = row["para_idx"].fill_null(-1).to_numpy(zero_copy_only=False), row["pos"].to_numpy(zero_copy_only=False)
        for i, mine in enumerate(self.terms):
            best = self.best[i]
            # who joins a full list must reach the last of it
            need = max(self.least, -best[-1][0]) if len(best) == self.k else self.least
            here = at[mine]
            here = here[here >= 0]
            if len(here) < need:
                continue
            here = here[np.argsort(starts[here + 1] - starts[here])]
            rare = len(here) - need + 1
            counts = np.bincount(np.concatenate([postings[starts[t] : starts[t + 1]] for t in here[:rare]]), minlength=len(pos))
            found = np.flatnonzero(counts)
            overlap = counts[found]
            for n, t in enumerate(here[rare:]):
                held = postings[starts[t] : starts[t + 1]]
                place = np.minimum(np.searchsorted(held, found), len(held) - 1)
                overlap = overlap + (held[place] == found)
                # those that the terms still to come cannot lift
                able = overlap + (len(here) - rare - n - 1) >= need
                found, overlap = found[able], overlap[able]
            able = overlap >= need
            found, overlap = found[able], overlap[able]
            if len(found) > self.k:  # ties at the k-th stay
                able = overlap >= np.partition(overlap, len(overlap) - self.k)[-self.k]
                found, overlap = found[able], overlap[able]
            if len(found) > self.k:
                edge = overlap.min()
                tied = np.flatnonzero(overlap == edge)
                last = np.sort(para[found[tied]])[min(self.k, len(tied)) - 1]
                able = (overlap > edge) | (para[found] <= last)
                found, overlap = found[able], overlap[able]
            rows = [(-int(o), int(para[c]), row["doc_id"][int(c)].as_py(), int(pos[c])) for c, o in zip(found, overlap)]
            best.extend(rows)
            best.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] if r[2] is not None else 0, r[3]))
            del best[self.k :]


def scanned(blocks: DataFrame, queries: DataFrame, top_k: int, min_overlap: int = 1) -> DataFrame:
    """query_id, doc_id, pos, para_idx, overlap, n_terms: of every task the best chunks that it saw, `top_k` a query."""
    key, doc = queries.schema["query_id"].dataType.simpleString(), blocks.schema["doc_id"].dataType.elementType.simpleString()
    n_sets, sets = query_sets(queries, min_overlap)
    joined = blocks.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(n_sets - 1)))).join(sets, "set")
    names = ["query_id", "doc_id", "pos", "para_idx", "overlap", "n_terms"]
    schema = f"query_id {key}, doc_id {doc}, pos int, para_idx int, overlap bigint, n_terms int"

    def run(batches):
        scans: dict[int, Scan] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("set")[i].as_py()
                if number not in scans:
                    scans[number] = Scan(batch.column("queries")[i].as_py(), top_k, max(1, min_overlap))
                scans[number].block({n: batch.column(n)[i].values for n in ("doc_id", "pos", "para_idx", "terms", "starts", "postings")})
        for scan in scans.values():
            rows = [(q["query_id"], r[2], r[3], r[1], -r[0], len(q["terms"])) for q, best in zip(scan.queries, scan.best) for r in best]
            columns = [pa.array(c) for c in zip(*rows)] if rows else []
            if columns:
                yield pa.RecordBatch.from_arrays(columns, names=names).cast(target)

    target = to_arrow_schema(StructType.fromDDL(schema))
    return joined.mapInArrow(run, schema)


def search(blocks: DataFrame, queries: DataFrame, top_k: int, min_overlap: int = 1) -> DataFrame:
    """query_id, doc_id, pos, para_idx, overlap, score, rank: the best chunks of each query, ordered by score, paragraph,
    document and place.  A null or wordless query finds nothing; a null document id comes first among equals."""
    found = scanned(blocks, queries, top_k, min_overlap).withColumn("score", F.col("overlap") / F.sqrt("n_terms"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "para_idx", "doc_id", "pos")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).drop("n_terms")
