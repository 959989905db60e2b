"""Benchmark decontamination over a positional inverted index.

`build_index` turns documents into index blocks of about `BLOCK_WORDS` words: a block holds, for every distinct word, the
sorted list of its positions.  Blocks are independent, are stored once in the shared folder and serve any benchmark.
`search` runs test windows against every block: a window's terms are taken from the rarest of the block upwards, each
list shifted by the term's offset and intersected with the starts that are left, which mostly ends after one or two
lists.  With `slop` > 0 a term may stand up to so many words from its place, which gives proximity matches.

Scale: no shuffle of text or postings; a block is the unit of work and of recovery.  Windows travel to the tasks in
parts of at most `PART` windows, so what is sent at once is bounded whatever the benchmark's size; each part reads the
stored index again.  A hot word only lengthens lists that are intersected last.

Defined cases: a null or empty text has no words, is never contaminated and matches no item; an item without words has
no window; a null item_id counts as the id "null"; items that repeat an id count once.  Repeated document rows give one
row each; a text longer than a block is a block of its own.  Extra columns are ignored unless named in `keep`.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paperlens.llm.common import pack, stored, unpack

WINDOW = 10
BLOCK_WORDS = 1 << 20
PART = 200_000
BLANK = 32
#: Lower-cases A-Z and blanks every byte that is in no word: 00-2F, 3A-60, 7B-7F after lower-casing.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else BLANK for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text.  A character of two bytes or more has only bytes from 80 up, so bytes serve as characters."""
    return text.translate(FOLD).split() if text else []


def build_index(docs: DataFrame, text: str = "text", keep: str = "doc_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows: block, keys (the `keep` value of each document), n_words, terms, and packed posting ends and positions.

    A document's positions start after those of the one before, with a gap of one that no window crosses.
    """
    kind = dict(docs.dtypes)[keep]

    def blocks(batches):
        keys, lengths, tokens = [], [], []

        def flush():
            ids: dict[bytes, int] = {}
            local = np.fromiter((ids.setdefault(w, len(ids)) for w in tokens), np.int64, len(tokens))
            sizes = np.array(lengths, np.int64)
            at = np.arange(len(tokens)) + np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(local, kind="stable")
            ends = np.cumsum(np.bincount(local, minlength=len(ids)))
            row = [uuid.uuid4().hex], [keys], [lengths], [list(ids)], [pack(ends)], [pack(at[order])]
            columns = [pa.array(row[0]), pa.array(row[1], pa.list_(key_type)), pa.array(row[2], pa.list_(pa.int32())), pa.array(row[3], pa.list_(pa.binary())), pa.array(row[4], pa.binary()), pa.array(row[5], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "keys", "n_words", "terms", "ends", "positions"])

        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = words(t)
                keys.append(key)
                lengths.append(len(found))
                tokens += found
                if len(tokens) >= block_words:
                    yield flush()
                    keys, lengths, tokens = [], [], []
        if keys:
            yield flush()

    schema = f"block string, keys array<{kind}>, n_words array<int>, terms array<binary>, ends binary, positions binary"
    return docs.select(keep, F.col(text).cast("string")).mapInArrow(blocks, schema)


def test_windows(benchmark: DataFrame, size: int = WINDOW, text: str = "text", item: str = "item_id") -> DataFrame:
    """Distinct windows of the benchmark: words (array) and items (ids of the items that hold it, as text)."""

    def cut(batches):
        for batch in batches:
            ids, out = [], []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = words(t)
                for i in range(max(1, len(found) - size + 1) if found else 0):
                    ids.append(key)
                    out.append(b" ".join(found[i : i + size]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())], names=["item", "window"])

    key = F.coalesce(F.col(item).cast("string"), F.lit("null"))
    rows = benchmark.select(key, F.col(text).cast("string")).mapInArrow(cut, "item string, window string").distinct()
    return rows


def block_matches(keys, n_words, terms, ends, positions, windows, slop):
    """(document number, first word, window number) of every match inside a block."""
    slot = {w: i for i, w in enumerate(terms)}
    starts = np.cumsum(n_words + 1) - n_words - 1
    found = []
    for number, window in enumerate(windows):
        try:
            own = [slot[w] for w in window]
        except KeyError:
            continue
        by_size = sorted(range(len(own)), key=lambda k: ends[own[k]] - (ends[own[k] - 1] if own[k] else 0))
        at = None
        for k in by_size:
            t = own[k]
            here = positions[ends[t - 1] if t else 0 : ends[t]]
            if at is None:
                at = here - k
                continue
            near = np.searchsorted(here, at + k - slop)
            near[near == len(here)] = len(here) - 1
            at = at[np.abs(here[near] - at - k) <= slop]
            if not len(at):
                break
        if len(at):
            doc = np.searchsorted(starts, at, "right") - 1
            inside = (at >= starts[0]) & (at - starts[doc] + len(window) <= n_words[doc])
            found += [(int(d), int(a), number) for d, a in zip(doc[inside], (at - starts[doc])[inside])]
    return found


def search(index: DataFrame, windows: DataFrame, slop: int = 0, part: int = PART) -> DataFrame:
    """One row per document row of the index: block, number (in the block), key, n_words, spans (item, at, n).

    `windows` has one row per (item, window), words joined by spaces.
    """
    total = windows.count()
    parts = max(1, -(-total // part))
    key_type = dict(index.dtypes)["keys"][6:-1]
    schema = f"block string, number int, key {key_type}, n_words int, spans array<struct<item:string,at:int,n:int>>"
    out = None
    for p in range(parts):
        mine = windows if parts == 1 else windows.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == p)
        held: dict[tuple[bytes, ...], list[str]] = {}
        for row in mine.collect():
            held.setdefault(tuple(row["window"].encode().split()), []).append(row["item"])
        found = index.mapInArrow(searching(sorted(held.items()), slop, p == 0), schema)
        out = found if out is None else out.unionByName(found)
    if parts > 1:
        whole = F.flatten(F.collect_list("spans"))
        out = out.groupBy("block", "number").agg(F.first("key", ignorenulls=True).alias("key"), F.max("n_words").alias("n_words"), whole.alias("spans"))
    return out


def searching(held, slop, all_rows):
    windows, items = [w for w, _ in held], [i for _, i in held]
    span = pa.list_(pa.struct([("item", pa.string()), ("at", pa.int32()), ("n", pa.int32())]))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n_words = np.array(row["n_words"], np.int64)
                spans = [[] for _ in row["keys"]]
                for d, at, w in block_matches(row["keys"], n_words, row["terms"], unpack(row["ends"]), unpack(row["positions"]), windows, slop):
                    spans[d] += [{"item": i, "at": at, "n": len(windows[w])} for i in items[w]]
                rows = [d for d, s in enumerate(spans) if all_rows or s]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]] * len(rows), pa.string()),
                        pa.array(rows, pa.int32()),
                        pa.array([row["keys"][d] for d in rows], batch.column(1).type.value_type),
                        pa.array([row["n_words"][d] for d in rows], pa.int32()),
                        pa.array([spans[d] for d in rows], span),
                    ],
                    names=["block", "number", "key", "n_words", "spans"],
                )

    return run


def covered(spans: Column) -> Column:
    """Words inside any span: a walk over the spans in order of their starts."""
    ordered = F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s["at"].alias("at"), (s["at"] + s["n"]).alias("end")))))
    return F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["at"]))).alias("n")
        ),
        lambda a: a["n"],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, keep: str = "doc_id") -> DataFrame:
    """One row per document row: the key, n_words, spans, n_hit, items (distinct ids in text order), contaminated."""
    index = stored(build_index(docs, keep=keep), "token-index")
    found = search(index, test_windows(benchmark, window), slop)
    out = found.select(F.col("key").alias(keep), F.col("n_words").cast("bigint").alias("n_words"), "spans")
    out = out.withColumns({"n_hit": covered(F.col("spans")), "items": F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"])))})
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` without a benchmark window; all columns pass through.

    Only the keys of contaminated rows move to the documents.  Rows that share a contaminated doc_id are looked at by
    their texts' hash too, so that a clean row does not go for another's sake.
    """
    keyed = docs.withColumn("_key", F.struct("doc_id", F.xxhash64("text").alias("h")).cast("struct<doc_id:string,h:bigint>").cast("string"))
    found = decontaminate(keyed, benchmark, window, keep="_key").filter("contaminated").select("_key").distinct()
    return keyed.join(found, "_key", "left_anti").drop("_key")
