"""Language-model scores by deleted interpolation.

The probability of a word after another is a mixture of two maximum-likelihood estimates, c(v, w) / c(v) and c(w) / N,
and of 1 / (V + 1).  The mixture weights depend on how often the context v was seen (buckets of powers of two).  They are
learned by expectation-maximisation on a part of the training documents whose counts are left out ("deleted") from the
estimates; the scores then use the counts of all training documents.

1. Texts become blocks of about `BLOCK` tokens, stored once: the block's words and its tokens as numbers.
2. Every block counts its own words and word pairs and sends one row per count bucket; a bucket is a range of hashes, so
   words and pairs spread evenly, and a frequent one arrives once per block, not once per occurrence.  Buckets hold about
   `BUCKET` entries whatever the corpus' size, for their number follows the number of tokens.
3. A bucket adds up and answers every block with the totals, in the order of the block's request, without the keys.
4. Blocks meet their answers twice: for the EM statistics, and for the scores.

The EM statistics are counts of held-out tokens by context bucket and by both estimates in steps of a quarter power of
two; their number is bounded by the steps, and they cover every held-out token.

Words are compared as bytes.  A pair is a 64-bit hash: two pairs among n collide with probability n^2 / 2^65, which would
move a score slightly and no count of the contract.

Defined cases: null, empty and wordless texts hold the end token alone; a null key teaches nothing; without training
tokens every token has probability 1 (V = 0).  Each input row gives one row, repeated rows included.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from paperlens.llm.common import pack, stored, unpack

BLOCK = 1 << 20
BUCKET = 1 << 19
KEPT, HELD, UNSEEN = 0, 1, 2
#: Entries of a block's word list: the end of a text (a token), its start (only a context).
END, START = b"", b" "
STEPS = 4
LEAST_WEIGHT = 1e-6
ROUNDS = 100


def blocks(docs: DataFrame, part: Column, text: str = "text", keep: str = "doc_id", size: int = BLOCK) -> DataFrame:
    """block, keys, parts and n_tokens of its documents, words (compressed), ids (packed)."""

    def run(batches):
        kind, keys, parts, sizes, ids, held = None, [], [], [], [], {END: 0, START: 1}

        def flush():
            row = [uuid.uuid4().hex], [keys], [parts], [sizes], [squeeze(list(held))], [pack(np.array(ids, np.int64))]
            kinds = pa.string(), pa.list_(kind), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["block", "keys", "parts", "n_tokens", "words", "ids"])

        for batch in batches:
            kind = batch.column(0).type
            for key, t, p in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                found = t.lower().split() if t else []  # bytes: A-Z only; splits at 20 and 09 to 0D
                ids += [held.setdefault(w, len(held)) for w in found]
                ids.append(0)
                keys.append(key)
                parts.append(p)
                sizes.append(len(found) + 1)
                if len(ids) >= size:
                    yield flush()
                    keys, parts, sizes, ids, held = [], [], [], [], {END: 0, START: 1}
        if keys:
            yield flush()

    schema = f"block string, keys array<{dict(docs.dtypes)[keep]}>, parts array<int>, n_tokens array<bigint>, words binary, ids binary"
    return docs.select(keep, F.col(text).cast("string"), part.alias("part")).mapInArrow(run, schema)


class Block:
    """Arrays of one block: tokens and contexts (word numbers), and the distinct words and pairs in the order of their hashes."""

    def __init__(self, row: dict):
        self.words, self.sizes = spread(row["words"]), np.array(row["n_tokens"], np.int64)
        self.tokens = unpack(row["ids"])
        self.part = np.repeat(np.array(row["parts"], np.int64), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.contexts = np.concatenate(([1], self.tokens[:-1]))
        self.contexts[self.starts] = 1
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        self.word_order = np.argsort(hashes, kind="stable")
        self.word_hashes = hashes[self.word_order]
        mixed = hashes[self.contexts] * np.uint64(0x9E3779B97F4A7C15) + hashes[self.tokens]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.pair_hashes, self.pair_of = np.unique(mixed ^ (mixed >> np.uint64(32)), return_inverse=True)

    def counts(self, part: int):
        """Words and pairs of a part's documents, in hash order; the start counts as often as it is a context."""
        mine = self.part == part
        words = np.bincount(self.tokens[mine], minlength=len(self.words))
        words[1] = np.count_nonzero(self.part[self.starts] == part)
        return words[self.word_order], np.bincount(self.pair_of[mine], minlength=len(self.pair_hashes))


def edges(buckets: int) -> np.ndarray:
    """First hash of every bucket; buckets are equal ranges of hashes."""
    return np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)


def requests(held: DataFrame, buckets: int) -> DataFrame:
    """One row per block, kind (words or pairs) and bucket: what is counted, in hash order, and the block's own counts.

    Words travel as one compressed text, pairs as differences of neighbouring hashes, which are short.
    """
    names = ["kind", "bucket", "block", "entries", "kept", "held"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
    first = edges(buckets)

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                b, out = Block(row), []
                counts = [b.counts(KEPT), b.counts(HELD)]
                for kind, hashes in enumerate((b.word_hashes, b.pair_hashes)):
                    at = np.append(np.searchsorted(hashes, first), len(hashes))
                    for k in range(buckets):
                        i, j = at[k], at[k + 1]
                        if i < j:
                            steps = np.diff(hashes[i:j], prepend=first[k : k + 1])
                            entries = pack(steps) if kind else squeeze([b.words[w] for w in b.word_order[i:j]])
                            out.append((kind, k, row["block"], entries, pack(counts[0][kind][i:j]), pack(counts[1][kind][i:j])))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=names)

    return held.mapInArrow(run, "kind int, bucket int, block string, entries binary, kept binary, held binary")


def squeeze(words: list[bytes]) -> bytes:
    """Words hold no line break."""
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def spread(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


def add_up(table: pa.Table) -> pa.Table:
    """Totals of one bucket, dealt back to the blocks that asked; `types` counts its distinct training words."""
    kind = table.column("kind")[0].as_py()
    kept, held = ([unpack(x) for x in table.column(n).to_pylist()] for n in ("kept", "held"))
    ends = np.cumsum([len(x) for x in kept])
    entries = table.column("entries").to_pylist()
    if kind == 0:
        coded = pa.array([w for x in entries for w in spread(x)], pa.large_binary()).dictionary_encode()
        which, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    else:
        # counted from the bucket's first hash, which all of them share
        distinct, which = np.unique(np.concatenate([np.cumsum(unpack(x)) for x in entries]), return_inverse=True)
    totals = [np.bincount(which, np.concatenate(x), len(distinct)).astype(np.int64) for x in (kept, held)]
    learned = np.ones(len(distinct), bool) if kind else np.array([w != START for w in distinct])
    tokens, types = int((sum(totals) * learned).sum()), int(((sum(totals) > 0) & learned).sum())
    n = len(ends)
    dealt = [[pack(t[w]) for w in np.split(which, ends[:-1])] for t in totals]
    only_first = [0] * (n - 1)
    columns = {"kind": table.column("kind"), "bucket": table.column("bucket"), "block": table.column("block"), "kept": pa.array(dealt[0], pa.binary()), "held": pa.array(dealt[1], pa.binary())}
    own = int((totals[0] * learned).sum())
    return pa.table(columns | {"tokens": pa.array([tokens, *only_first]), "kept_tokens": pa.array([own, *only_first]), "types": pa.array([types, *only_first])})


ANSWERS = "kind int, bucket int, block string, kept binary, held binary, tokens bigint, kept_tokens bigint, types bigint"


def together(block: pa.Table, answers: pa.Table):
    """A block's arrays with the corpus totals of its words (by word number) and pairs (by pair number), kept and held."""
    b, found = Block(block.to_pylist()[0]), []
    rows = sorted(answers.select(["kind", "bucket", "kept", "held"]).to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
    for part in ("kept", "held"):
        words = np.zeros(len(b.words), np.int64)
        words[b.word_order] = np.concatenate([unpack(r[part]) for r in rows if r["kind"] == 0])
        found.append((words, np.concatenate([unpack(r[part]) for r in rows if r["kind"] == 1])))
    return b, *found


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count))."""
    return np.where(counts > 0, np.frexp(np.maximum(counts, 1).astype(np.float64))[1], 0)


def steps(p: np.ndarray) -> np.ndarray:
    """0 for a probability of 0, else 1 and up for quarter powers of two below 1."""
    return np.where(p > 0, 1 - np.round(np.log2(np.where(p > 0, p, 1)) * STEPS), 0).astype(np.int64)


def em(rows: list, types: int) -> dict[int, np.ndarray]:
    """Weights (pair, word, uniform) of every context bucket from its held-out tokens: (bucket, n, mean pair p, mean word p)."""
    weights = {}
    for bucket in sorted({r[0] for r in rows}):
        n = np.array([r[1] for r in rows if r[0] == bucket], np.float64)
        p = np.array([[r[2], r[3], 1 / (types + 1)] for r in rows if r[0] == bucket])
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            share = w * p
            share /= share.sum(axis=1, keepdims=True)
            w = np.maximum((n[:, None] * share).sum(axis=0) / n.sum(), LEAST_WEIGHT)
            w /= w.sum()
        weights[bucket] = w
    return weights


def by_bucket(weights: dict[int, np.ndarray]) -> np.ndarray:
    """Weights of all 65 buckets; one that had no held-out token takes those of the next smaller, else equal parts."""
    out, last = [], np.full(3, 1 / 3)
    for bucket in range(65):
        last = weights.get(bucket, last)
        out.append(last)
    return np.array(out)


def score(docs: DataFrame, part: Column, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """keep, n_tokens, n_known, train_tokens, base_score, score; `part` is KEPT, HELD (both taught) or UNSEEN."""
    key_kind = dict(docs.dtypes)[keep]
    held = stored(blocks(docs, part, text, keep), "token-blocks")
    n_tokens = held.agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    asked = requests(held, max(1, -(-n_tokens // BUCKET)))
    answers = stored(asked.groupBy("kind", "bucket").applyInArrow(add_up, ANSWERS), "count-answers")
    words = answers.filter("kind = 0").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "kept_tokens", "types"))).first()
    total, kept_total, types = (int(x) for x in words)
    met = held.groupBy("block").cogroup(answers.drop("tokens", "kept_tokens", "types").groupBy("block"))

    def statistics(block: pa.Table, found: pa.Table) -> pa.Table:
        b, kept, _ = together(block, found)
        mine = b.part == HELD
        seen = kept[0][b.contexts[mine]]
        pair = kept[1][b.pair_of[mine]] / np.maximum(seen, 1)
        word = kept[0][b.tokens[mine]] / max(kept_total, 1)
        cells, which = np.unique(context_bucket(seen) << 24 | steps(pair) << 12 | steps(word), return_inverse=True)
        n, pairs, words = (np.bincount(which, x, len(cells)) for x in (None, pair, word))
        return pa.table({"cell": cells, "n": n.astype(np.int64), "pairs": pairs.astype(float), "words": words.astype(float)})

    rows = met.applyInArrow(statistics, "cell bigint, n bigint, pairs double, words double")
    rows = rows.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs"), F.sum("words").alias("words"))
    rows = rows.orderBy("cell").collect()  # bounded by the steps, not by the corpus
    mixture = by_bucket(em([(r["cell"] >> 24, r["n"], r["pairs"] / r["n"], r["words"] / r["n"]) for r in rows], types))

    def scores(block: pa.Table, found: pa.Table) -> pa.Table:
        b, kept, out = together(block, found)
        words, pairs = kept[0] + out[0], kept[1] + out[1]
        c, seen = words[b.tokens], words[b.contexts]
        w = mixture[context_bucket(seen)]
        p = w[:, 0] * pairs[b.pair_of] / np.maximum(seen, 1) + w[:, 1] * c / max(total, 1) + w[:, 2] / (types + 1)
        if not total:
            p = np.ones(len(c))
        sums = [np.add.reduceat(x, b.starts) for x in ((c > 0).astype(np.int64), np.log10((c + 1) / (total + types + 1)), np.log10(p))]
        n = len(b.sizes)
        columns = [block.column("keys").combine_chunks().values, pa.array(b.sizes), pa.array(sums[0]), pa.array(np.full(n, total)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.table(dict(zip([keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"], columns)))

    return met.applyInArrow(scores, f"{keep} {key_kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
