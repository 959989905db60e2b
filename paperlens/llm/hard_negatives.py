"""Hard negatives of anchors by a residue-number-system matrix product.

Scores are exact inner products of whole-number vectors, though all products run in float32: the component matrices are
reduced modulo several small primes, multiplied modulo each of them (panels of `PANEL` components keep every sum below
2**24, which float32 holds exactly), and the signed scores are put together from the residues by Chinese remaindering
with balanced digits.  The primes are as many as the largest possible score needs, by the norms of all rows.

1. Rows get a number of their own and are stored once.
2. Anchors, dealt into sets, meet all rows, dealt into groups, on a grid: each cell holds one set and one group, of
   bounded size.  A cell keeps of every anchor only its best rows of the same label.  A window over what the cells kept
   gives each anchor's positives.
3. On the same grid, with the positives, a cell keeps of every (anchor, positive) the best rows of other labels whose
   score lies in the pair's window of scores.  A window over these gives the negatives.

Rows are dealt by their number, so no label, copy or score makes a cell large.  A row is shuffled once per set of
anchors, an anchor once per group of rows; scores never leave a cell, but for the few kept.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part; a null id is no anchor
and comes last among equal scores; rows that repeat an id or a vector are rows of their own (each is the other's
candidate), and repeated anchors each give rows; vectors that are shorter than the longest end in zeros; equal scores go
by id; other columns are not read; no anchor, or none with positives and negatives, gives no row.  Scores that a bigint
might not hold end the job with an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlens.llm.common import stored
from paperlens.llm.vectors import matrix, shape, usable, whole

#: Anchors of a set, rows of a group, and rows whose scores a task holds at once.
SET, GROUP, SLICE = 1 << 10, 1 << 16, 1 << 11
PANEL = 256
FLOAT32_WHOLE = 1 << 24
LAST = (1 << 63) - 1


def primes_for(width: int, bound: int) -> list[int]:
    """The largest odd primes whose residues a panel can sum in float32, until their product exceeds every signed score."""
    half = math.isqrt((FLOAT32_WHOLE - 1) // max(1, min(width, PANEL)))
    found, product, p = [], 1, min(2 * half + 1, 2047)
    while product <= 2 * bound + 1:
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """The residue of least size; the second step mends a quotient that was rounded to the wrong side."""
    p = np.float32(p)
    for _ in range(2):
        x = x - p * np.rint(x / p)
    return x


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [centred(np.remainder(x, p).astype(np.float32), p) for p in primes]


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The exact scores of the rows of `a` with the rows of `b`, given by their residues."""
    digits: list[np.ndarray] = []
    total, weight = np.zeros((len(a[0]), len(b[0])), np.int64), 1
    for k, p in enumerate(primes):
        r = np.zeros(total.shape, np.float32)
        for at in range(0, a[k].shape[1], PANEL):
            r = centred(r + centred(a[k][:, at : at + PANEL] @ b[k][:, at : at + PANEL].T, p), p)
        # what the digits so far leave, divided by their product modulo p
        base = 1
        for d, q in zip(digits, primes):
            r = centred(r - centred(d * np.float32(signed(base, p)), p), p)
            base *= q
        digits.append(centred(r * np.float32(signed(pow(base, -1, p), p)), p))
        with np.errstate(over="ignore"):
            total += digits[k].astype(np.int64) * np.int64(signed(weight, 1 << 64))
        weight *= p
    return total


def signed(n: int, modulus: int) -> int:
    n %= modulus
    return n - modulus if 2 * n >= modulus else n


def best(scores: np.ndarray, wanted: np.ndarray, k: int):
    """(row, column) of the k highest wanted scores of every row; equal ones by column."""
    if scores.shape[1] > 4 * k:
        # all that reach the k-th highest, which includes ties
        held = np.where(wanted, scores, np.iinfo(np.int64).min)
        edge = np.partition(held, scores.shape[1] - k, axis=1)[:, -k]
        wanted = wanted & (held >= edge[:, None])
    rows, columns = np.nonzero(wanted)
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, np.arange(len(scores)))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], columns[keep]


def merge(kept: list[tuple], k: int) -> tuple:
    """Of (anchor, score, id, own number) of several slices the k best of every anchor."""
    anchor, score, key, own = (np.concatenate(x) for x in zip(*kept))
    order = np.lexsort((own, key, -score, anchor))
    anchor, score, key, own = (x[order] for x in (anchor, score, key, own))
    first = np.searchsorted(anchor, anchor)
    keep = np.arange(len(anchor)) - first < k
    return anchor[keep], score[keep], key[keep], own[keep]


def numbers(column) -> np.ndarray:
    return column.fill_null(LAST).to_numpy()


def cell(anchors: pa.Table, rows: pa.Table, width: int, primes: list[int], k: int, pairs: bool):
    """The k best rows of every anchor (same label), or of every one of its pairs (other label, score in the window)."""
    rows = rows.sort_by([("key", "ascending")])
    left = residues(matrix(anchors.column("x"), width, np.int64), primes)
    own, label = numbers(anchors.column("own")), numbers(anchors.column("label"))
    if pairs:
        windows = anchors.column("windows").to_pylist()
        of = np.array([i for i, w in enumerate(windows) for _ in w], np.int64)
        low, high = (np.array([p[n] for w in windows for p in w], np.int64)[:, None] for n in ("low", "high"))
        place = np.array([p["place"] for w in windows for p in w], np.int32)
    kept = []
    for at in range(0, rows.num_rows, SLICE):
        part = rows.slice(at, SLICE)
        scores = products(left, residues(matrix(part.column("x"), width, np.int64), primes), primes)
        same = label[:, None] == numbers(part.column("label"))
        if pairs:
            # anchor by anchor in pieces, so that the masks stay small
            for i in range(0, len(of), len(own)):
                s = scores[of[i : i + len(own)]]
                wanted = ~same[of[i : i + len(own)]] & (s >= low[i : i + len(own)]) & (s <= high[i : i + len(own)])
                r, c = best(s, wanted, k)
                kept.append((r + i, s[r, c], numbers(part.column("key"))[c], numbers(part.column("own"))[c]))
        else:
            r, c = best(scores, same & (own[:, None] != numbers(part.column("own"))), k)
            kept.append((r, scores[r, c], numbers(part.column("key"))[c], numbers(part.column("own"))[c]))
    r, score, key, other = merge(kept, k) if kept else (np.zeros(0, np.int64),) * 4
    anchor = of[r] if pairs else r
    columns = {"own": pa.array(own[anchor]), "place": pa.array(place[r] if pairs else np.zeros(len(r), np.int32))}
    columns["key"] = pa.array(key, mask=np.isin(other, numbers(rows.column("own"))[rows.column("key").is_null().to_numpy()]) & (key == LAST))
    return pa.table(columns | {"score": pa.array(score), "other": pa.array(other)})


CELL = "own bigint, place int, key bigint, score bigint, other bigint"


def on_grid(anchors: DataFrame, rows: DataFrame, sets: int, groups: int, width: int, primes: list[int], k: int, pairs: bool) -> DataFrame:
    """What all cells keep.  Numbers are dealt by hash, so sets and groups are even."""
    dealt = lambda n: F.pmod(F.xxhash64("own"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumn("set", dealt(sets)).withColumn("group", every(groups))
    rows = rows.toDF(*rows.columns)  # columns of its own, though both sides read one table
    r = rows.withColumn("group", dealt(groups)).withColumn("set", every(sets))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"own": pa.array([], pa.int64()), "place": pa.array([], pa.int32()), **{n: pa.array([], pa.int64()) for n in ("key", "score", "other")}})
        return cell(left, right, width, primes, k, pairs)

    return a.groupBy("set", "group").cogroup(r.groupBy("set", "group")).applyInArrow(run, CELL)


def first(kept: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of what the cells kept, numbered from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("key"), "other")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `is_anchor` is a condition on the input's columns.  A negative's score lies between `low` and `high` hundredths of the
    positive's.
    """
    held = rows.filter(F.col(label).isNotNull() & usable(vector)).select(
        F.col(key).cast("bigint").alias("key"), F.col(label).cast("bigint").alias("label"), whole(vector, scale).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("asks")
    )
    held = stored(held.withColumn("own", F.monotonically_increasing_id()), "vectors")
    n, width, bound = shape(held)
    if bound >= LAST:
        raise ValueError(f"scores of up to {bound:.3g} do not fit in a bigint")
    asking = held.filter("asks")
    primes = primes_for(width, int(bound))
    sets = max(1, -(-asking.count() // SET))
    groups = max(-(-n // GROUP), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    others = held.select("own", "key", "label", "x")
    grid = lambda a, k, pairs: on_grid(a, others, sets, groups, width, primes, k, pairs)
    found = first(grid(asking.select("own", "label", "x"), positives, False), ["own"], positives)
    found = stored(found.select("own", F.col("rank").alias("place"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # low * positive <= 100 * score <= high * positive, as bounds of the score
    share = lambda up, percent: F.expr(f"CAST({up}(CAST(positive_score AS DECIMAL(20,0)) * {int(percent)} / 100) AS DECIMAL(30,0))")
    clipped = lambda c: F.greatest(F.lit(-LAST), F.least(F.lit(LAST), c)).cast("bigint")
    window = F.struct("place", clipped(share("ceil", low)).alias("low"), clipped(share("floor", high)).alias("high"))
    pairs = found.groupBy("own").agg(F.sort_array(F.collect_list(window)).alias("windows"))  # `positives` entries at most
    kept = grid(asking.select("own", "label", "x").join(pairs, "own"), negatives, True)
    out = first(kept, ["own", "place"], negatives).withColumnRenamed("key", "negative_id").withColumnRenamed("score", "negative_score")
    out = out.join(found, ["own", "place"]).join(asking.select("own", F.col("key").alias("anchor_id")), "own")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
