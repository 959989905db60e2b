"""SimHash near-duplicates with vantage-point trees.

1. `fingerprints`: 64 bits per text; a bit is set if it is set in over half of the XXH64 values of the text's 3-word
   shingles.  Texts stream through one pass.
2. Distinct fingerprints are dealt to shards by a vantage-point tree.  A node holds a vantage point and a radius; a
   fingerprint is stored on its side of the radius.  As query it also visits the other side if its distance to the
   vantage point is within `radius` links of the border, for by the triangle inequality no partner lies there otherwise.
   The tree is fitted on at most `TREE_SAMPLE` fingerprints (a few hundred KB, whatever the corpus) and shipped to the
   tasks; every fingerprint is stored and searched.
3. A shard continues the tree over its own fingerprints down to `LEAF` and compares the rest by exclusive-or and bit
   count.  A shard that more than `CELL` fingerprints visit (the tree's size is bounded, the corpus is not) is a grid of
   cells, each of about `CELL` stored ones and `CELL` visitors, so a task's memory is bounded.  A cell returns a spanning forest of its links, at most one link per fingerprint it holds, never all pairs.
4. Components of the links, then the smallest doc_id of each.

Copies are one fingerprint, so a large group of copies adds nothing to the search.

Defined cases: null, empty and wordless texts have fingerprint zero and link like any other; a text of one or two words
is one shingle; a null doc_id is never the smallest unless its component has no other.  Each input row gives one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from paperlens.llm.common import stored
from paperlens.llm.components import components

SEED = 42
TREE_SAMPLE = 32_768
SHARD = 8_192
#: Fingerprints of each role in one cell of a shard.
CELL = 1 << 20
LEAF = 256
#: Fewer values of a text than this share one bit count; longer texts are counted in slices.
SLICE = 1 << 16


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of a UTF-8 text."""
    found = text.lower().split() if text else []  # bytes: A-Z only; splits at 20 and 09 to 0D
    if not found:
        return 0
    flat = b" ".join(found)
    if len(found) <= width:
        return xxhash.xxh64_intdigest(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    values = [digest(flat[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())]
    h, ones = np.array(values, "<u8"), np.zeros(64, np.int64)
    for i in range(0, len(h), SLICE):
        ones += np.unpackbits(h[i : i + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """keep, fp (the fingerprint as a bigint)."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[keep, "fp"])

    return docs.select(keep, F.col(text).cast("string")).mapInArrow(run, f"{keep} {dict(docs.dtypes)[keep]}, fp bigint")


def distance(a, b):
    return np.bitwise_count(a ^ b).astype(np.int64)


def split(values: np.ndarray, rng: np.random.Generator):
    """A vantage point and a radius that halve the values best, or None if no try parts them."""
    best = None
    for point in rng.choice(values, min(8, len(values)), replace=False):
        d = distance(values, point)
        mid = int(np.median(d))
        for radius in (mid, mid - 1):
            inside = int((d <= radius).sum())
            worst = max(inside, len(values) - inside)
            if worst < len(values) and (best is None or worst < best[0]):
                best = worst, point, radius
    return best and best[1:]


def grow(values: np.ndarray, leaves: int, rng=None):
    """Nested (point, radius, inner, outer) over a sample; a leaf is None."""
    rng = rng or np.random.default_rng(0)
    cut = split(values, rng) if leaves > 1 and len(values) > 1 else None
    if cut is None:
        return None
    point, radius = cut
    inside = distance(values, point) <= radius
    half = leaves // 2
    return point, radius, grow(values[inside], leaves - half, rng), grow(values[~inside], half, rng)


def route(tree, values: np.ndarray, slack: int, at: np.ndarray | None = None, path: int = 1):
    """(shard, positions, home) for every shard that a value is stored in (home) or must visit."""
    at = np.arange(len(values)) if at is None else at
    stack = [(tree, at, np.ones(len(at), bool), path)]
    while stack:
        node, at, home, path = stack.pop()
        if not len(at):
            continue
        if node is None:
            yield path, at, home
            continue
        point, radius, inner, outer = node
        d = distance(values[at], point)
        near, far = d <= radius + slack, d > radius - slack
        stack.append((inner, at[near], home[near] & (d[near] <= radius), 2 * path))
        stack.append((outer, at[far], home[far] & (d[far] > radius), 2 * path + 1))


def forest(values: np.ndarray, home: np.ndarray, slack: int, leaf: int = LEAF):
    """A spanning forest of the links between stored values (home) and any value of the shard, as pairs of positions."""
    parent = np.arange(len(values))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def compare(stored_at, asked_at):
        for i in stored_at:
            for j in asked_at[distance(values[asked_at], values[i]) <= slack]:
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    yield i, j

    rng = np.random.default_rng(0)
    stack = [(np.flatnonzero(home), np.arange(len(values)))]
    while stack:
        stored_at, asked_at = stack.pop()
        if not len(stored_at) or not len(asked_at):
            continue
        cut = split(values[stored_at], rng) if len(stored_at) > leaf else None
        if cut is None:
            yield from compare(stored_at, asked_at)
            continue
        point, radius = cut
        inside, d = distance(values[stored_at], point) <= radius, distance(values[asked_at], point)
        stack.append((stored_at[inside], asked_at[d <= radius + slack]))
        stack.append((stored_at[~inside], asked_at[d > radius - slack]))


def scatter(values: np.ndarray, parts: int) -> np.ndarray:
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % parts


def dealing(tree, slack: int, grid: dict[int, tuple[int, int]]):
    """Sends fingerprints to the cells of the shards that store or visit them; `grid` holds (rows, columns) of shards
    with more than one cell: stored values have a row and go to all its cells, visiting ones (all values) a column."""

    def cells(shard, values, home):
        rows, columns = grid.get(shard, (1, 1))
        if rows == columns == 1:
            yield np.zeros(len(values), np.int64), values, home
            return
        kept = values[home]
        for c in range(columns):
            yield scatter(kept, rows) * columns + c, kept, np.ones(len(kept), bool)
        for r in range(rows):
            yield r * columns + scatter(values, columns), values, np.zeros(len(values), bool)

    def run(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, at, home in route(tree, values, slack):
                for cell, sent, kept in cells(shard, values[at], home):
                    columns = pa.array(np.full(len(sent), shard)), pa.array(cell), pa.array(sent.view(np.int64)), pa.array(kept)
                    yield pa.RecordBatch.from_arrays([*columns], names=["shard", "cell", "fp", "home"])

    return run


def links(fps: DataFrame, slack: int = 2) -> DataFrame:
    """(a, b): links that connect all fingerprints (distinct bigints in column fp) at `slack` or fewer differing bits."""
    n = fps.count()
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).collect()
    tree = grow(np.array([r[0] for r in sample], np.int64).view(np.uint64), max(1, min(-(-n // SHARD), TREE_SAMPLE // 16)))
    dealt = "shard bigint, cell bigint, fp bigint, home boolean"
    # one row per shard, and the tree bounds their number
    sizes = fps.mapInArrow(dealing(tree, slack, {}), dealt).groupBy("shard").agg(F.count("*").alias("visiting"), F.count_if("home").alias("stored")).collect()
    grid = {r["shard"]: (max(1, -(-r["stored"] // CELL)), -(-r["visiting"] // CELL)) for r in sizes if r["visiting"] > CELL}

    def join(group):
        values = group.column("fp").to_numpy().view(np.uint64)
        home = group.column("home").to_numpy()
        order = np.argsort(values, kind="stable")
        values, home = values[order], home[order]
        found = np.array(list(forest(values, home, slack)), np.int64).reshape(-1, 2)
        return pa.table({"a": values[found[:, 0]].view(np.int64), "b": values[found[:, 1]].view(np.int64)})

    return fps.mapInArrow(dealing(tree, slack, grid), dealt).groupBy("shard", "cell").applyInArrow(join, "a bigint, b bigint").filter("a <> b")


def classes(docs: DataFrame, slack: int = 2, text: str = "text", keep: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(keep, fp) of every row, and (_fp, component_id) of every distinct fingerprint; component_id is the smallest
    `keep` reachable over links."""
    fps = stored(fingerprints(docs, text, keep), "fingerprints")
    least = stored(fps.groupBy("fp").agg(F.min(keep).alias("least")), "distinct-fingerprints")
    roots = stored(components(links(least.select("fp"), slack)), "components")
    # of a component's fingerprints the smallest id; components of one fingerprint keep their own
    joined = least.join(roots, F.col("fp") == F.col("node"))
    first = joined.groupBy("root").agg(F.min("least").alias("first"))
    moved = joined.join(first, "root").select(F.col("fp").alias("_fp"), "first")
    least = least.join(moved, F.col("fp") == F.col("_fp"), "left").select(F.col("fp").alias("_fp"), F.coalesce("first", "least").alias("component_id"))
    return fps, least


def near_duplicates(docs: DataFrame, slack: int = 2, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """keep, fp (bigint) and component_id (smallest `keep` reachable over links), one row per input row."""
    fps, least = classes(docs, slack, text, keep)
    return fps.join(least, F.col("fp") == F.col("_fp")).select(keep, "fp", "component_id")


def one_of_each(docs: DataFrame, slack: int = 2) -> DataFrame:
    """The rows that stay when every group of near-duplicates keeps one row: of its smallest doc_id (null comes last), the
    text with the smallest hash, and of exact repeats of both a single one.  Columns pass through.

    A group's row is named by doc_id and a 128-bit hash of the text, so rows that share a doc_id, or have none, are told
    apart.  The names come from the distinct fingerprints alone; the texts move once, by their name.
    """
    h, g = F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), h.alias("h"), g.alias("g"))
    keyed = docs.select("doc_id", "text", row.alias("_row"))
    kept = classes(keyed, slack, keep="_row")[1].select("component_id.*").distinct().toDF(*(f"_near_{n}" for n in ("last", "id", "h", "g")))
    rows = docs.withColumns({"_near_a": h, "_near_b": g})
    same = F.col("doc_id").eqNullSafe(F.col("_near_id")) & (F.col("_near_a") == F.col("_near_h")) & (F.col("_near_b") == F.col("_near_g"))
    first = F.row_number().over(Window.partitionBy("doc_id", "_near_a", "_near_b").orderBy(F.xxhash64(*docs.columns)))
    return rows.join(kept, same, "left_semi").withColumn("_near_n", first).filter("_near_n = 1").select(*docs.columns)
