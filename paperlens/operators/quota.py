"""Sliding-window quota: at most `limit` accepted requests per key in the window; refusals take no slot.

Each decision depends on the earlier ones, through a queue of at most `limit` accepted times.  A key is cut into blocks of
time, all of which walk at once, so that one busy key without a pause still spreads over many tasks:

1. Every block walks from an empty queue and tells the queue it ends with, and whether that queue is settled: past a
   stretch of one window in which no request could have been refused, the queue is the same from every beginning.
2. A block that is not settled has to begin with the queue that the block before ends with.  Blocks whose beginning
   differs from the one they walked from walk again, until none does; then each begins as the whole key's walk would.
   Beginnings meet soon, as a rule, since walks from different queues fall in with each other.
3. Where they keep differing (requests at a steady beat) after `ROUNDS` rounds, the key walks on from there in one
   stream, in the order of time: one task, bounded memory.
4. With these beginnings all requests are decided in one more pass.

A walk takes rows in the order of time with the queue as its only state; rows are dealt by (key, block) and never gathered.
"""

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from paperlens.sources.sinks import staged

#: Windows in a block, and rounds of repair before the rest of a key walks in one stream.
BLOCK_WINDOWS, ROUNDS = 64, 6
#: Order of the rows in a walk: the queue it begins with, then the requests.
QUEUED, ASKED = 0, 1


def micros(df: DataFrame, ts: str):
    if dict(df.dtypes)[ts] == "timestamp":
        return F.unix_micros(ts)
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{ts}`)")


class Walk:
    """The queue along the requests of one key, from the beginning of a block on."""

    def __init__(self, start: int, limit: int, span: int, queue=()):
        self.start, self.limit, self.span, self.accepted = start, limit, span, deque(queue)
        self.first, self.settled = None, False
        #: the last requests, and the last time at which one may have been refused or not
        self.seen, self.doubt = deque(maxlen=limit), start

    def take(self, t: int) -> bool:
        accepted, seen = self.accepted, self.seen
        while accepted and t - accepted[0] > self.span:
            accepted.popleft()
        ok = len(accepted) < self.limit
        if ok:
            accepted.append(t)
        if self.first is None:
            self.first = t
        if not self.settled:
            if t - self.doubt > self.span:
                self.settled = True
            elif t - self.start <= self.span or (len(seen) == self.limit and (not seen or t - seen[0] <= self.span)):
                self.doubt = t
            seen.append(t)
        return ok


def in_order(rows: DataFrame, queues: DataFrame | None, *payload: str) -> DataFrame:
    """Requests (_key, _run, _block, _t) of every run together in the order of time, behind the queue that they begin with."""
    rows = rows.withColumn("_kind", F.lit(ASKED))
    if queues is not None:
        first = queues.select("_key", "_run", "_block", F.explode("_begin").alias("_t"), F.lit(QUEUED).alias("_kind"))
        rows = rows.unionByName(first, allowMissingColumns=True)
    return rows.repartition("_key", "_run").sortWithinPartitions("_key", "_run", "_block", "_kind", "_t", *payload)


def block_ends(rows: DataFrame, queues: DataFrame | None, limit: int, span: int) -> DataFrame:
    """_key, _block, _first (time), _end (queue), _settled; a run begins with its queue and goes on from block to block."""
    key = rows.schema["_key"]
    names = ["_key", "_block", "_first", "_end", "_settled"]
    kinds = pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_()

    def run(batches):
        at, walk, kind = (None, None, None), None, None

        def told():
            return [] if walk is None or walk.first is None else [(at[0], at[2], walk.first, list(walk.accepted), walk.settled)]

        def batch_of(found):
            columns = list(zip(*found)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, *kinds))], names=names)

        for batch in batches:
            kind, found = batch.schema.field("_key").type, []
            for who, which, block, asked, t in zip(*(batch.column(n).to_pylist() for n in ("_key", "_run", "_block", "_kind", "_t"))):
                if (who, which, block) != at:
                    found += told()
                    queue = walk.accepted if walk is not None and (who, which) == at[:2] else ()
                    at, walk = (who, which, block), Walk(block * span * BLOCK_WINDOWS, limit, span, queue)
                if asked == ASKED:
                    walk.take(t)
                else:
                    walk.accepted.append(t)
            yield batch_of(found)
        if walk is not None:
            yield batch_of(told())

    schema = f"_key {key.dataType.simpleString()}, _block bigint, _first bigint, _end array<bigint>, _settled boolean"
    return in_order(rows.select("_key", "_run", "_block", "_t"), queues).mapInArrow(run, schema)


def beginnings(rows: DataFrame, limit: int, span: int) -> DataFrame:
    """_key, _block, _begin: the queue that every block begins with."""
    none = F.array().cast("array<bigint>")
    before = F.lag("_end").over(Window.partitionBy("_key").orderBy("_block"))
    ends = block_ends(rows.withColumn("_run", F.col("_block")), None, limit, span).withColumn("_from", none)
    differs = ~F.col("_settled") & (F.col("_begin") != F.col("_from"))
    for k in range(ROUNDS + 1):
        ends = ends.withColumn("_before", F.coalesce(before, none))
        ends = staged(ends.withColumn("_begin", F.filter("_before", lambda a: F.col("_first") - a <= span)).drop("_before"))
        again = ends.filter(differs)
        if again.isEmpty():
            break
        if k < ROUNDS:
            walked = again.select("_key", "_block", F.col("_block").alias("_run"), "_begin")
            asked = rows.join(walked.select("_key", "_block", "_run"), ["_key", "_block"])
        else:  # all that is before a key's first difference is right
            walked = again.groupBy("_key").agg(F.min("_block").alias("_run"), F.min_by("_begin", "_block").alias("_begin")).withColumn("_block", F.col("_run"))
            asked = rows.join(walked.select("_key", "_run"), "_key").filter("_block >= _run")
        new = block_ends(asked, walked, limit, span).select("_key", "_block", F.col("_end").alias("_new"))
        both = ends.join(new, ["_key", "_block"], "left")
        ends = both.select("_key", "_block", "_first", F.coalesce("_new", "_end").alias("_end"), "_settled", F.when(F.col("_new").isNull(), F.col("_from")).otherwise(F.col("_begin")).alias("_from"))
        if k == ROUNDS:
            ends = ends.withColumn("_begin", F.filter(F.coalesce(before, none), lambda a: F.col("_first") - a <= span))
    return ends.select("_key", "_block", "_begin")


def quota(requests: DataFrame, key: str, ts: str, tie: str, limit: int, window_seconds: int) -> DataFrame:
    """Adds ``allowed``.  Equal times go by ``tie``.

    A request without a time or a key cannot be placed: it stays, with ``allowed`` null, and takes no slot.  Keys of any
    type, repeated rows and an empty table need no rule of their own.
    """
    span = window_seconds * 1_000_000
    placed = F.col(ts).isNotNull() & F.col(key).isNotNull()
    unplaced = requests.filter(~placed).withColumn("allowed", F.lit(None).cast("boolean"))
    t = micros(requests, ts)
    rows = requests.filter(placed).withColumns({"_key": F.col(key), "_t": t, "_block": F.floor(t / (span * BLOCK_WINDOWS))})
    begins = beginnings(rows.select("_key", "_block", "_t"), limit, span).withColumn("_run", F.col("_block"))
    columns = requests.columns
    schema = StructType([*requests.schema.fields, StructField("allowed", BooleanType())])

    def run(batches):
        at, walk = None, None
        for batch in batches:
            flags, asked = [], batch.column("_kind").to_pylist()
            for who, block, kind, t in zip(batch.column("_key").to_pylist(), batch.column("_block").to_pylist(), asked, batch.column("_t").to_pylist()):
                if (who, block) != at:
                    at, walk = (who, block), Walk(block * span * BLOCK_WINDOWS, limit, span)
                if kind == ASKED:
                    flags.append(walk.take(t))
                else:
                    walk.accepted.append(t)
            kept = batch.filter(pa.array([kind == ASKED for kind in asked]))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in columns), pa.array(flags, pa.bool_())], names=[*columns, "allowed"])

    return in_order(rows.withColumn("_run", F.col("_block")), begins, tie).mapInArrow(run, schema).unionByName(unplaced)
