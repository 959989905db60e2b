"""Toxicity by a counterfactually regularised classifier.

A logistic regression over the presence of words and word beginnings.  Fitting minimises, over labelled texts,

    log loss + ridge * |w|^2 + penalty * mean of (score(x) - score(x'))^2

where x' is a text's sentences with every term of a slot swapped for another of its slot, once for each other place in
the slot, so that which of them is named cannot move the score: a term that only stands beside toxic words in the sample
keeps no weight of its own.  Slots are rows of words that name groups (`IDENTITY`), and those that the sample itself
shows: words of both classes that fill the same gaps between neighbours (`found_slots`), of which which one stands there
should tell nothing either.

Fitting takes at most `SAMPLE` labelled texts, the first by a hash of their key, whatever their length, and at most
`FEATURES` features, chosen by how much they tell about the label (G-squared).  The features and gaps are counted by
Spark.  Every whole text is scored in one pass without a shuffle.

Defined cases: null, empty and wordless texts get the score of no features (the bias); rows without a label, and those
whose key is null, teach nothing; if the labels hold one class or none, every score is that class's share (0.5 for
none); a document with several label rows is learned once with the largest label.  Each input row gives one row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from paperlens.llm.common import residue, stored

SAMPLE = 20_000
FEATURES = 4_096
LEAST_ROWS = 4
RIDGE, PENALTY, ROUNDS = 1e-3, 4.0, 300
BEGINNINGS = (3, 4, 5, 6)
#: Words that may form slots, gaps between such words that are compared, gaps two words share at least, words in a slot.
CANDIDATES, GAPS, SHARED, SLOT = 200, 20_000, 5, 5
#: Identity terms: each row is one slot, its entries name groups and may replace each other (fixed values).
IDENTITY = [
    "women men", "woman man", "girls boys", "female male", "gay straight", "lesbian heterosexual", "transgender cisgender",
    "muslim christian jewish hindu buddhist", "muslims christians jews hindus buddhists", "black white asian latino", "immigrants citizens refugees",
    "african european american", "disabled blind deaf", "old young", "frauen männer", "frau mann", "mädchen jungen", "muslime christen juden",
    "schwarze weiße", "migranten einheimische", "femmes hommes", "femme homme", "filles garçons", "musulmans chrétiens juifs", "noirs blancs",
    "mujeres hombres", "mujer hombre", "chicas chicos", "musulmanes cristianos judíos", "negros blancos", "inmigrantes ciudadanos",
]
WORDS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def swaps(slots: list[list[str]]) -> list[dict[str, str]]:
    """For every shift below the longest slot's length: each term with the one so many places on in its slot."""
    longest = max(map(len, slots), default=1)
    return [{term: slot[(i + r) % len(slot)] for slot in slots if r < len(slot) for i, term in enumerate(slot)} for r in range(1, longest)]


def features(words: set[str]) -> set[str]:
    return words | {f"^{w[:n]}" for w in words for n in BEGINNINGS if len(w) > n}


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def twins(words: set[str], shifts: list[dict[str, str]]) -> list[set[str]]:
    """The words after each swap that changes them."""
    out = [{shift.get(w, w) for w in words} for shift in shifts if not words.isdisjoint(shift)]
    return [t for t in out if t != words]


def found_slots(sample: DataFrame, counts: DataFrame, toxic: int, other: int) -> list[list[str]]:
    """Words that share gaps: slots of up to `SLOT` words, none of which tells the classes apart by itself.

    Only the words that are most frequent in both classes, and in neither more than twice as frequent as in the other, are
    compared, by the gaps between two of them in a sentence.  All that comes to the driver is bounded.
    """
    a, b = F.col("toxic") / toxic, F.col("other") / other
    plain = counts.filter(~F.col("feature").startswith("^") & (F.least(a, b) * 2 >= F.greatest(a, b)) & (F.least("toxic", "other") >= LEAST_ROWS))
    words = {r[0] for r in plain.orderBy(F.desc(F.least(a, b)), "feature").limit(CANDIDATES).select("feature").collect()}

    def run(batches):
        for batch in batches:
            seen: dict[tuple[str, str, str], int] = {}
            for text in batch.column(0).to_pylist():
                for sentence in SENTENCE.split((text or "").lower()):
                    at = WORDS.findall(sentence)
                    for gap in zip(at, at[1:], at[2:]):
                        if words.issuperset(gap):
                            seen[gap] = seen.get(gap, 0) + 1
            yield pa.RecordBatch.from_arrays([*(pa.array([g[k] for g in seen], pa.string()) for k in range(3)), pa.array(list(seen.values()), pa.int64())], names=["l", "word", "r", "n"])

    gaps = sample.select("text").mapInArrow(run, "l string, word string, r string, n bigint").groupBy("l", "word", "r").agg(F.sum("n").alias("n"))
    rows = gaps.filter("n > 1").orderBy(F.desc("n"), "l", "word", "r").limit(GAPS).collect()
    fills: dict[str, set] = {}
    for r in rows:
        fills.setdefault(r["word"], set()).add((r["l"], r["r"]))
    close = [(len(fills[x] & fills[y]), x, y) for x in fills for y in fills if x < y]
    slot = {w: (w,) for w in fills}
    for n, x, y in sorted(close, key=lambda c: (-c[0], c[1:])):
        both = slot[x] + slot[y]
        if n >= SHARED and 2 * n >= min(len(fills[x]), len(fills[y])) and slot[x] is not slot[y] and len(both) <= SLOT:
            slot |= dict.fromkeys(both, both)
    return sorted(map(list, {s for s in slot.values() if len(s) > 1}))


def counted(sample: DataFrame) -> DataFrame:
    """feature, toxic rows, other rows; pre-added within each task's batches."""

    def run(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in features(words_of(text)):
                    counts.setdefault(f, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (1, 0))], names=["feature", "toxic", "other"]
            )

    rows = sample.select("text", "label").mapInArrow(run, "feature string, toxic bigint, other bigint")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def chosen(counts: DataFrame, toxic: int, other: int, most: int) -> list[str]:
    """The features that tell most about the label."""
    both = toxic + other

    def term(seen, of):
        seen = seen.cast("double")
        return F.when(seen > 0, seen * F.log(seen * both / ((F.col("toxic") + F.col("other")) * of))).otherwise(0.0)

    def absent(seen, of):
        rest, all_rest = F.lit(float(of)) - seen, F.lit(float(both)) - F.col("toxic") - F.col("other")
        return F.when(rest > 0, rest * F.log(rest * both / (all_rest * of))).otherwise(0.0)

    gain = term(F.col("toxic"), toxic) + term(F.col("other"), other) + absent(F.col("toxic"), toxic) + absent(F.col("other"), other)
    rows = counts.filter(F.col("toxic") + F.col("other") >= LEAST_ROWS).withColumn("gain", F.round(gain, 6)).orderBy(F.desc("gain"), "feature").limit(most)
    return sorted(r["feature"] for r in rows.collect())


class Model:
    """A logistic model of sparse binary rows; `score` takes the features of a text."""

    def __init__(self, names: list[str], rows: list[tuple[list[int], list[tuple[list[int], list[int]]], int]], penalty: float = PENALTY):
        self.slot = {n: i for i, n in enumerate(names)}
        labels = np.array([r[2] for r in rows], np.float64)
        self.weights, self.bias, self.pairs = np.zeros(len(names)), 0.0, sum(len(r[1]) for r in rows)
        self.constant = None if 0 < labels.sum() < len(labels) else float(labels.mean()) if len(labels) else 0.5
        if self.constant is not None:
            return
        loss = Loss(rows, len(names), labels, penalty)
        m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
        for t in range(1, ROUNDS + 1):
            g = loss.gradient(self.weights, self.bias)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
            self.weights, self.bias = self.weights - step[:-1], self.bias - step[-1]

    def score(self, found: set[str]) -> float:
        if self.constant is not None:
            return self.constant
        z = self.bias + sum(self.weights[i] for i in map(self.slot.get, found) if i is not None)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    def score_text(self, text: str | None) -> float:
        return self.score(features(words_of(text)))


class Sparse:
    """Rows of columns with a value each."""

    def __init__(self, rows: list[tuple[list[int], float]], of: list[int], n: int, width: int):
        self.n, self.width = n, width
        self.row = np.repeat(np.array(of, np.int64), [len(r) for r, _ in rows]) if rows else np.zeros(0, np.int64)
        self.value = np.repeat([x for _, x in rows], [len(r) for r, _ in rows]) if rows else np.zeros(0)
        self.col = np.fromiter((c for r, _ in rows for c in r), np.int64, len(self.row))

    def dot(self, w):
        return np.bincount(self.row, self.value * w[self.col], self.n)

    def back(self, v):
        return np.bincount(self.col, self.value * v[self.row], self.width)


class Loss:
    """Log loss, ridge and the penalty on score changes; rows are (columns, [(columns lost, columns gained)], label)."""

    def __init__(self, rows, width: int, labels: np.ndarray, penalty: float):
        self.labels, self.penalty = labels, penalty
        self.own = Sparse([(r[0], 1.0) for r in rows], list(range(len(rows))), len(rows), width)
        pairs = [(i, *twin) for i, r in enumerate(rows) for twin in r[1]]
        self.at = np.array([p[0] for p in pairs], np.int64)
        numbers = [k for k in range(len(pairs)) for _ in (0, 1)]
        self.change = Sparse([(part, sign) for p in pairs for part, sign in ((p[1], -1.0), (p[2], 1.0))], numbers, len(pairs), width)
        # the classes weigh alike, half each
        self.weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))

    def scores(self, w, bias):
        z = self.own.dot(w) + bias
        return 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-(z[self.at] + self.change.dot(w))))

    def value(self, w, bias) -> float:
        p, q = self.scores(w, bias)
        log = -(self.weight * np.where(self.labels == 1, np.log(p), np.log(1 - p))).sum()
        return log + RIDGE * w @ w + (self.penalty * ((p[self.at] - q) ** 2).mean() if len(q) else 0.0)

    def gradient(self, w, bias) -> np.ndarray:
        p, q = self.scores(w, bias)
        back = self.weight * (p - self.labels)
        grad = 2 * RIDGE * w
        if len(q):
            gap = 2 * self.penalty * (p[self.at] - q) / len(q)
            theirs = -gap * q * (1 - q)
            back = back + np.bincount(self.at, gap * (p * (1 - p))[self.at] + theirs, len(p))
            grad = grad + self.change.back(theirs)
        return np.append(grad + self.own.back(back), back.sum())


def labelled(docs: DataFrame, labels: DataFrame, learn, most: int) -> DataFrame:
    """At most `most` rows (text, label), the first by a hash of their key.  Keys are chosen before texts are read."""
    known = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    fit = docs.select("doc_id", "text").filter(learn)
    keys = fit.select("doc_id").distinct().join(known, "doc_id").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most)
    rows = fit.join(F.broadcast(keys), "doc_id")  # at most `most` keys
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, learn, most: int = SAMPLE, slots: list[list[str]] | None = None, penalty: float = PENALTY) -> Model:
    """`slots` are further ones beside `IDENTITY`; without them those that the sample shows."""
    sample = stored(labelled(docs, labels, learn, most), "toxic-sample")
    sizes = dict(sample.groupBy("label").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        return Model([], [([], [], k) for k in (0, 1) for _ in range(sizes.get(k, 0))])
    counts = stored(counted(sample), "toxic-features")
    names = chosen(counts, sizes[1], sizes[0], FEATURES)
    slot = {n: i for i, n in enumerate(names)}
    named = [row.split() for row in IDENTITY]
    taken = {t for row in named for t in row}
    more = found_slots(sample, counts, sizes[1], sizes[0]) if slots is None else slots
    shifts = swaps(named + [s for s in more if taken.isdisjoint(s)])
    columns = lambda found: sorted(slot[f] for f in found if f in slot)

    def encode(batches):
        kind = pa.list_(pa.list_(pa.int32()))
        for batch in batches:
            own, lost, gained = [], [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                mine = features(words)
                others = [features(t) for t in twins(words, shifts)]
                changes = [(a, b) for a, b in ((columns(mine - t), columns(t - mine)) for t in others) if a or b]
                own.append(columns(mine))
                lost.append([a for a, _ in changes])
                gained.append([b for _, b in changes])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), pa.array(lost, kind), pa.array(gained, kind), batch.column(1)], names=["own", "lost", "gained", "label"])

    rows = sample.mapInArrow(encode, "own array<int>, lost array<array<int>>, gained array<array<int>>, label int").collect()  # at most SAMPLE short rows
    rows = sorted(((r["own"], list(zip(r["lost"], r["gained"])), r["label"]) for r in rows), key=lambda r: (r[2], r[0], r[1]))
    return Model(names, rows, penalty)


def scores(docs: DataFrame, model: Model, text: str = "text", name: str = "toxic_score") -> DataFrame:
    """The input columns and the score, as `name` (which replaces a column of that name)."""
    docs = docs.drop(name)
    names = docs.columns
    width = len(names)

    def run(batches):
        for batch in batches:
            found = pa.array([model.score_text(t) for t in batch.column(width).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], found], names=[*names, name])

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.select("*", F.col(text).cast("string").alias("_scored")).mapInArrow(run, schema)


def teaches(key: str = "doc_id"):
    """Rows that may teach: the crc32 of the key as text leaves a remainder modulo 5 (null for a null key)."""
    return residue(key, 5) != 0
