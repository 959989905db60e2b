"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts counts the character 1-, 2- and 3-grams that both contain, divided by
the geometric mean of how many each contains.  `LANDMARKS` training texts stand for all others (Nyström): with K the
kernel matrix of the landmarks, a text's features are its kernel values to them times K^(-1/2), and one ridge regression
per language (that language against the rest) is fitted on the features.  A batch of texts is scored as presence matrix
times landmark presence matrix times weights.

Fitting takes at most `PER_LANGUAGE` texts of each language, one a key, the first by a hash of their key, and of these as
many as hold `CHARACTERS` together, but one at least; that is the only sample, and no text is left out for its length.
Every whole text is scored.  Nothing is shuffled but keys and text hashes of the training choice.

Defined cases: a null text and a text without a letter are `und` with score 0; texts sharing no n-gram with a landmark
get the language of the largest bias; equal scores go to the first language by name; languages are the distinct
non-null values of `lang` among the training rows, and without any every text is `und`.  Each input row gives one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from paperlens.llm.common import residue

PER_LANGUAGE = 250
LANDMARKS = 96
#: Of the training texts of one language together; whole texts are used.
CHARACTERS = 4_000_000
RIDGE = 1e-2
ORDERS = 3
BATCH = 64


def grams(text: str) -> np.ndarray:
    """The set of 1- to 3-grams of a lower-cased text, as sorted integers of 21 bits a character."""
    # blank runs carry no language; surrogates cannot occur in text that came as UTF-8
    c = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le"), "<u4").astype(np.int64)
    found = [c]
    for _ in range(1, ORDERS):
        last = found[-1]
        if len(last) < 2:
            break
        found.append((last[:-1] + 1 << 21) + c[len(c) - len(last) + 1 :])
    return np.unique(np.concatenate(found))


class Model:
    """Languages, the landmarks' n-grams and presence matrix, their set sizes, and the weights (landmarks and a bias)."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        sets = [grams(t) for t in texts]
        marks = self.pick(langs)
        self.vocabulary = np.unique(np.concatenate([sets[i] for i in marks])) if marks else np.zeros(0, np.int64)
        self.presence = np.zeros((len(self.vocabulary), len(marks)), np.float32)
        for k, i in enumerate(marks):
            self.presence[np.searchsorted(self.vocabulary, sets[i]), k] = 1
        self.sizes = np.array([len(sets[i]) for i in marks], np.float32)
        if not marks:
            return
        kernel = np.concatenate([self.kernel(sets[i : i + BATCH]) for i in range(0, len(sets), BATCH)]).astype(np.float64)
        values, vectors = np.linalg.eigh(kernel[marks])
        self.root = vectors @ np.diag(np.where(values > 1e-6, np.abs(values) + 1e-12, np.inf) ** -0.5) @ vectors.T
        x = np.hstack([kernel @ self.root, np.ones((len(sets), 1))])
        y = np.where(np.array(langs)[:, None] == np.array(self.langs), 1.0, -1.0)
        w = np.linalg.solve(x.T @ x + RIDGE * len(sets) / 100 * np.eye(x.shape[1]), x.T @ y)
        self.weights, self.bias = (self.root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def pick(self, langs: list[str]) -> list[int]:
        """Landmarks: equally many of every language, in the order of the sample."""
        each = max(1, LANDMARKS // max(1, len(self.langs)))
        return sorted(i for lang in self.langs for i in [k for k, x in enumerate(langs) if x == lang][:each])

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(sets), len(self.vocabulary)), np.float32)
        for row, s in enumerate(sets):
            at = np.searchsorted(self.vocabulary, s)
            at[at == len(self.vocabulary)] = 0
            x[row, at[self.vocabulary[at] == s]] = 1
        sizes = np.array([max(1, len(s)) for s in sets], np.float32)
        return (x @ self.presence) / np.sqrt(sizes[:, None] * self.sizes)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.langs else []
        for i in range(0, len(rows), BATCH):
            mine = rows[i : i + BATCH]
            scores = (self.kernel([grams(texts[r]) for r in mine]) @ self.weights + self.bias).astype(np.float64)
            shares = np.exp(4 * (scores - scores.max(axis=1, keepdims=True)))
            shares /= shares.sum(axis=1, keepdims=True)
            for r, best, share in zip(mine, scores.argmax(axis=1), shares.max(axis=1)):
                out[r] = self.langs[best], float(share)
        return out


def sample(docs: DataFrame, learn, per_language: int, text: str, keep: str, characters: int = CHARACTERS) -> list:
    """At most `per_language` (key, text, lang) rows of each language: keys and hashes are chosen first, then texts read.

    Rows that repeat a key in a language count as one, with the text of the smallest hash, so what comes to the driver is
    bounded by the choice, not by the rows.
    """
    t = F.col(text).cast("string")
    rows = docs.filter(F.col("lang").isNotNull() & learn & t.rlike("\\p{L}")).select(F.col(keep).alias("key"), "lang", t.alias("text"), F.xxhash64(t).alias("h"))
    one = rows.groupBy("lang", "key").agg(F.min(F.struct("h", F.length("text").alias("n"))).alias("t")).select("lang", "key", "t.*")
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("key").cast("string")), "key")
    first = one.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= per_language)
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn("upto", upto).filter((F.col("place") == 1) | (F.col("upto") <= characters)).select("lang", "key", "h")
    # the choice has `per_language` rows a language, as has the model itself: small enough to send to every task
    texts = rows.join(F.broadcast(chosen), ["lang", "key", "h"]).groupBy("lang", "key").agg(F.min("text").alias("text"))
    return sorted(((r["key"], r["text"], r["lang"]) for r in texts.collect()), key=lambda r: (r[0], r[2], r[1]))


def identify(docs: DataFrame, learn, per_language: int = PER_LANGUAGE, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """keep, held_out (not learned from), lang_pred, score.  `learn` is a condition on the rows that may teach."""
    rows = sample(docs, learn, per_language, text, keep)
    model = Model([r[1] for r in rows], [r[2] for r in rows])

    def run(batches):
        for batch in batches:
            found = model.predict(batch.column(2).to_pylist())
            langs, scores = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), langs, scores], names=[keep, "held_out", "lang_pred", "score"])

    rows = docs.select(keep, (~F.coalesce(learn, F.lit(True))).alias("held_out"), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"{keep} {dict(docs.dtypes)[keep]}, held_out boolean, lang_pred string, score double")


def teaches(key: str = "doc_id"):
    """Rows that may teach: the crc32 of the key as text leaves another remainder than 1 modulo 3 (null for a null key)."""
    return residue(key, 3) != 1
