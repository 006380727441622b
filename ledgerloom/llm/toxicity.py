"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


WORDS = re.compile(r"[^\W_]+")
SPACE = (1 << 30) - 1
STEM = 5
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class Hasher:
    """Features of texts: words, stems (a word's first letters), pairs of neighbours and of words
    with one between them, each hashed to 30 bits."""

    def __init__(self, limit: int = 500_000):
        self.known: dict[str, tuple[int, int]] = {}
        self.limit = limit

    def _new(self, word: str) -> tuple[int, int]:
        import xxhash

        got = xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(word[:STEM], 1) if len(word) > STEM else 0
        if len(self.known) >= self.limit:
            self.known = {}
        self.known[word] = got
        return got

    def features(self, text: str) -> np.ndarray:
        known = self.known.get
        words = WORDS.findall(text.lower())
        if not words:
            return np.zeros(0, dtype=np.int64)
        pairs = np.array([known(w) or self._new(w) for w in words], dtype=np.uint64)
        h, stems = pairs[:, 0], pairs[:, 1]
        a, b, c = MULTIPLIERS
        all_ = np.concatenate([h, stems[stems > 0], h[:-1] * a + h[1:] * b, h[:-2] * b + h[2:] * c])
        all_ ^= all_ >> np.uint64(31)
        return ((all_ * a) >> np.uint64(34)).astype(np.int64) & SPACE


_hasher = Hasher()


def ftrl(rows: list[np.ndarray], labels: np.ndarray, alpha: float, beta: float, l1: float, l2: float, epochs: int):
    """Coordinates, weights and squared-gradient sums after ``epochs`` passes; coordinate -1 is the bias.

    Every coordinate has a rate of its own, alpha / (beta + sqrt(n)); L1 keeps weak ones at zero.
    """
    used, flat = np.unique(np.concatenate(rows), return_inverse=True) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    ends = np.cumsum([len(r) for r in rows])
    z, n = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    bias = len(used)

    def weights(i, penalty):
        return np.where(np.abs(z[i]) <= penalty, 0.0, -(z[i] - np.sign(z[i]) * penalty) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for k, end in enumerate(ends):
            i = np.append(flat[end - len(rows[k]) : end], bias)
            penalty = np.full(len(i), l1)
            penalty[-1] = 0.0
            w = weights(i, penalty)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[k]
            root = np.sqrt(n[i])
            z[i] += g - (np.sqrt(n[i] + g * g) - root) / alpha * w
            n[i] += g * g
    penalty = np.full(len(z), l1)
    penalty[-1] = 0.0
    return np.append(used, -1), weights(np.arange(len(z)), penalty), n


def train(docs: DataFrame, labels: DataFrame, rows: int = 60_000, shard_rows: int = 5_000, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.0, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and their weights, from about ``rows`` labelled documents at most.

    The sample is the labelled rows whose hashed id falls below a share of the hash range, so it is
    bounded by ``rows`` whatever the tables' sizes. It is dealt out to tasks of ``shard_rows`` that each
    run FTRL; a coordinate's weight is the mean over the shards that have moved it, by how far they have.
    """
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    n = marked.count()
    share = min(1.0, rows / max(n, 1))
    shards = max(1, round(min(n, rows) / shard_rows))
    sample = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).withColumnRenamed("doc_id", "_id")

    def featured(batches):
        for batch in batches:
            got = [np.unique(_hasher.features(t or "")).astype("<i8").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.binary())], ["shard", "toxic", "features"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["toxic", "features"])
        pdf = pdf.iloc[np.random.default_rng(7).permutation(len(pdf))]
        at, w, moved = ftrl([np.frombuffer(x, dtype="<i8") for x in pdf["features"]], pdf["toxic"].to_numpy(dtype=float), alpha, beta, l1, l2, epochs)
        keep = (w != 0) | (at < 0)
        return pd.DataFrame({"coordinate": at[keep], "weight": w[keep], "moved": moved[keep]})

    # bounded by ``rows`` pairs of an id and a label
    chosen = docs.join(F.broadcast(sample), docs["doc_id"] == F.col("_id"))
    chosen = chosen.select(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(shards)).cast("int").alias("shard"), F.col("_toxic").alias("toxic"), docs["text"])
    fitted = chosen.mapInArrow(featured, "shard int, toxic int, features binary").groupBy("shard").applyInPandas(fit, "coordinate long, weight double, moved double")
    mean = fitted.groupBy("coordinate").agg((F.sum(F.col("weight") * F.col("moved")) / F.sum("moved")).alias("weight")).filter("weight is not null and abs(weight) > 1e-3")
    found = sorted((r["coordinate"], r["weight"]) for r in mean.collect())
    return np.array([x[0] for x in found], dtype=np.int64), np.array([x[1] for x in found], dtype=float)


def _scored(coordinates: np.ndarray, weights: np.ndarray):
    def run(batches):
        bias = float(weights[0]) if len(coordinates) and coordinates[0] < 0 else 0.0
        at, w = (coordinates[1:], weights[1:]) if len(coordinates) and coordinates[0] < 0 else (coordinates, weights)
        sieve = np.zeros(1 << 20, dtype=bool)
        sieve[at & 0xFFFFF] = True
        for batch in batches:
            texts, scores = batch.column(2).to_pylist(), []
            for text in texts:
                total = bias
                if text and len(at):
                    f = _hasher.features(text)
                    f = np.unique(f[sieve[f & 0xFFFFF]])
                    i = np.minimum(np.searchsorted(at, f), len(at) - 1)
                    total += float(w[i[at[i] == f]].sum())
                scores.append(1.0 / (1.0 + np.exp(-np.clip(total, -30, 30))) if len(coordinates) else 0.0)
            scores = np.array(scores, dtype=float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return run


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of each row, from a model of the labels that are not held out.

    Null and empty texts get the score of no features. A null doc_id is held out and has no label; null
    labels are not learnt from; of several labels of a document the largest counts. With no label to
    learn from every score is 0. Repeated rows are scored each; an empty table gives an empty result.
    Other columns are not read.
    """
    coordinates, weights = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic").filter(~held_out()), **options)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_scored(coordinates, weights), f"doc_id {kind}, held_out boolean, score double, predicted int")


