"""Exact top-k inner products over an impact-ordered index that is read a segment at a time."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

SCALE = 256
#: Classes of a shard of the index, and queries that are answered at a time.
SHARD, BLOCK = (2048, 65_536), 256
#: Entries from here on are multiplied as Python's integers, without the index.
LARGE = 1 << 24
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _scaled(batches):
    """vec_id, digest and the entries floor(256 x) as long integers; both null for a vector that takes no part."""
    for batch in batches:
        digests, values = [], []
        for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = None
            if vec_id is not None and vector.is_valid and len(vector.values) and not vector.values.null_count:
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    raw = np.floor(np.clip(x * SCALE, -(2.0**62), 2.0**62)).astype("<i8").tobytes()
            values.append(raw)
            digests.append(None if raw is None else blake2b(raw, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(values, pa.binary())], ["vec_id", "digest", "raw"])


class ImpactIndex:
    """The postings of a shard's vectors: by dimension, sign and quantised impact, the vectors that have it.

    A vector's impacts are its entries over its length, quantised in steps of ``step`` and rounded towards
    zero. Segments of equal impact are stored largest first. ``rest[r]`` is, by vector, the length of what
    the segments before round r have not told of it yet."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.length = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
        unit = entries / np.where(self.length > 0, self.length, 1)[:, None]
        self.step = 1 / (4 * np.sqrt(entries.shape[1]))
        level = np.floor(np.abs(unit) / self.step).astype(np.int32)
        told = (level + 0.5) * self.step * (level > 0)
        row, dim = np.nonzero(level)
        level_of, sign = level[row, dim], np.sign(unit[row, dim]).astype(np.int8)
        order = np.lexsort((row, sign, dim, -level_of))
        row, dim, level_of, sign = row[order], dim[order], level_of[order], sign[order]
        new = np.flatnonzero(np.diff(dim) | np.diff(level_of) | np.diff(sign)) + 1
        starts, ends = np.concatenate([[0], new]) if len(row) else np.empty(0, int), np.concatenate([new, [len(row)]])
        self.segments = [(int(level_of[a]), int(dim[a]), float(sign[a] * (level_of[a] + 0.5) * self.step), row[a:b]) for a, b in zip(starts, ends)]
        self.levels = sorted(set(level_of.tolist()), reverse=True)
        # squared lengths of what is untold after each level: all of small entries, errors of the told ones
        self.rest = []
        for at in self.levels:
            gap = np.where(level >= at, np.abs(unit) - told, unit)
            self.rest.append(np.sqrt((gap * gap).sum(axis=1)))
        self.full = np.sqrt((unit * unit).sum(axis=1))

    def top(self, queries: np.ndarray, k: int, enough: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each query's k highest inner products, ties at the k-th included: (vectors, products).

        Scores grow a segment at a time, largest impacts first. After each level a vector's score is known up
        to its untold length times the query's (Cauchy and Schwarz, and the rounding of floats). Reading stops
        when on average no more than ``enough`` times k vectors can still be among the k highest, or at the
        end; every one that can is multiplied out exactly."""
        n, dim = self.entries.shape
        k_ = min(k, n)
        scale = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        weight = queries.astype(np.float32)
        scores = np.zeros((n, len(queries)), dtype=np.float32)
        slack = dim * 2.0**-21
        at, open_ = 0, None
        for r, level in enumerate([*self.levels, 0]):
            while at < len(self.segments) and self.segments[at][0] == level:
                _, d, impact, rows = self.segments[at]
                scores[rows] += weight[:, d] * np.float32(impact)
                at += 1
            if r % 3 and level:
                continue
            rest = self.rest[min(r, len(self.rest) - 1)] if self.levels else self.full
            gap = ((rest + slack) * self.length)[:, None] * scale
            middle = scores * self.length[:, None]
            floor = np.partition(middle - gap, n - k_, axis=0)[n - k_]
            open_ = middle + gap >= floor
            if open_.sum() <= enough * k_ * len(queries):
                break
        found = []
        vector, query = np.nonzero(open_)
        products = np.einsum("ij,ij->i", self.entries[vector], queries[query])
        order = np.lexsort((-products, query))
        vector, query, products = vector[order], query[order], products[order]
        bounds = np.searchsorted(query, np.arange(len(queries) + 1))
        for a, b in zip(bounds, bounds[1:]):
            stays = products[a:b] >= (products[a + k_ - 1] if k_ else 0)
            found.append((vector[a:b][stays], products[a:b][stays]))
        return found


def _clipped(raws_a: list[bytes], raw_b: bytes) -> list[int]:
    b = np.frombuffer(raw_b, "<i8").astype(object)
    return [min(max(int((np.frombuffer(a, "<i8").astype(object) * b).sum()), LOW), HIGH) for a in raws_a]


def _searched(k: int):
    """The classes of a shard and a part of the queries to (digest, vec_id, score): k rows per query, ties by vec_id."""
    schema = pa.schema([("query", pa.binary()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])

    def run(classes: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if not classes.num_rows or not asked.num_rows:
            return schema.empty_table()
        raws, members = classes.column("raw").to_pylist(), classes.column("members").to_pylist()
        wide = np.array([np.abs(np.frombuffer(r, "<i8")).max() >= LARGE for r in raws])
        plain, big = np.flatnonzero(~wide), np.flatnonzero(wide)
        index = ImpactIndex(np.stack([np.frombuffer(raws[i], "<i8") for i in plain])) if len(plain) else None
        digests, queries = asked.column("query").to_pylist(), asked.column("raw").to_pylist()

        def add(digest, rows, scores):
            some = sorted(((-int(s), m["vec_id"], m["row"]) for r, s in zip(rows, scores) for m in members[r]))[:k]
            for s, v, row in some:
                for o, x in zip(out, (digest, v, row, -s)):
                    o.append(x)

        for at in range(0, len(queries), BLOCK):
            part = [np.frombuffer(q, "<i8") for q in queries[at : at + BLOCK]]
            small = np.array([np.abs(q).max() < LARGE for q in part])
            tops = iter(index.top(np.stack([q for q, s in zip(part, small) if s]), k) if index is not None and small.any() else [])
            for digest, raw, s in zip(digests[at : at + BLOCK], queries[at : at + BLOCK], small):
                # entries below LARGE in up to 2^14 dimensions stay within 64 bits; the rest is multiplied as it is
                rows, scores = next(tops) if s and index is not None else (np.empty(0, int), np.empty(0, int))
                rows, scores = plain[rows].tolist(), scores.tolist()
                rest = big if s else range(len(raws))
                add(digest, [*rows, *rest], [*scores, *_clipped([raws[i] for i in rest], raw)])
        return pa.table([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)

    return run


def search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k highest inner products of each vector whose vec_id is divisible by ``every`` with all other rows:
    query_id, rank (from 1), vec_id, score; ties by the smaller vec_id.

    Entries are floor(256 x). Equal vectors are one class, of which the k + 1 smallest vec_ids can be
    answers; classes are dealt to shards and each shard's index is read by all queries in parts.

    Vectors that are null or empty or hold a null or non-finite entry, or have no vec_id, take no part;
    vectors of different length don't meet. Rows that repeat a vec_id are rows of their own: each is a query if one is,
    and only itself is not among its candidates. Scores beyond 64 bits are cut to their range, entries to 62 bits. With
    fewer candidates than k all are returned. An empty table gives an empty result. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(_scaled, "vec_id long, digest binary, raw binary").filter("digest is not null")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    first = Window.partitionBy("digest").orderBy("vec_id", "row")
    heads = rows.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= k + 1)
    classes = heads.groupBy("digest").agg(F.first("raw").alias("raw"), F.collect_list(F.struct("vec_id", "row")).alias("members"))  # k + 1 at most
    classes = stage(classes, "classes")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    queries = stage(asked.groupBy(F.col("digest").alias("query")).agg(F.first("raw").alias("raw")), "queries")
    n, n_queries = classes.count(), queries.count()
    shard = min(max(n // 64, SHARD[0]), SHARD[1])
    shards, parts = max(1, -(-n // shard)), max(1, -(-n_queries // 20_000))
    dealt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = classes.withColumn("dim", F.length("raw")).withColumn("shard", dealt("digest", shards)).withColumn("part", all_of(parts))
    right = queries.withColumn("dim", F.length("raw")).withColumn("part", dealt("query", parts)).withColumn("shard", all_of(shards))
    keys = ["dim", "shard", "part"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_searched(k + 1), "query binary, vec_id long, row long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    answers = pairs.withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= k + 1)
    answers = stage(answers.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_nth", "vec_id", "row", "score"))).alias("found")), "answers")
    own = asked.select("digest", F.col("vec_id").alias("query_id"), F.col("row").alias("_own"))
    others = F.slice(F.filter("found", lambda f: f["row"] != F.col("_own")), 1, k)
    found = own.join(answers, own["digest"] == answers["query"]).select("query_id", F.posexplode(others).alias("_at", "f"))
    return found.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
