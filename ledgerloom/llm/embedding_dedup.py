"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines."""

from __future__ import annotations

from hashlib import blake2b
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import stage

BLOCK = 2_000


def _prepared(batches):
    """vec_id, digest (null for a vector that links with nothing) and the values as doubles."""
    for batch in batches:
        digests, values = [], []
        for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = None
            if vec_id is not None and vector.is_valid and not vector.values.null_count and len(vector.values):
                x = vector.values.to_numpy(zero_copy_only=False).astype("<f8")
                if not np.isfinite(x).all() or not x.any():
                    x = None
            raw = None if x is None else x.tobytes()
            digests.append(None if raw is None else blake2b(raw, digest_size=16).digest())
            values.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(values, pa.binary())], ["vec_id", "digest", "raw"])


def _unit(raws) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), dtype="<f8").reshape(len(raws), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signatures(tables: int, projections: int, width: float, seed: int):
    """Each class once for every table: its bucket there and, for all tables, its keys."""

    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        mix = np.random.default_rng(seed).integers(1, 1 << 62, size=(tables, projections), dtype=np.int64).astype(np.uint64) | np.uint64(1)
        for batch in batches:
            names = batch.schema.names
            raws = batch.column(names.index("raw")).to_pylist()
            dims = np.array([len(r) // 8 for r in raws])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim not in held:
                    rng = np.random.default_rng([seed, int(dim)])
                    held[dim] = rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections)
                a, b = held[dim]
                cells = np.floor((_unit([raws[i] for i in at]) @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(at), tables, projections)
                keys = (cells * mix).sum(axis=2) + np.uint64(dim)
                keys = ((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).astype(np.int64)
                packed = [k.astype("<i8").tobytes() for k in keys]
                part = batch.take(pa.array(np.repeat(at, tables)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))),
                        pa.array(keys.reshape(-1)),
                        *(part.column(names.index(x)) for x in ("cls", "rep", "copies", "raw")),
                        pa.array([packed[i] for i in range(len(at)) for _ in range(tables)], pa.binary()),
                    ],
                    ["table", "key", "cls", "rep", "copies", "raw", "keys"],
                )

    return run


def _linked(cosine: float):
    """Rows of a bucket's block pairs, in order, to (cls, links, rep, root): the vectors that a class links
    with, counted in the first table that brings the two together, and the smallest it reaches here."""

    def links_of(table, left, right, same):
        """left, right: (rep, copies, unit vectors, keys); ``same`` if they are one block."""
        sims = left[2] @ right[2].T
        close = sims >= cosine - 1e-9
        if same:
            close &= np.tri(len(left[0]), k=-1, dtype=bool).T
        i, j = np.nonzero(close)
        edge = np.abs(sims[i, j] - cosine) < 1e-9
        if edge.any():
            exact = np.array([float(np.dot(left[2][p], right[2][q])) for p, q in zip(i[edge], j[edge])])
            keep = np.ones(len(i), dtype=bool)
            keep[np.flatnonzero(edge)[exact < cosine]] = False
            i, j = i[keep], j[keep]
        if table:
            new = ~(left[3][i, :table] == right[3][j, :table]).any(axis=1)
            return i, j, new
        return i, j, np.ones(len(i), dtype=bool)

    def answer(rows):
        table, bi, bj = rows["table"][0], rows["bi"][0], rows["bj"][0]
        reps = np.array(rows["rep"], dtype=np.int64)
        copies = np.array(rows["copies"], dtype=np.int64)
        unit = _unit(rows["raw"])
        keys = np.frombuffer(b"".join(rows["keys"]), dtype="<i8").reshape(len(reps), -1)
        blocks = np.array(rows["blk"])
        if bi == bj:
            a = b = np.arange(len(reps))
        else:
            a, b = np.flatnonzero(blocks == bi), np.flatnonzero(blocks == bj)
        i, j, new = links_of(table, (reps[a], copies[a], unit[a], keys[a]), (reps[b], copies[b], unit[b], keys[b]), bi == bj)
        i, j = a[i], b[j]
        links = np.bincount(i[new], weights=copies[j[new]], minlength=len(reps)) + np.bincount(j[new], weights=copies[i[new]], minlength=len(reps))
        root = _roots(reps, i, j)
        some = np.flatnonzero((links > 0) | (root != reps))
        return np.array(rows["cls"], dtype=np.int64)[some], links[some].astype(np.int64), reps[some], root[some]

    def run(batches):
        held: dict[str, list] = {}
        names = ["table", "key", "bi", "bj", "blk", "cls", "rep", "copies", "raw", "keys"]
        last = None
        out: list[list] = [[], [], [], []]

        def close():
            if held and len(held["rep"]) > 1:
                for o, x in zip(out, answer(held)):
                    o.extend(x.tolist())

        def batch_out():
            row = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["cls", "links", "rep", "root"])
            for o in out:
                o.clear()
            return row

        for batch in batches:
            columns = [batch.column(batch.schema.names.index(n)).to_pylist() for n in names]
            marks = list(zip(*columns[:4]))
            start = 0
            for k in range(len(marks) + 1):
                if k == len(marks) or marks[k] != (marks[start] if k > start else last):
                    if k > start:
                        if marks[start] != last:
                            close()
                            held = {n: [] for n in names}
                            last = marks[start]
                        for n, c in zip(names, columns):
                            held[n] += c[start:k]
                        start = k
            if len(out[0]) > 50_000:
                yield batch_out()
        close()
        yield batch_out()

    return run


def _roots(reps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest rep that each reaches over the links, by sweeping minima until they stay."""
    low = reps.copy()
    while len(i):
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        if (new == low).all():
            break
        low = new
    return low


def together(distance: float, width: float) -> float:
    """The chance that two vectors so far apart share a cell of a random projection."""
    x = width / distance
    return erf(x / sqrt(2)) - sqrt(2 / pi) / x * (1 - exp(-x * x / 2))


def shape(n: int, cosine: float, width: float, recall: float) -> tuple[int, int]:
    """Tables and projections for n classes: as many projections as keep the chance partners of a
    vector in a bucket few whatever n is, and as many tables as find a pair at the threshold with
    the probability ``recall``. Both grow with n, so candidates grow as n to the power of about 1.3."""
    near, far = together(sqrt(2 - 2 * cosine), width), together(sqrt(2), width)
    projections = 10 + max(0, ceil(log(max(n, 1) / 50_000) / -log(far)))
    return ceil(log(1 - recall) / log(1 - near**projections)), projections


def near_vectors(vectors: DataFrame, cosine: float = 0.9, width: float = 2.0, recall: float = 0.91, seed: int = 11) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors are one class. Each class's unit vector is cut into cells of ``width`` along random
    directions in each of several tables (see ``shape``); classes that share all cells of a table are
    compared by their exact cosine. A pair at ``cosine`` meets with the probability ``recall``, a nearer
    one with a higher. A bucket of more than BLOCK classes is dealt out as
    pairs of blocks, so no task holds a bucket; pairs are counted where they meet and not written.

    A vector that is null, empty or zero, or has a null or non-finite component, or no vec_id, links
    with nothing and is kept. Any other vector counts, however large or small its components are.
    Vectors of different length don't link. Rows that repeat a vec_id share
    a component; each counts the links of its own form. An empty table
    gives an empty result. Other columns are not read.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stage(vectors.mapInArrow(_prepared, "vec_id long, digest binary, raw binary"), "vectors")
    classes = rows.filter("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    classes = stage(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    tables, projections = shape(classes.count(), cosine, width, recall)
    signed = stage(classes.mapInArrow(_signatures(tables, projections, width, seed), "table int, key long, cls long, rep long, copies long, raw binary, keys binary"), "signatures")
    sizes = signed.groupBy("table", "key").count().filter("count > 1").withColumn("n", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    met = signed.join(sizes, ["table", "key"]).withColumn("blk", F.pmod(F.xxhash64("rep", "raw"), F.col("n")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = met.withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other")).drop("other", "n")
    group = ["table", "key", "bi", "bj"]
    found = met.repartition(*group).sortWithinPartitions(*group).select(*group, "blk", "cls", "rep", "copies", "raw", "keys")
    found = stage(found.mapInArrow(_linked(cosine), "cls long, links long, rep long, root long"), "found")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = classes.select("cls", "digest", "rep", "copies").join(links, "cls", "left").join(joined, F.col("rep") == F.col("node"), "left")
    classes = stage(classes.select("digest", "rep", "copies", "links", "component"), "classes")
    answered = rows.select("vec_id", "digest").join(classes, "digest", "left")
    component = F.coalesce("component", "rep", "vec_id")
    return answered.select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
