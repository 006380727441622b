"""Whitening of vectors from an exact scatter that is summed in residues of several primes."""

from __future__ import annotations

from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

#: Residues lie between -2^20 and 2^20, so a product of 4096 rows is exact in a double.
LARGEST, ROWS = 1 << 21, 4096
OFFSET, SCALE, MOST = 1_000_000, 64, float(1 << 60)


def primes(bound: int) -> list[int]:
    """The largest primes below LARGEST, as many as tell apart all integers of an absolute value up to ``bound``."""
    found: list[int] = []
    number = LARGEST - 1
    while prod(found) <= 2 * bound:
        if all(number % d for d in range(3, isqrt(number) + 1, 2)):
            found.append(number)
        number -= 2
    return found


def reconstruct(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The integers, as Python's, of the least absolute value with these residues."""
    whole = prod(moduli)
    total = sum(r.astype(object) * (whole // p * pow(whole // p, -1, p)) for r, p in zip(residues, moduli)) % whole
    return np.where(total > whole // 2, total - whole, total)


def _matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return batch.column(batch.schema.names.index(name)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(dim: int):
    """Rows, and by dimension the sum (as its parts above and below 32 bits), the least and the largest entry."""

    def run(batches):
        n, high, low, least, most = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64), None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, "x", dim)
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
                least = x.min(axis=0) if least is None else np.minimum(least, x.min(axis=0))
                most = x.max(axis=0) if most is None else np.maximum(most, x.max(axis=0))
        if n:
            columns = np.arange(dim), np.full(dim, n), high, low, least, most
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["d", "n", "high", "low", "least", "most"])

    return run


def _scatter(centre: np.ndarray, moduli: list[int]):
    """Rows of the scatter of x - centre modulo each prime: (prime, row, values)."""

    def run(batches):
        dim = len(centre)
        sums = [np.zeros((dim, dim), dtype=np.int64) for _ in moduli]
        for batch in batches:
            z = _matrix(batch, "x", dim) - centre
            for k in range(0, len(z), ROWS):
                for s, p in zip(sums, moduli):
                    r = z[k : k + ROWS] % p
                    r = np.where(r > p // 2, r - p, r).astype(np.float64)
                    s += (r.T @ r).astype(np.int64) % p
                    s %= p
        for k, s in enumerate(sums):
            yield pa.RecordBatch.from_arrays([pa.array([k] * dim, pa.int64()), pa.array(np.arange(dim), pa.int64()), pa.array(list(s), pa.list_(pa.int64()))], ["prime", "row", "values"])

    return run


def _added(moduli: list[int]):
    """The sum of all partitions' rows of one prime and place, modulo the prime; read batch by batch."""

    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, row, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = values.values.to_numpy(zero_copy_only=False)
                held[k, row] = (held[k, row] + x) % moduli[k] if (k, row) in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([r for _, r in held], pa.int64()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["prime", "row", "values"])

    return run


def _moments(n: int, total: list[int], projection: np.ndarray):
    """Sums of the whitened rows and of their products, a row per partition and component."""

    def run(batches):
        dim, width = projection.shape
        first, second = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            w = _centred(_matrix(batch, "x", dim), n, total)[1] @ projection
            first += w.sum(axis=0)
            second += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int64()), pa.array(first), pa.array(list(second), pa.list_(pa.float64()))], ["component", "first", "second"])

    return run


def _centred(x: np.ndarray, n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n*x - total exactly (as Python's integers where 64 bits may not do) and divided by n in doubles."""
    middle = np.array([t // n for t in total], dtype=np.int64)
    rest = np.array([t % n for t in total], dtype=np.int64)
    z = x - middle
    if len(z) and n * (int(np.abs(z).max()) + 1) * 2 >= 1 << 62:
        z = z.astype(object)
    whole = z * n - rest
    return whole, z.astype(np.float64) - rest.astype(np.float64) / n


def _whitened(n: int, total: list[int], projection: np.ndarray, explained: np.ndarray, error: float):
    """(vec_id, x) to a row per component."""

    def run(batches):
        dim, width = projection.shape
        for batch in batches:
            x = _matrix(batch, "x", dim)
            whole, z = _centred(x, n, total)
            if whole.dtype != object and len(whole) and dim * int(np.abs(whole).max()) ** 2 >= 1 << 63:
                whole = whole.astype(object)
            deviation = [v if v < 1 << 63 else None for v in (whole * whole).sum(axis=1).tolist()]
            count = len(x) * width
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), width))),
                pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                pa.array(np.full(count, n, dtype=np.int64)),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), width))),
                pa.array((z @ projection).reshape(-1)),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(count, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, x: the rows whose entries are all finite, as integers floor(64 c) + 1,000,000.

    Entries beyond 2^60 times the scale are cut there. A vector that is null or empty or holds a null or
    non-finite entry is left out, as are the vectors of another length than most rows have (of lengths
    that tie the shortest)."""
    c = lambda e: e.cast("double")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("_v")).filter("size(_v) > 0")
    rows = rows.filter(F.forall("_v", lambda e: F.coalesce(~F.isnan(c(e)) & (F.abs(c(e)) != float("inf")), F.lit(False))))
    x = F.transform("_v", lambda e: F.floor(F.greatest(F.least(c(e) * SCALE, F.lit(MOST)), F.lit(-MOST))) + OFFSET)
    rows = stage(rows.select("vec_id", x.alias("x")), "scaled")
    length = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return rows.filter(F.size("x") == (length["length"] if length else 0))


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """Each vector's first principal components at unit variance: vec_id, component (from 1), n, deviation,
    whitened, explained, identity_error.

    Vectors become integers (see ``scaled``). Mean and covariance are those of the distinct ones. Each
    partition multiplies its centred rows modulo several primes, the sums are reduced by prime and place,
    and Chinese remainders give the scatter as exact integers, whatever the size of the mean. Its
    eigenvectors are found in doubles; ``identity_error`` is measured on the whitened rows themselves.

    Every row counts once in the result, also where rows repeat a vec_id or a vector; the fit sees a
    vector once. Components without variance, up to rounding, have no rows, so that one vector, or
    equal ones alone, give no rows. A deviation that doesn't fit 64 bits is null. A null vec_id stays. An empty
    table gives an empty result. Other columns are not read. The driver holds matrices of the vectors'
    length squared and nothing that grows with the rows.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = scaled(vectors)
    fit = stage(rows.select("x").distinct(), "fit")
    first = fit.select(F.size("x")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    dim = first[0]
    stats = fit.mapInArrow(_sums(dim), "d long, n long, high long, low long, least long, most long").groupBy("d")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    by_dim = stats.agg(F.sum("n").alias("n"), wide("high"), wide("low"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("d").collect()  # a row per dimension
    n, total = by_dim[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in by_dim]
    centre = [t // n for t in total]
    largest = max(max(r["most"] - c, c - r["least"]) for r, c in zip(by_dim, centre))
    moduli = primes(n * largest * largest + 1)
    parts = fit.mapInArrow(_scatter(np.array(centre, dtype=np.int64), moduli), "prime long, row long, values array<long>")
    reduced = parts.repartition("prime", "row").mapInArrow(_added(moduli), "prime long, row long, values array<long>").collect()  # primes x dimensions
    residues = [np.zeros((dim, dim), dtype=np.int64) for _ in moduli]
    for r in reduced:
        residues[r["prime"]][r["row"]] = r["values"]
    rest = np.array([t - n * c for t, c in zip(total, centre)], dtype=object)
    # n^2 times the covariance, centred at the true mean, in exact integers
    exact = reconstruct(residues, moduli) * n - np.outer(rest, rest)
    covariance = np.array([[v / (n * n) for v in row] for row in exact.tolist()], dtype=np.float64)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    trace = sum(int(exact[k, k]) for k in range(dim)) / (n * n)
    some = np.flatnonzero(values > max(values[0], 0) * dim * np.finfo(np.float64).eps)[:components]
    if not len(some):
        return spark.createDataFrame([], schema)
    projection = axes[:, some] / np.sqrt(values[some])
    moments = fit.mapInArrow(_moments(n, total, projection), "component long, first double, second array<double>")
    moments = moments.groupBy("component").agg(F.sum("first").alias("first"), *[F.sum(F.get("second", F.lit(k))).alias(f"s{k}") for k in range(len(some))]).orderBy("component").collect()
    mean = np.array([r["first"] for r in moments]) / n
    second = np.array([[r[f"s{k}"] for k in range(len(some))] for r in moments]) / n
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(len(some))).max())
    return rows.mapInArrow(_whitened(n, total, projection, values[some] / trace, error), schema)
