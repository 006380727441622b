"""Token-ID files: canonical length-limited Huffman codes from global counts.

The format is a folder with two Parquet tables:

- ``codebook``, one row: ``limit`` int, ``lengths`` binary (a byte for each id: the length of its
  code in bits, 0 for an id that does not occur). Codes are canonical: they count up by (length, id).
- ``blocks``, one row per block of whole documents: ``part`` and ``block`` int (their order is that
  of doc_id), ``tokens_before`` long (ids of the part's earlier blocks), ``doc_ids``, ``n_tokens``
  (arrays, one entry per document), ``bits`` binary (32-bit big-endian words) and ``checkpoints``
  binary (little-endian 32-bit: the bit at which every ``STEP``-th id of the block begins).

Blocks are independent, and so are the stretches between checkpoints: a block is decoded by table
look-up in all its stretches at once.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, stage, unstage
from .tokens import encoder, slices

STEP = 128
BLOCK_IDS = 1 << 18

RAW = "part int, block int, tokens_before long, doc_ids array<long>, n_tokens array<long>, ids binary, used binary, counts binary"
CODED = "part int, block int, tokens_before long, doc_ids array<long>, n_tokens array<long>, bits binary, checkpoints binary"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    row, leaves = weights, [np.ones(len(order), dtype=bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        row = both[at]
        leaves.append(at < len(order))
    take = 2 * len(order) - 2
    for leaf in reversed(leaves):
        n = int(leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


class Code:
    """Canonical codes and the decoding table of some code lengths."""

    def __init__(self, lengths: np.ndarray, limit: int):
        self.lengths, self.limit = lengths.astype(np.int64), limit
        symbols = np.flatnonzero(lengths)
        symbols = symbols[np.lexsort((symbols, lengths[symbols]))]
        spans = 1 << (limit - self.lengths[symbols])
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[symbols] = ((np.cumsum(spans) - spans) >> (limit - self.lengths[symbols])).astype(np.uint64)
        fill = (1 << limit) - int(spans.sum())
        # an id and, in the low byte, the length of its code
        self.table = np.concatenate([np.repeat(symbols << 8 | self.lengths[symbols], spans), np.ones(fill, dtype=np.int64)]).astype(np.uint32)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The bits and the checkpoints."""
        if not len(ids):
            return b"", b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        begins = ends - lengths
        word = begins >> 5
        placed = self.codes[ids] << (64 - (begins & 31) - lengths).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))  # a code is shorter than a word, so no word is skipped
        sums = np.add.reduceat(placed, first)
        words = np.zeros(int(ends[-1] >> 5) + 2, dtype=np.uint64)
        words[: len(sums)] = sums >> np.uint64(32)
        words[1 : len(sums) + 1] |= sums & np.uint64(0xFFFFFFFF)
        return words[: int(ends[-1] + 31) >> 5].astype(">u4").tobytes(), begins[::STEP].astype("<u4").tobytes()

    def decode(self, bits: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        at = np.frombuffer(checkpoints, dtype="<u4").astype(np.int64)
        words = np.concatenate([np.frombuffer(bits, dtype=">u4"), np.zeros(2, dtype=">u4")]).astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        out = np.zeros((STEP, len(at)), dtype=np.uint32)
        table = self.table
        shift = np.uint64(64 - self.limit)
        last = len(pairs) - 1
        for step in range(min(STEP, n)):
            seen = (pairs[np.minimum(at >> 5, last)] << (at & 31).astype(np.uint64)) >> shift
            got = table[seen]
            out[step] = got
            at += got & 255
        return out.T.reshape(-1)[:n] >> 8


def _kind(size: int) -> str:
    """The type that holds ids below ``size`` between the steps."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _blocks(path: str, end_id: int, size: int):
    """Batches of (doc_id, text) in order to raw blocks, and one more row: the ids used and their counts."""
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    schema = pa.schema(list(zip(["part", "block", "tokens_before", "doc_ids", "n_tokens", "ids", "used", "counts"], kinds)))

    def run(batches):
        part, block, before = TaskContext.get().partitionId(), 0, 0
        encode = encoder(path).encode
        end = np.asarray([end_id], dtype="<u4").tobytes()
        counts = np.zeros(size, dtype=np.int64)
        docs, sizes, held, total = [], [], [], 0

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part, *values), kinds)], schema=schema)

        def flush():
            nonlocal block, before, docs, sizes, held, total, counts
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            counts += np.bincount(ids, minlength=size)
            found = row(block, before, docs, sizes, ids.astype(_kind(size)).tobytes(), None, None)
            block, before = block + 1, before + total
            docs, sizes, held, total = [], [], [], 0
            return found

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, 1_000_000):
                for doc, coded in zip(ids[a:b], encode([t or "" for t in texts[a:b]])):
                    docs.append(doc)
                    sizes.append(len(coded) // 4 + 1)
                    held += (coded, end)
                    total += sizes[-1]
                    if total >= BLOCK_IDS:
                        yield flush()
        if docs:
            yield flush()
        used = np.flatnonzero(counts)
        yield row(None, None, None, None, None, used.astype("<u4").tobytes(), counts[used].astype("<i8").tobytes())

    return run


def _counts(batches):
    for batch in batches:
        for used, counts in zip(batch.column(0), batch.column(1)):
            ids, n = np.frombuffer(used.as_buffer(), dtype="<u4"), np.frombuffer(counts.as_buffer(), dtype="<i8")
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(n)], ["id", "n"])


def _coded(lengths: bytes, limit: int, kind: str):
    def run(batches):
        code = Code(np.frombuffer(lengths, dtype=np.uint8), limit)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                bits, checkpoints = code.encode(np.frombuffer(row.column(5)[0].as_buffer(), dtype=kind))
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[:5], pa.array([bits], pa.binary()), pa.array([checkpoints], pa.binary())],
                    ["part", "block", "tokens_before", "doc_ids", "n_tokens", "bits", "checkpoints"],
                )

    return run


def write_token_file(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> None:
    """Writes the ids of all texts, each with ``end_id`` behind it, in ascending order of doc_id.

    A null text is empty. A null doc_id comes first. Rows that repeat a doc_id follow each other.
    A very long text is a block of its own. An empty table gives a file with no blocks. Other columns
    are not read.
    """
    spark = docs.sparkSession
    size = max(encoder(tokenizer).vocabulary, end_id + 1)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    raw = stage(ordered.mapInArrow(_blocks(tokenizer, end_id, size), RAW), "ids")
    counts = np.zeros(size, dtype=np.int64)
    # one row for each id of the vocabulary at most
    for row in raw.filter("counts is not null").select("used", "counts").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    limit = max(16, int(size - 1).bit_length() + 1)
    lengths = code_lengths(counts, limit).tobytes()
    spark.createDataFrame([(limit, bytearray(lengths))], "limit int, lengths binary").write.parquet(f"{folder}/codebook")
    blocks = raw.filter("block is not null").drop("used", "counts")
    blocks.mapInArrow(_coded(lengths, limit, _kind(size)), CODED).write.option("compression", "none").parquet(f"{folder}/blocks")
    unstage(raw)


def _decoded(lengths: bytes, limit: int):
    def run(batches):
        code = Code(np.frombuffer(lengths, dtype=np.uint8), limit)
        for batch in batches:
            for part, before, docs, sizes, bits, checkpoints in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6))):
                ids = code.decode(bits, checkpoints, sum(sizes))
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(docs), pa.int32()),
                        pa.array(docs, pa.int64()),
                        pa.array(before + ends - sizes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, sizes)], pa.binary()),
                    ],
                    ["part", "doc_id", "start", "n_tokens", "ids"],
                )

    return run


def read_token_file(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary) of each document."""
    book = spark.read.parquet(f"{folder}/codebook").first()
    blocks = spark.read.schema(CODED).parquet(f"{folder}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("_n"))
    bases = sizes.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rows = blocks.mapInArrow(_decoded(bytes(book["lengths"]), book["limit"]), "part int, doc_id long, start long, n_tokens long, ids binary")
    # one row for each part that was written
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("start") + F.col("_base")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes a token file to the shared folder and returns a digest of what is read from it."""
    folder = new_path(docs.sparkSession, "tokens")
    write_token_file(docs, tokenizer, folder, end_id)
    return read_token_file(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
