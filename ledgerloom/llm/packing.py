"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Only the lengths matter for the plan, and there are at most ``capacity`` of them. So the plan is made
on counts by length, whose size does not grow with the data, and gives runs of equal sequences. The
pieces then find their places from their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import running_total, stage
from .tokens import encoder, slices


class Plan:
    """Runs of equal places: for pieces of a length from a rank on, ``each`` pieces go to every one of
    ``bins`` sequences from ``first`` on, at ``offset`` and behind it."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.counts = capacity, counts.astype(np.int64).copy()
        self.ranks = np.zeros(capacity + 1, dtype=np.int64)
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.fixed = 0
        self._reduce()
        self._best_fit()

    def _place(self, length: int, each: int, bins: int, first: int, offset: int) -> None:
        self.runs.append((length, int(self.ranks[length]), each, bins, first, offset))
        self.ranks[length] += each * bins
        self.counts[length] -= each * bins

    def _fix(self, lengths: tuple[int, ...], bins: int) -> None:
        offset = 0
        for x in lengths:
            self._place(x, 1, bins, self.sequences, offset)
            offset += x
        self.sequences += bins
        self.fixed += bins

    def _reduce(self) -> None:
        """Fixes sequences that some best packing has, largest piece first.

        With a piece j and the room C - j left: a single piece that fills the room, or that is the
        only kind of partner because no two fit, takes the place of whatever else a best packing has
        there. Where at most two fit, the same holds for a single that is as long as any two, and for
        a pair whose longer is the longest that fits and whose shorter is no shorter than the shorter
        of any pair.
        """
        for j in range(self.capacity, 0, -1):
            while self.counts[j]:
                self.counts[j] -= 1
                room = self.capacity - j
                some = np.flatnonzero(self.counts[: room + 1])
                small = np.flatnonzero(self.counts)[:3]
                least = np.repeat(small, np.minimum(self.counts[small], 3))[:3]
                self.counts[j] += 1
                if not len(some):
                    self._fix((j,), int(self.counts[j]))
                    continue
                top = int(some[-1])
                two = len(least) > 1 and least[0] + least[1] <= room
                three = len(least) > 2 and least.sum() <= room
                if top == room or not two:
                    partners = (top,)
                elif not three:
                    left = self.counts.copy()
                    left[j] -= 1
                    left[top] -= 1
                    second = np.flatnonzero(left[: max(0, room - top) + 1])
                    pair = int(second[-1]) if len(second) else 0
                    halves = some[some <= room // 2]
                    best = self._longest_pair(j, room)
                    if top >= best:
                        partners = (top,)
                    elif pair and len(halves) and halves[-1] <= pair:
                        partners = (top, pair)
                    else:
                        break
                else:
                    break
                need = defaultdict(int)
                for x in (j, *partners):
                    need[x] += 1
                bins = min(int(self.counts[x]) // n for x, n in need.items())
                if not bins:
                    break
                self._fix((j, *partners), bins)

    def _longest_pair(self, j: int, room: int) -> int:
        """The longest sum of two other pieces that fits."""
        left = self.counts.copy()
        left[j] -= 1
        some = np.flatnonzero(left[: room + 1])
        best = 0
        for a in some[::-1]:
            if 2 * a <= best:
                break
            left[a] -= 1
            fits = np.flatnonzero(left[: min(a, room - a) + 1]) if room >= a else []
            left[a] += 1
            if len(fits):
                best = max(best, int(a + fits[-1]))
        return best

    def _best_fit(self) -> None:
        """Best-fit decreasing over groups of equally filled sequences."""
        room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: (bins, first)
        open_ = np.zeros(self.capacity + 1, dtype=bool)

        def put(left: int, bins: int, first: int) -> None:
            if bins and left:
                room[left].append((bins, first))
                open_[left] = True

        for x in range(self.capacity, 0, -1):
            while self.counts[x]:
                n = int(self.counts[x])
                fits = np.flatnonzero(open_[x:])
                if len(fits):
                    left = x + int(fits[0])
                    bins, first = room[left].pop()
                    open_[left] = bool(room[left])
                else:
                    left, bins, first = self.capacity, -(-n // (self.capacity // x)), self.sequences
                    self.sequences += bins
                each = min(left // x, n)
                used = min(bins, n // each)
                self._place(x, each, used, first, self.capacity - left)
                put(left - each * x, used, first)
                put(left, bins - used, first + used)


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches):
        encode = encoder(path).encode
        end = np.asarray([end_id], dtype="<u4").tobytes()
        wide = 4 * capacity
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts, 1_000_000):
                rows = [(k, p, coded[p * wide : p * wide + wide]) for k, coded in enumerate(x + end for x in encode([t or "" for t in texts[a:b]])) for p in range(-(-len(coded) // wide))]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a).take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([r[1] for r in rows], pa.int32()),
                        pa.array([r[1] * capacity for r in rows], pa.int64()),
                        pa.array([len(r[2]) // 4 for r in rows], pa.int64()),
                        pa.array([zlib.crc32(r[2]) for r in rows], pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def _placed(keys: np.ndarray, runs: np.ndarray, starts: np.ndarray):
    """keys: length << 40 | rank at which each run begins, ascending; starts: pieces that are shorter
    than each length."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(x)).to_numpy() for x in ("length", "_before"))
            rank = rank - starts[length]
            at = np.searchsorted(keys, (length << 40) | rank, side="right") - 1
            _, begin, each, _, first, offset = runs[at].T
            i = rank - begin
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(x)) for x in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(first + i // each), pa.array(offset + i % each * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; one longer than ``capacity`` is cut into pieces of that
    length, of which the last may be shorter, however long it is. A null text is empty, so its piece is
    the end id. Rows that repeat a doc_id, null or not, are packed each; pieces of one length take their
    places in the order of doc_id, piece and ids. An empty table gives no pieces. Other columns are not
    read.
    """
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, end_id, capacity), f"doc_id {doc_id}, piece int, start long, length long, ids_crc32 long")
    pieces = stage(pieces, "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    # capacity rows at most
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    plan = Plan(counts, capacity)
    runs = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 6)
    # ranks count over ranges of pieces by length and id, so a length that most pieces have is dealt out too
    ranked = running_total(pieces.withColumn("_one", F.lit(1)), ["length", "doc_id", "piece", "ids_crc32"], "_one", "_before")
    return ranked.mapInArrow(_placed((runs[:, 0] << 40) | runs[:, 1], runs, np.cumsum(counts) - counts), f"doc_id {doc_id}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
