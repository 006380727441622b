"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of SPAN bytes over it also begins in a document with a smaller doc_id.

Sorting all suffixes of all documents would move the corpus many times over. So every string of SPAN
bytes is first filed under an anchor, the GRAM bytes in it with the least hash, which depends on the
string alone: equal strings have equal anchors at equal places. Neighbouring strings share an anchor
and make a piece of text. Pieces that are equal are settled by their hashes; what remains are pieces
with an anchor in common and different text around it. Their suffixes are sorted, within an anchor
and a place of it, by a mergesort whose comparisons find the common extension of two suffixes by
binary search over prefix polynomial hashes; runs of equal strings are then verified byte by byte.
An anchor of GRAM bytes stands in far more documents than a string of SPAN, so pieces are cut in parts,
filed under all bytes that the strings of a part share, and files of one document are left: in two
parts when they are dealt out, and in narrower ones before the sort.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage
from .tokens import slices

SPAN, GRAM = 50, 20
WIDE = SPAN - GRAM + 1
#: Strings of a piece with so many numbers of bytes before the anchor are dealt out together, and then sorted together.
WIDTH, NARROW = (WIDE + 1) // 2, 4
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
PLACE = (1 << 31) - 1
SETTLED = 1 << 30
#: Parts of pieces in one file beyond which their strings are dealt out one by one.
HOT = 20_000

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


class PrefixHashes:
    """Polynomial hashes of any stretch of some bytes from their prefixes' hashes, modulo 2^64."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(INVERSE, len(data)), out=self.sums[1:])
        self.scale = powers(BASE, len(data) + 1)

    def of(self, start, size):
        return (self.sums[start + size] - self.sums[start]) * self.scale[start]


def mix(x: np.ndarray, factor: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(factor)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def pieces(texts: list[bytes]):
    """Document number, begin in it and size of each piece of the texts, and hashes of its anchor and
    of the whole piece with the anchor's place."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if len(data) < SPAN:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    hashes = PrefixHashes(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = mix(hashes.of(at, GRAM), 0xD6E8FEB86659FD93)
    least = sliding_least(((grams >> np.uint64(33)) << np.uint64(31)) | at.astype(np.uint64), WIDE)
    inside = np.flatnonzero(owner[: len(data) - SPAN + 1] == owner[SPAN - 1 :])
    if not len(inside):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = (least[inside] & np.uint64(PLACE)).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], len(inside)) - 1
    begin, end, anchor = inside[first], inside[last] + SPAN, anchor[first]
    doc = owner[begin]
    whole = mix(hashes.of(begin, end - begin) + ((end - begin) * 64 + anchor - begin).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), 0xFF51AFD7ED558CCD)
    return doc, begin - (np.cumsum(sizes) - sizes)[doc], end - begin, grams[anchor], whole


ROWS = "k1 long, k2 long, doc long, t long, hi int"


def _pieces(batches):
    """Rows of k1: 48 bits of the anchor's hash and 16 of the piece's, k2: 32 more of those, the low
    27 of the begin and the size, hi: the rest of the begin. Of equal pieces here only those of the
    smallest document go on; the others are settled and marked so."""
    for batch in batches:
        docs, hashes, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        for a, b in slices(texts):
            doc, begin, size, gram, whole = pieces([(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]])
            ids, t = docs[a:b][doc], hashes[a:b][doc]
            k1 = ((gram >> np.uint64(16)) << np.uint64(16)) | (whole >> np.uint64(48))
            low = ((begin & ((1 << 27) - 1)) << 5 | (size - SPAN)).astype(np.uint64)
            k2 = (((whole >> np.uint64(16)) & np.uint64(0xFFFFFFFF)) << np.uint64(32)) | low
            hi = (begin >> 27).astype(np.int32)
            order = np.lexsort((ids, k2 >> np.uint64(32), k1))
            k1, k2, ids, t, hi = k1[order], k2[order], ids[order], t[order], hi[order]
            if len(k1):
                run = np.concatenate([[True], (k1[1:] != k1[:-1]) | ((k2[1:] ^ k2[:-1]) >> np.uint64(32) != 0)])
                settled = ids > ids[np.flatnonzero(run)][np.cumsum(run) - 1]
                k1[settled] = mix(ids[settled].astype(np.uint64) + k2[settled], 0x94D049BB133111EB)
                hi[settled] |= SETTLED
            yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(ids), pa.array(t), pa.array(hi)], ["k1", "k2", "doc", "t", "hi"])


def _settle(batches):
    """Sorted rows of pieces to (anchor, doc, t, begin, size): anchor null for what is settled, else
    the rows of each variant's smallest document, where an anchor has variants of several documents.

    Of an anchor that runs on into the next batch only marks are held, or the rows of one document.
    """
    held = [np.zeros(0, dtype=np.int64)] * 5 + [np.zeros(0, dtype=bool)] * 2
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(i).to_numpy().astype(np.int64) for i in range(5)]
        done = (new[4] & SETTLED) != 0
        yield _found(np.zeros(int(done.sum()), dtype=np.int64), True, *(x[done] for x in new[1:]))
        new = [x[~done] for x in new]
        n = len(new[0])
        k1, k2, doc, t, hi = (np.concatenate([h, x]) for h, x in zip(held, new))
        old = np.concatenate([np.ones(len(held[0]), dtype=bool), np.zeros(n, dtype=bool)])
        told = np.concatenate([held[6], np.zeros(n, dtype=bool)])
        if not len(k1):
            continue
        anchor, rest = k1 >> 16, k2 >> 32
        by_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        by_piece = by_anchor | np.concatenate([[True], (k1[1:] != k1[:-1]) | (rest[1:] != rest[:-1])])
        starts = np.flatnonzero(by_piece)
        first = doc[starts]
        piece = np.cumsum(by_piece) - 1
        groups = np.flatnonzero(by_anchor[starts])
        low, high = np.minimum.reduceat(first, groups), np.maximum.reduceat(first, groups)
        many = (low < high)[np.cumsum(by_anchor) - 1]
        settled = (doc > first[piece]) & ~old
        yield _found(np.zeros(int(settled.sum()), dtype=np.int64), True, k2[settled], doc[settled], t[settled], hi[settled])
        ask = (doc == first[piece]) & many & ~told
        yield _found(anchor[ask], False, k2[ask], doc[ask], t[ask], hi[ask])
        tail = np.flatnonzero(by_anchor)[-1]
        if many[tail]:
            mine = starts[groups[-1] :]
            docs = doc[mine]
            keep = np.unique([mine[int(np.argmin(docs))], mine[int(np.argmax(docs))], mine[-1]])
        else:
            keep = np.flatnonzero((np.arange(len(k1)) >= tail) & (doc == first[piece]))
        held = [x[keep] for x in (k1, k2, doc, t, hi)] + [old[keep], np.full(len(keep), bool(many[tail]))]


def _found(anchor, null: bool, k2, doc, t, hi) -> pa.RecordBatch:
    begin = ((hi & (SETTLED - 1)) << 27) | ((k2 >> 5) & ((1 << 27) - 1))
    size = (k2 & 31) + SPAN
    anchors = pa.nulls(len(anchor), pa.int64()) if null else pa.array(anchor)
    return pa.RecordBatch.from_arrays([anchors, pa.array(doc), pa.array(t), pa.array(begin), pa.array(size.astype(np.int32))], ["anchor", "doc", "t", "begin", "size"])


FOUND = "anchor long, doc long, t long, begin long, size int"


def parts(pieces: list[bytes], width: int):
    """Number of the piece, first byte, end and a hash of each part of some pieces.

    Strings with k * width to (k + 1) * width - 1 bytes before their anchor are part k. They share more than the anchor:
    the fewest bytes that any of them has before it and after it. The hash is of these; it hangs on the string alone, so
    equal strings are in parts of one hash."""
    sizes = np.array([len(x) for x in pieces], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    hashes = PrefixHashes(np.frombuffer(b"".join(pieces), dtype=np.uint8))
    at = np.arange(len(hashes.sums) - GRAM)
    grams = mix(hashes.of(at, GRAM), 0xD6E8FEB86659FD93)
    least = sliding_least(((grams >> np.uint64(33)) << np.uint64(31)) | at.astype(np.uint64), WIDE)
    anchor = (least[starts] & np.uint64(PLACE)).astype(np.int64)
    place, last = anchor - starts, sizes - SPAN
    found = []
    for few in range(0, WIDE, width):
        many = min(few + width, WIDE) - 1
        first, final = np.maximum(place - many, 0), np.minimum(place - few, last)
        i = np.flatnonzero(first <= final)
        found.append((i, first[i], final[i] + SPAN, mix(hashes.of(anchor[i] - few, SPAN - many + few) + np.uint64(few), 0xC2B2AE3D27D4EB4F)))
    return [np.concatenate(x) for x in zip(*found)]


def of_several(files: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which rows are in files that hold several documents."""
    order = np.argsort(files, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(files[order]) != 0])) if len(files) else order
    some = np.zeros(len(files), dtype=bool)
    if len(files):
        several = np.minimum.reduceat(docs[order], starts) < np.maximum.reduceat(docs[order], starts)
        some[order] = np.repeat(several, np.diff(np.append(starts, len(files))))
    return some


def _cut(batches):
    """The text of the asked pieces, in parts: anchor (a hash of what its strings share), doc, t, begin, piece."""
    for batch in batches:
        docs, hashes, texts, asks = (batch.column(i).to_pylist() for i in range(4))
        begins, found, owner = [], [], []
        for k, (text, ask) in enumerate(zip(texts, asks)):
            data = text.encode("utf-8", "surrogatepass")
            begins += [x["begin"] for x in ask]
            found += [data[x["begin"] : x["begin"] + x["size"]] for x in ask]
            owner += [k] * len(ask)
        for a in range(0, len(found), 20_000):
            part = found[a : a + 20_000]
            piece, begin, end, key = parts(part, WIDTH)
            at = [a + int(i) for i in piece]
            columns = [pa.array(key.view(np.int64)), *(pa.array([x[owner[i]] for i in at], pa.int64()) for x in (docs, hashes)), pa.array(np.array(begins[a : a + 20_000], dtype=np.int64)[piece] + begin)]
            cuts = pa.array([found[i][b:e] for i, b, e in zip(at, begin.tolist(), end.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, cuts], ["anchor", "doc", "t", "begin", "piece"])


class Suffixes:
    """Suffixes of some bytes, compared by their first SPAN bytes."""

    def __init__(self, data: bytes):
        self.data = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(SPAN + 1, dtype=np.uint8)])
        self.hashes = PrefixHashes(self.data)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The length of the common extension, SPAN at most, by binary search over prefix hashes."""
        low, high = np.zeros(len(x), dtype=np.int64), np.full(len(x), SPAN, dtype=np.int64)
        for _ in range(SPAN.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes.of(x, middle) == self.hashes.of(y, middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, np.maximum(middle - 1, low))
        return low

    def before(self, x: np.ndarray, y: np.ndarray, rank: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether x sorts before y, where equal ones follow their rank."""
        n = self.common(x, y)
        whole = n >= SPAN
        return np.where(whole, rank[i] < rank[j], self.data[x + n] < self.data[y + n])

    def sort(self, at: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """An order of the suffixes ``at`` by group, text and rank (distinct): a bottom-up mergesort
        that merges all groups' runs of one width side by side."""
        order = np.argsort(group, kind="stable")
        group = group[order]
        starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if len(group) else 0))
        sizes = np.diff(np.append(starts, len(group)))
        base, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        width = 1
        while len(sizes) and width < sizes.max():
            i = np.flatnonzero(size > width)
            local = i - base[i]
            left = (local // width) % 2 == 0
            pair = local // (2 * width) * (2 * width)
            middle = np.minimum(pair + width, size[i])
            end = np.minimum(pair + 2 * width, size[i])
            low, high = np.where(left, middle, pair), np.where(left, end, middle)
            begin = low.copy()
            live = np.flatnonzero(low < high)
            while len(live):
                m = (low[live] + high[live]) >> 1
                mine, other = order[i[live]], order[base[i[live]] + m]
                less = self.before(at[other], at[mine], rank, other, mine)
                low[live] = np.where(less, m + 1, low[live])
                high[live] = np.where(less, high[live], m)
                live = live[low[live] < high[live]]
            own = local - np.where(left, pair, middle)
            target = base[i] + pair + own + (low - begin)
            merged = order.copy()
            merged[target] = order[i]
            order = merged
            width *= 2
        return order


def repeated(anchors: np.ndarray, docs: np.ndarray, texts: list[bytes]):
    """Number of the piece, begin in it and size of each stretch that pieces of the same anchor in a
    smaller document have too."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    strings = sizes - SPAN + 1
    owner = np.repeat(np.arange(len(texts)), strings)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = (np.cumsum(sizes) - sizes)[owner] + place
    data = b"".join(texts)
    suffixes = Suffixes(data)
    grams = mix(suffixes.hashes.of(np.arange(len(data)), np.minimum(GRAM, len(data) + SPAN - np.arange(len(data)))), 0xD6E8FEB86659FD93)
    least = sliding_least(((grams >> np.uint64(33)) << np.uint64(31)) | np.arange(len(grams), dtype=np.uint64), WIDE)
    where = (least[at] & np.uint64(PLACE)).astype(np.int64) - at
    _, group = np.unique(anchors, return_inverse=True)
    rank = np.argsort(np.argsort(docs[owner], kind="stable"), kind="stable")
    order = suffixes.sort(at, group[owner] * 64 + where, rank)
    x, y = order[:-1], order[1:]
    key = group[owner] * 64 + where
    equal = (key[x] == key[y]) & (suffixes.common(at[x], at[y]) >= SPAN)
    i = np.flatnonzero(equal)
    for k in range(0, len(i), 200_000):  # verified byte by byte
        part = i[k : k + 200_000]
        step = np.arange(SPAN)
        equal[part] = (suffixes.data[at[x[part]][:, None] + step] == suffixes.data[at[y[part]][:, None] + step]).all(axis=1)
    run = np.cumsum(np.concatenate([[True], ~equal])) - 1
    first = docs[owner[order]][np.flatnonzero(np.concatenate([[True], ~equal]))]
    hit = np.zeros(len(owner), dtype=bool)
    hit[order] = docs[owner[order]] > first[run]
    at_hit = np.flatnonzero(hit)
    if not len(at_hit):
        return at_hit, at_hit, at_hit
    new = np.concatenate([[True], (np.diff(at_hit) > 1) | (np.diff(owner[at_hit]) > 0)])
    begin = at_hit[new]
    end = at_hit[np.append(np.flatnonzero(new)[1:], len(at_hit)) - 1]
    return owner[begin], place[begin], end - begin + SPAN


def _sorted_suffixes(batches):
    """Parts of pieces in order of their file to the stretches (doc, t, begin, size) found in smaller documents."""

    def answer(rows):
        anchors, docs, t, begin = (np.concatenate([r[k] for r in rows]) for k in range(4))
        some = of_several(anchors, docs)
        docs, t, begin, texts = docs[some], t[some], begin[some], list(compress((x for r in rows for x in r[4]), some))
        row = start = end = np.zeros(0, dtype=np.int64)
        if texts:
            row, first, stop, files = parts(texts, NARROW)
            some = of_several(files.view(np.int64), docs[row])
            row, first, stop, files = (x[some] for x in (row, first, stop, files))
        if len(row):
            piece, start, size = repeated(files, docs[row], [texts[i][a:b] for i, a, b in zip(row.tolist(), first.tolist(), stop.tolist())])
            row, start = row[piece], first[piece] + start
            order = np.lexsort((start, row))
            row, start, end = row[order], start[order], (start + size)[order]
        if len(row):  # parts of a piece that follow each other are one stretch
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > end[:-1])])
            end = end[np.append(np.flatnonzero(new)[1:], len(row)) - 1]
            row, start = row[new], start[new]
        return pa.RecordBatch.from_arrays([pa.array(docs[row]), pa.array(t[row]), pa.array(begin[row] + start), pa.array((end - start).astype(np.int32))], ["doc", "t", "begin", "size"])

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [*(batch.column(i).to_numpy() for i in range(4)), batch.column(4).to_pylist()]
        anchors = columns[0]
        cut = int(np.flatnonzero(anchors != anchors[-1])[-1]) + 1 if (anchors != anchors[-1]).any() else 0
        if held and (cut or held[-1][0][-1] != anchors[0]):
            if held[-1][0][-1] != anchors[0]:
                if n >= HOT:
                    yield answer(held)
                    held, n = [], 0
        if cut:
            held.append([c[:cut] for c in columns])
            n += cut
            if n >= HOT:
                yield answer(held)
                held, n = [], 0
        held.append([c[cut:] for c in columns])
        n += len(anchors) - cut
    if held:
        yield answer(held)


def _strings(batches):
    """Pieces to their strings: string, doc, t, begin."""
    for batch in batches:
        docs, hashes, begins, texts = (batch.column(i).to_pylist() for i in (1, 2, 3, 4))
        for a in range(0, len(docs), 2000):
            rows = [(x[k : k + SPAN], d, t, b + k) for d, t, b, x in zip(docs[a : a + 2000], hashes[a : a + 2000], begins[a : a + 2000], texts[a : a + 2000]) for k in range(len(x) - SPAN + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3))], ["string", "doc", "t", "begin"])


def _cleaned(batches):
    for batch in batches:
        docs, texts, ranges = (batch.column(i) for i in range(3))
        n_bytes, removed, spans, hashes = [], [], [], []
        for text, found in zip(texts.to_pylist(), ranges):
            data = (text or "").encode("utf-8", "surrogatepass")
            n_bytes.append(len(data))
            if not found.is_valid or not len(found.values):
                removed.append(0)
                spans.append(0)
                hashes.append(sha256(data).hexdigest())
                continue
            begin, size = (found.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            edge = np.zeros(len(data) + 1, dtype=np.int64)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + size, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            hashes.append(sha256(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([docs, pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes), ranges], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "ranges"])


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text, ranges (array of (begin, size) in bytes, may overlap, null for none) of each row.

    Null texts are empty. A null doc_id neither loses bytes nor takes any. Rows that repeat a doc_id
    are documents of that number each, so they don't take from each other.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    rows = docs.filter("doc_id is not null and text is not null").mapInArrow(_pieces, ROWS)
    rows = rows.repartition(F.shiftright("k1", 16)).sortWithinPartitions("k1", F.shiftright("k2", 32), "doc")
    found = stage(rows.mapInArrow(_settle, FOUND), "repeats")

    asks = found.filter("anchor is not null")
    by_doc = asks.groupBy("doc", "t").agg(F.collect_list(F.struct("begin", "size")).alias("asks"))
    texts = docs.join(by_doc, (F.col("doc_id") == F.col("doc")) & (docs["t"] == by_doc["t"]))
    cut = texts.select("doc_id", docs["t"], "text", "asks").mapInArrow(_cut, "anchor long, doc long, t long, begin long, piece binary")
    cut = stage(cut.dropDuplicates(["anchor", "doc", "t", "begin"]), "pieces")

    # files with very many parts: their strings meet by text, the smallest document first
    hot = cut.groupBy("anchor").count().filter(F.col("count") > HOT).select("anchor")
    hot = stage(hot, "hot")
    strings = cut.join(hot, "anchor", "left_semi").select("anchor", "doc", "t", "begin", "piece").mapInArrow(_strings, "string binary, doc long, t long, begin long")
    least = strings.groupBy("string").agg(F.min("doc").alias("least"))
    by_string = strings.join(least, "string").filter("doc > least").select("doc", "t", "begin", F.lit(SPAN).alias("size"))

    rest = cut.join(hot, "anchor", "left_anti").select("anchor", "doc", "t", "begin", "piece")
    rest = rest.repartition("anchor").sortWithinPartitions("anchor")
    by_sort = rest.mapInArrow(_sorted_suffixes, "doc long, t long, begin long, size int")
    ranges = found.filter("anchor is null").select("doc", "t", "begin", "size").unionByName(by_sort).unionByName(by_string)
    ranges = ranges.groupBy("doc", "t").agg(F.collect_list(F.struct("begin", "size")).alias("ranges")).withColumnRenamed("t", "_t")
    return docs.join(ranges, (F.col("doc_id") == F.col("doc")) & (F.col("t") == F.col("_t")), "left").select("doc_id", "text", "ranges")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, ranges of each row; see ``repeated_ranges``.

    An empty table gives an empty result. Other columns are not read.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, ranges array<struct<begin:long,size:int>>"
    return repeated_ranges(docs).mapInArrow(_cleaned, schema)
