"""Similarity join of word shingles: a grouped prefix join, then components of its links."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import only, stage, unstage
from .tokens import slices

#: Counters of how often shingles occur; they only order shingles, rare ones first.
COUNTERS = 1 << 18
#: Bits of a set's short parity sketch, and rows of a list's block.
BITS, BLOCK = 1024, 1_000
#: Postings that are written at once.
POSTINGS = 100_000
#: Groups of each shingle's list that all others are paired with.
FIRSTS = 3
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, width: int, limit: int = 300_000):
        self.width, self.limit, self.known = width, limit, {}
        self.factors = np.random.default_rng(5).integers(1, 1 << 62, size=width, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def _new(self, word: bytes) -> int:
        import xxhash

        if len(self.known) >= self.limit:
            self.known = {}
        got = self.known[word] = xxhash.xxh64_intdigest(word)
        return got

    def shingles(self, text: str | None) -> np.ndarray:
        # bytes know ASCII only: lower() changes A-Z, split() cuts at 0x20 and 0x09-0x0D
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known.get
        h = np.array([known(w) or self._new(w) for w in words], dtype=np.uint64)
        width = min(self.width, len(h))
        n = len(h) - width + 1
        total = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            total += h[k : k + n] * self.factors[k]
        total ^= total >> np.uint64(32)
        total *= MIX[3]
        return np.unique(total ^ (total >> np.uint64(29)))


def _shingler(width: int) -> Shingler:
    """One shingler in a Python worker, which then knows the words of its earlier tasks."""
    return only(("shingler", width), lambda: Shingler(width))


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) & (COUNTERS - 1)


def _count(width: int):
    def run(batches):
        shingler, total, held, n = _shingler(width), np.zeros(COUNTERS, dtype=np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(_counter(shingler.shingles(text)))
                n += len(held[-1])
                if n >= COUNTERS:
                    total += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, n = [], 0
        total += np.bincount(np.concatenate([*held, np.zeros(0, dtype=np.int64)]), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["counter", "n"])

    return run


def _sketch(s: np.ndarray) -> bytes:
    """A bit for each place in a power of two of BITS or more, no fewer than the set has shingles: the
    parity of the shingles that hash to it. So two sketches differ in no more bits than the sets have
    shingles of one only, and the two halves of a sketch, one over the other, are the next shorter one."""
    bits = max(BITS, 1 << (len(s) - 1).bit_length()) if len(s) else BITS
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _folded(rows: list[bytes], size: int) -> np.ndarray:
    """Sketches of one length, folded to ``size`` bytes."""
    x = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)
    while x.shape[1] > size:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def _sign(width: int, percent: int, counts: bytes):
    """doc_id, t, n, digest of the set (null for none), prefix: its rarest shingles, in order, its
    sketch, and that folded to BITS."""

    def run(batches):
        shingler, often = _shingler(width), np.frombuffer(counts, dtype="<i8")
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts):
                sizes, digests, prefixes, sketches, wides = [], [], [], [], []
                for text in texts[a:b]:
                    s = shingler.shingles(text)
                    n = len(s)
                    sizes.append(n)
                    digests.append(blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                    some = n + percent * -n // 100 + 1 if n else 0  # n - ceil(n * percent / 100) + 1
                    at = np.lexsort((s, often[_counter(s)]))[:some]
                    prefixes.append(s[at].astype("<u8").tobytes())
                    wides.append(_sketch(s))
                    sketches.append(_folded(wides[-1:], BITS // 8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(a, b - a) for k in (0, 1)),
                        pa.array(sizes, pa.int64()),
                        *(pa.array(x, pa.binary()) for x in (digests, prefixes, sketches, wides)),
                    ],
                    ["doc_id", "t", "n", "digest", "prefix", "sketch", "wide"],
                )

    return run


def _tokens(batches):
    """Postings: each shingle of a prefix, its place there, and the rest of the row, about POSTINGS at a time."""
    for batch in batches:
        names = [n for n in batch.schema.names if n != "prefix"]
        prefix = batch.column(batch.schema.names.index("prefix"))
        ends = np.cumsum([len(p.as_buffer()) // 8 for p in prefix])
        cuts = [0, *(np.flatnonzero(np.diff(ends // POSTINGS)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.select(names).slice(a, b - a)
            prefixes = [np.frombuffer(p, dtype="<i8") for p in prefix.slice(a, b - a).to_pylist()]
            sizes = [len(p) for p in prefixes]
            # without the prefixes, which would be copied once for each of their postings
            rest = part.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes)), pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])), *rest.columns], ["token", "pos", *names])


def _set_of(width: int):
    def run(batches):
        shingler = _shingler(width)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 1_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([shingler.shingles(t).astype("<u8").tobytes() for t in texts[a:b]], pa.binary())], ["id", "items"])

    return run


def _sketched(percent: int):
    """The pairs (a, b) and the bits that differ, where sketches allow the similarity, from a, b, their
    sizes and sketches. Of two sketches the longer is folded."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            by_size: dict[tuple[int, int], list[int]] = {}
            for i, (p, q) in enumerate(zip(x, y)):
                by_size.setdefault((len(p), len(q)), []).append(i)
            apart = np.zeros(len(x), dtype=np.int64)
            for (p, q), at in by_size.items():
                for k in range(0, len(at), max(1, (1 << 22) // max(p, q))):
                    some = at[k : k + max(1, (1 << 22) // max(p, q))]
                    apart[some] = np.bitwise_count(_folded([x[i] for i in some], min(p, q)) ^ _folded([y[i] for i in some], min(p, q))).sum(axis=1, dtype=np.int64)
            least = -(-percent * (n + m) // (100 + percent))
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(apart)], ["a", "b", "apart"])
            yield found.filter(pa.array(apart <= n + m - 2 * least))

    return run


def _allowed(pairs: DataFrame, classes: DataFrame, sketch: str, percent: int) -> DataFrame:
    """The pairs (a, b) of classes, with ``apart``, that these sketches allow to link."""
    x = classes.select(F.col("id").alias("a"), "n", F.col(sketch).alias("x"))
    y = classes.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col(sketch).alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(_sketched(percent), "a long, b long, apart long")


def _similar(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are as similar as asked, from one text of each class."""
    # as a table, so that the plan knows its size: a small one is sent to the texts, which then don't move
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    needed = stage(classes.select("id", "doc", F.col("t").alias("_t")).join(ids, "id"), "needed")
    texts = docs.join(needed, (docs["doc_id"] == needed["doc"]) & (docs["t"] == needed["_t"])).groupBy("id").agg(F.first("text").alias("text"))
    sets = stage(texts.mapInArrow(_set_of(width), "id long, items binary"), "sets")
    x = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    found = stage(pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_similar(percent), "a long, b long"), "similar")
    unstage(sets)
    return found


def _may_link(percent: int):
    """Sizes and places in the prefixes that the similarity allows, for n <= m.

    The shorter set's first n - ceil(2p / (1 + p) n) + 1 shingles and the longer's prefix meet, and
    what can be common behind the places must reach the least overlap.
    """
    short = F.least("n", "m")
    place = F.when(F.col("n") <= F.col("m"), F.col("pos")).otherwise(F.col("pos2"))
    least = F.ceil(F.lit(percent) * (F.col("n") + F.col("m")) / F.lit(100 + percent))
    fits = F.lit(100) * short >= F.lit(percent) * F.greatest("n", "m")
    early = place < short - F.ceil(F.lit(2 * percent) * short / F.lit(100 + percent)) + 1
    return fits & (early | (F.col("n") == F.col("m"))) & (F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("pos2")) + F.least("pos", "pos2") >= least)


def _with_partners(lists: DataFrame, percent: int) -> DataFrame:
    """The rows of lists that sizes and places allow to link with some other row of their list, or that stand for several classes.

    In order of size the nearest rows decide: a longer set needs a row that is early for the shorter one (``_may_link``)."""
    early = F.col("pos") < F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent)) + 1
    by_size = Window.partitionBy("token").orderBy("n", "group")
    shorter = F.last(F.when(early, F.col("n")), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    rows = lists.withColumn("_early", early).withColumn("_next", F.lead("n").over(by_size)).withColumn("_last", F.lag("n").over(by_size)).withColumn("_shorter", shorter)
    near = lambda less, more: F.lit(100) * less >= F.lit(percent) * more
    same = (F.col("_next") == F.col("n")) | (F.col("_last") == F.col("n"))
    some = (F.col("_early") & near(F.col("n"), F.col("_next"))) | near(F.col("_shorter"), F.col("n")) | same
    return rows.filter(F.coalesce(some, F.lit(False)) | (F.col("members") > 1)).drop("_early", "_next", "_last", "_shorter")


GROUP = ["token", "kind", "bi", "bj"]


def _across(percent: int):
    """Rows of the block pairs of lists, in order, to pairs (a, b) of different components that sizes,
    places and sketches allow to link. Pairs are tried as matrices and only what is left is written."""

    def pairs(rows):
        kind, bi, bj = (rows[k][0] for k in ("kind", "bi", "bj"))
        blk, main = np.array(rows["blk"]), np.array(rows["main"])
        ids, n, pos, comp = (np.array(rows[k], dtype=np.int64) for k in ("id", "n", "pos", "component"))
        bits = np.unpackbits(np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8)).reshape(len(ids), BITS).astype(np.float32) * 2 - 1
        if kind == 0:
            x, y = np.flatnonzero(main), np.flatnonzero(~main)
        elif bi == bj:
            x = y = np.arange(len(ids))
        else:
            x, y = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
        if not len(x) or not len(y):
            return ids[:0], ids[:0]
        nx, ny, px, py = n[x][:, None], n[y][None, :], pos[x][:, None], pos[y][None, :]
        short = np.minimum(nx, ny)
        place = np.where(nx <= ny, px, py)
        least = -(-percent * (nx + ny) // (100 + percent))
        fits = (100 * short >= percent * np.maximum(nx, ny)) & (comp[x][:, None] != comp[y][None, :])
        fits &= (place < short + (-2 * percent * short) // (100 + percent) + 1) | (nx == ny)
        fits &= np.minimum(nx - px, ny - py) + np.minimum(px, py) >= least
        fits &= (BITS - bits[x] @ bits[y].T) / 2 <= nx + ny - 2 * least
        if kind == 1 and bi == bj:
            fits &= np.tri(len(ids), k=-1, dtype=bool)
        i, j = np.nonzero(fits)
        i, j = ids[x[i]], ids[y[j]]
        return np.minimum(i, j), np.maximum(i, j)

    def run(batches):
        names = [*GROUP, "blk", "main", "id", "n", "pos", "component", "sketch"]
        held, last, out = {}, None, ([], [])

        def close():
            if held and len(held["id"]) > 1:
                for o, v in zip(out, pairs(held)):
                    o.append(v)

        def written():
            found = pa.RecordBatch.from_arrays([pa.array(np.concatenate([*o, np.zeros(0, dtype=np.int64)])) for o in out], ["a", "b"])
            for o in out:
                o.clear()
            return found

        for batch in batches:
            columns = [batch.column(batch.schema.names.index(k)).to_pylist() for k in names]
            marks = list(zip(*columns[:4]))
            start = 0
            for k in range(1, len(marks) + 1):
                if k == len(marks) or marks[k] != marks[start]:
                    if marks[start] != last:
                        close()
                        held, last = {c: [] for c in names}, marks[start]
                    for c, v in zip(names, columns):
                        held[c] += v[start:k]
                    start = k
            yield written()
        close()
        yield written()

    return run


def _blocks_of(lists: DataFrame) -> DataFrame:
    """The rows of lists with several components, dealt out as pairs of blocks: those of a list's main
    component against all others, and the others against each other."""
    parts = lists.groupBy("token", "component").agg(F.count("*").alias("k"))
    several = parts.groupBy("token").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("k", "component")).alias("first"), F.max("k").alias("most"), F.sum("k").alias("total")).filter("parts > 1")
    blocks = lambda x: F.ceil(x / BLOCK).cast("int")
    several = several.select("token", "first", blocks(F.col("most")).alias("nm"), blocks(F.col("total") - F.col("most")).alias("ns"))
    rows = lists.join(several, "token").withColumn("main", F.col("component") == F.col("first"))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("nm")).otherwise(F.col("ns"))).cast("int"))
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("bi"), j.alias("bj"))
    others = F.sequence(F.lit(0), F.col("ns") - 1)
    mine = F.transform(others, lambda j: pair(0, F.col("blk"), j))
    with_main = F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda i: pair(0, i, F.col("blk")))
    with_others = F.transform(others, lambda j: pair(1, F.least("blk", j), F.greatest("blk", j)))
    rows = rows.withColumn("pair", F.explode(F.when(F.col("main"), mine).otherwise(F.concat(with_main, with_others))))
    return rows.select("token", "pair.kind", "pair.bi", "pair.bj", "blk", "main", "id", "n", "pos", "component", "sketch")


def _still_apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components, with these as x and y."""
    of = lambda end, name: joined.select(F.col("node").alias(end), F.col("component").alias(name))
    rows = pairs.select("a", "b", "apart").join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
    rows = rows.withColumn("x", F.coalesce("x", "a")).withColumn("y", F.coalesce("y", "b")).filter("x <> y")
    return stage(rows.select("a", "b", "apart", "x", "y"), "left")


def _joining(docs: DataFrame, classes: DataFrame, pairs: DataFrame, links: DataFrame, joined: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``links`` and, of the pairs that sketches allow, enough verified ones that no pair that links is
    left between two components; and the components of all: first each component's nearest pair is
    verified, then all pairs that are still apart."""
    left = _still_apart(pairs, joined)
    ends = left.select("x", "apart", "a", "b").unionByName(left.select(F.col("y").alias("x"), "apart", "a", "b"))
    near = ends.groupBy("x").agg(F.min(F.struct("apart", "a", "b")).alias("_near")).select("_near.a", "_near.b").distinct()
    near = stage(near, "nearest")
    for some in (near, None):
        some = some if some is not None else _still_apart(left.join(near, ["a", "b"], "left_anti"), joined)
        if some.isEmpty():
            break
        links = stage(links.unionByName(_verified(docs, classes, some, width, percent)), "links")
        joined = stage(components(links), "joined")
    return links, joined


def near_texts(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents with one shingle set are one class. Shingles are ordered by how often they occur in all
    documents; a class's prefix is so many of its rarest that classes which link have one in common.
    Classes with the same prefix and size form a group. Every group is paired with the first three, by
    a hash, of each shingle's list, and a group's members with their first; sizes, places and parity
    sketches rule out what can't link, the rest is verified on whole sets and linked. This tries all
    pairs of a list of up to four classes. Then, so that no link is missed, whatever a longer list
    still has in different components is compared in blocks in the same way. A list whose members are
    linked already costs no pairs, and of two components only the nearest pair is verified unless that
    fails. Components of both rounds' links are the result.

    A null text is empty. Documents without words have no shingles and are components of their own.
    A null doc_id links with nothing and has a null component. Rows with shingles that repeat a doc_id
    share its component and are linked by each of their texts. A very long text is one set like any
    other; batches are cut by size. An empty table gives an empty result. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    counts = np.zeros(COUNTERS, dtype=np.int64)
    # COUNTERS rows at most
    for row in docs.select("text").mapInArrow(_count(width), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect():
        counts[row["counter"]] = row["n"]
    signed = docs.mapInArrow(_sign(width, percent, counts.astype("<i8").tobytes()), "doc_id long, t long, n long, digest binary, prefix binary, sketch binary, wide binary")
    signed = stage(signed, "signed")

    several = signed.filter("digest is not null and doc_id is not null")
    classes = several.groupBy("digest").agg(F.min(F.struct("doc_id", "t")).alias("_first"), *[F.first(c).alias(c) for c in ("n", "prefix", "sketch", "wide")])
    classes = classes.select(F.monotonically_increasing_id().alias("id"), F.col("_first.doc_id").alias("doc"), F.col("_first.t").alias("t"), "digest", "n", "prefix", "sketch", "wide")
    classes = stage(classes, "classes")
    groups = stage(classes.groupBy("n", "prefix").agg(F.min("id").alias("group"), F.count("*").alias("members")), "groups")
    members = classes.join(groups.filter("members > 1").select("n", "prefix", "group"), ["n", "prefix"]).select("group", "id")
    members = stage(members, "members")

    # classes of one doc_id, which rows that repeat it with another text have
    twice = several.groupBy("doc_id").agg(F.min("digest").alias("_low"), F.max("digest").alias("_high")).filter("_low <> _high").select("doc_id")
    own = several.select("doc_id", "digest").join(twice, "doc_id", "left_semi").join(classes.select("digest", "id"), "digest").select("doc_id", "id").distinct()
    own = stage(own, "own")
    twins = own.join(own.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").select(F.col("id").alias("a"), "b").filter("a <> b")

    # shingles that several classes have in their prefixes, by group; counted as the rows pass, which are made and dealt once
    postings = groups.mapInArrow(_tokens, "token long, pos int, n long, group long, members long")
    of_token = Window.partitionBy("token")
    postings = postings.withColumn("k", F.sum("members").over(of_token)).filter("k > 1").withColumn("g", F.count("*").over(of_token))
    # in a list that isn't long, every class meets every other through the first ones
    postings = stage(postings.select("token", "pos", "n", "group", "members", ((F.col("k") > F.col("g")) | (F.col("g") > FIRSTS + 1)).alias("long")), "postings")
    unstage(groups)

    by_hash = Window.partitionBy("token").orderBy(F.xxhash64("group"), "group")
    firsts = postings.select("token", F.col("group").alias("group2"), F.col("n").alias("m"), F.col("pos").alias("pos2"), F.row_number().over(by_hash).alias("k"))
    firsts = firsts.filter(F.col("k") <= FIRSTS).drop("k")
    pairs = postings.join(firsts, "token").filter("group <> group2").filter(_may_link(percent)).select(F.least("group", "group2").alias("a"), F.greatest("group", "group2").alias("b"))
    inside = members.filter("id <> group").select(F.col("group").alias("a"), F.col("id").alias("b"))
    tried = stage(pairs.unionByName(inside).distinct(), "tried")
    pairs = stage(_allowed(tried, classes, "sketch", percent), "pairs")
    pairs = stage(_allowed(pairs, classes, "wide", percent), "pairs")
    twins = stage(twins, "twins")
    links, joined = _joining(docs, classes, pairs, twins, stage(components(twins), "joined"), width, percent)

    placed = classes.select("id", "sketch").join(joined, F.col("id") == F.col("node"), "left")
    placed = stage(placed.select("id", "sketch", F.coalesce("component", "id").alias("component")), "placed")
    postings = _with_partners(postings.filter("long"), percent)
    expanded = postings.filter("members = 1").withColumn("id", F.col("group")).unionByName(postings.filter("members > 1").join(members, "group"))
    lists = stage(expanded.select("token", "pos", "n", "id").join(placed, "id"), "lists")
    dealt = _blocks_of(lists).repartition(*GROUP).sortWithinPartitions(*GROUP)
    pairs2 = dealt.mapInArrow(_across(percent), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
    pairs2 = stage(_allowed(stage(pairs2, "pairs"), classes, "wide", percent), "pairs")
    _, joined = _joining(docs, classes, pairs2, links, joined, width, percent)

    answer = classes.join(joined, F.col("id") == F.col("node"), "left").select("digest", "doc", F.coalesce("component", "id").alias("root"))
    answer = stage(answer, "answer")
    roots = answer.groupBy("root").agg(F.min("doc").alias("component"))
    answer = answer.join(roots, "root").select("digest", "component")
    return signed.select("doc_id", "n", "digest").join(answer, "digest", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that are the first of their component, with all their columns."""
    firsts = near_texts(docs, **options).filter("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(firsts, docs["doc_id"].eqNullSafe(firsts["_id"]), "left_semi")
