"""Ranked lexical search over inverted treaps: one treap per term and segment, by doc_id and by impact."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import stage

#: Bytes to what the words are split by: A-Z lower-cased, all but ASCII letters, digits and bytes above ASCII blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEGMENT_DOCS, SEGMENT_TERMS = 8192, 4_000_000
#: Terms of items that may ride along with the tasks, in bytes; beyond it all terms are indexed and joined.
RIDE = 8 << 20
ITEMS, SALTS = 256, 32
CHUNK = 150_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _postings(wanted):
    """(doc_id, text) to segments of the index: a row without term for the documents (ids, lengths), and a
    row per term with the places of its documents in the segment, ascending by doc_id, and its counts."""

    def segment(name: int, ids: list, lengths: list, post: dict):
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        rank = np.empty(len(ids), dtype=np.int32)
        rank[order] = np.arange(len(ids), dtype=np.int32)
        rows: list[list] = [[None], [np.array(lengths, dtype="<i4")[order].tobytes()], [b""], [[ids[k] for k in order]]]
        for term, (docs, counts) in post.items():
            at = rank[docs]
            by = np.argsort(at)
            for column, value in zip(rows, (term, at[by].astype("<i4").tobytes(), np.array(counts, dtype="<i4")[by].tobytes(), None)):
                column.append(value)
        kinds = pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())
        made = pa.RecordBatch.from_arrays(
            [pa.array([name] * len(rows[0]), pa.int64()), *(pa.array(x, k) for x, k in zip(rows, kinds))], ["segment", "term", "docs", "counts", "ids"]
        )
        for k in range(0, made.num_rows, 5000):
            yield made.slice(k, 5000)

    def run(batches):
        kept = wanted.value if wanted is not None else None
        name = TaskContext.get().partitionId() << 32
        ids, lengths, post, size = [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = terms_of(text or b"")
                for term, count in Counter(terms if kept is None else filter(kept.__contains__, terms)).items():
                    if (held := post.get(term)) is None:
                        held = post[term] = ([], [])
                    held[0].append(len(ids))
                    held[1].append(count)
                ids.append(doc_id)
                lengths.append(len(terms))
                size += len(terms)
                if len(ids) >= SEGMENT_DOCS or size >= SEGMENT_TERMS:
                    yield from segment(name, ids, lengths, post)
                    name, ids, lengths, post, size = name + 1, [], [], {}, 0
        if ids:
            yield from segment(name, ids, lengths, post)

    return run


def _item_terms(batches):
    for batch in batches:
        found = [sorted(set(terms_of(t or b""))) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], ["item", "item_id", "terms"])


def treaps(term: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left child, right child and root by term of the treaps over runs of equal ``term``.

    Positions are the search order, impacts the heap order, the earlier of equal ones above. A node hangs
    below the smaller of the nearest greater ones on its two sides; these are found for all nodes at once,
    each skipping what the ones it has passed have skipped."""
    n = len(term)
    at = np.arange(n)

    def nearest(step: int, over) -> np.ndarray:
        near = at + step
        todo = at
        while len(todo):
            to = near[todo]
            inside = (to >= 0) & (to < n)
            todo, to = todo[inside], to[inside]
            other = term[to] != term[todo]
            near[todo[other]] = -1 if step < 0 else n
            passed = ~other & over(impact[to], impact[todo])
            todo, to = todo[passed], to[passed]
            near[todo] = near[to]
        return near

    before = nearest(-1, np.less)  # an equal one before stands above
    after = nearest(1, np.less_equal)
    has_before, has_after = before >= 0, after < n
    below_before = has_before & (~has_after | (impact[np.minimum(after, n - 1)] > impact[np.maximum(before, 0)]))
    below_after = has_after & ~below_before
    left, right = np.full(n, -1), np.full(n, -1)
    right[before[below_before]] = at[below_before]
    left[after[below_after]] = at[below_after]
    return left, right, np.flatnonzero(~has_before & ~has_after)


def _only(open_, query, low, high, level, node, of):
    """The intervals that ``open_`` marks, with their subtrees; ``of`` numbers the intervals anew."""
    stays = open_[of]
    return query[open_], low[open_], high[open_], level[open_], node[stays], (np.cumsum(open_) - 1)[of[stays]]


def _both(a, b):
    """The intervals of both."""
    return *(np.concatenate(x) for x in zip(a[:5], b[:5])), np.concatenate([a[5], b[5] + len(a[0])])


class Segment:
    """The treaps of a segment's terms, and the traversal of several terms' treaps at a time."""

    def __init__(self, docs: list[np.ndarray], counts: list[np.ndarray], weights: list[int], floors: np.ndarray, size: int):
        """By term: places of documents, counts, weight. By document: 8 times its length term."""
        self.term = np.repeat(np.arange(len(docs)), [len(x) for x in docs])
        self.doc = np.concatenate(docs).astype(np.int64) if docs else np.empty(0, np.int64)
        count = np.concatenate(counts).astype(np.int64) if docs else np.empty(0, np.int64)
        self.impact = np.asarray(weights, dtype=np.int64)[self.term] * ((1_000_000_000 * count) // (1000 * count + floors[self.doc]))
        self.size = size
        self.keys = self.term * size + self.doc
        self.left, self.right, self.roots = treaps(self.term, self.impact)

    def inside(self, node, low, high):
        """The root of each node's treap within the open interval (low, high) of places, or -1."""
        node = node.copy()
        todo = np.arange(len(node))
        while len(todo):
            v = node[todo]
            doc = self.doc[v]
            right, left = doc <= low[todo], doc >= high[todo]
            off = right | left
            todo = todo[off]
            v = np.where(right[off], self.right[v[off]], self.left[v[off]])
            node[todo] = v
            todo = todo[v >= 0]
        return node

    def top(self, queries: list[np.ndarray], k: int, least: np.ndarray, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of each query's k highest scores, equal ones by ascending place; fewer if
        the rest scores below ``least`` or not above 0. With ``rounds`` only so many levels are visited,
        so the scores are true but need not be the highest.

        An interval of documents is a set of subtrees, one for each term that occurs there. Their roots'
        impacts add up to a bound on all its documents. If the bound falls below what the k-th best has,
        the subtrees are left; else the document of the largest root is scored and splits the interval."""
        floor = np.maximum(least, 1).astype(np.float64)
        best = [np.empty(0, np.int64) for _ in range(3)]
        root = np.concatenate([self.roots[q] for q in queries]) if queries else np.empty(0, np.int64)
        of = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
        some, of = np.unique(of, return_inverse=True)
        stack = [(some, np.full(len(some), -1), np.full(len(some), self.size), np.zeros(len(some), np.int64), root, of)]
        while stack:
            part = stack.pop()
            while stack and len(part[4]) + len(stack[-1][4]) <= CHUNK:
                part = _both(stack.pop(), part)
            bound = np.bincount(part[5], self.impact[part[4]], len(part[0]))
            query, low, high, level, node, of = _only(bound >= floor[part[0]], *part)
            if len(node) > CHUNK and len(query) > 1:  # the promising half first, so that the floors rise
                high_half = np.zeros(len(query), dtype=bool)
                high_half[np.argsort(-bound[bound >= floor[part[0]]], kind="stable")[: len(query) // 2]] = True
                stack += [_only(~high_half, query, low, high, level, node, of), _only(high_half, query, low, high, level, node, of)]
                continue
            if not len(query):
                continue
            starts = np.searchsorted(of, np.arange(len(query)))
            own = self.impact[node]
            largest = np.flatnonzero(own == np.maximum.reduceat(own, starts)[of])
            pivot = self.doc[node[largest[np.searchsorted(of[largest], np.arange(len(query)))]]]
            want = self.term[node] * self.size + pivot[of]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            score = np.bincount(of, np.where(self.keys[at] == want, self.impact[at], 0), len(query)).astype(np.int64)
            best = self._best(best, (query, pivot, score), k, floor)
            halves = []
            for a, b in ((low, pivot), (pivot, high)):
                child = self.inside(node, a[of], b[of])
                there = child >= 0
                child, whose = child[there], of[there]
                bound = np.bincount(whose, self.impact[child], len(query))
                open_ = (bound >= floor[query]) & (bound > 0)
                if rounds is not None:
                    open_ &= level + 1 < rounds
                halves.append(_only(open_, query, a, b, level + 1, child, whose))
            stack.append(_both(*halves))
        return best[0], best[1], best[2]

    @staticmethod
    def _best(best, found, k, floor):
        query, doc, score = (np.concatenate(x) for x in zip(best, found))
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        stays = (nth < k) & (score > 0)
        last = nth == k - 1
        floor[query[last]] = np.maximum(floor[query[last]], score[last])
        return query[stays], doc[stays], score[stays]


def _searched(n_docs: int, n_terms: int, k: int, rounds: int | None, id_type: pa.DataType):
    """A segment's rows, of which the head carries a block of items, to (item, item_id, doc_id, score)."""
    schema = pa.schema([("item", pa.int64()), ("item_id", id_type), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(segment: pa.Table) -> pa.Table:
        ids, floors, items, docs, counts, weights, number = None, None, [], [], [], [], {}
        for k_, (term, raw, count, weight) in enumerate(zip(*(segment.column(c).to_pylist() for c in ("term", "docs", "counts", "weight")))):
            if term is None:
                lengths = np.frombuffer(raw, "<i4").astype(object if 90 * n_docs > 2**31 else np.int64)
                floors = (8 * (10 + (90 * lengths * n_docs) // max(n_terms, 1))).astype(np.int64)
                ids, items = segment.column("ids")[k_].values, segment.column("items")[k_].as_py()
            else:
                number[term] = len(docs)
                docs.append(np.frombuffer(raw, "<i4"))
                counts.append(np.frombuffer(count, "<i4"))
                weights.append(weight)
        if not docs or not items:
            return schema.empty_table()
        queries = [np.array([number[t] for t in x["terms"] if t in number], dtype=np.int64) for x in items]
        query, place, score = Segment(docs, counts, weights, floors, len(ids)).top(queries, k, np.array([x["least"] for x in items]), rounds)
        return pa.table(
            [pa.array([items[q]["item"] for q in query], pa.int64()), pa.array([items[q]["item_id"] for q in query], id_type), ids.take(pa.array(place)), pa.array(score)], schema=schema
        )

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, first_rounds: int = 4) -> DataFrame:
    """Each item's k highest-scoring documents: item_id, rank (from 1), doc_id, score; equal scores by ascending doc_id.

    ``docs``: doc_id, text. ``items``: item_id, text. Documents are indexed in segments of SEGMENT_DOCS
    documents or SEGMENT_TERMS words; each holds a treap per term that items ask for. A block of ITEMS items
    meets each segment once for a first look (``first_rounds`` levels of the treaps), from which the k-th
    best score of all segments becomes the floor of the whole traversal.

    A null or empty text has no terms: such an item has no rows, such a document is never found and does not
    count in N. Each row of ``items`` is an item and each row of ``docs`` a document, also where rows repeat an
    id or a text. A null doc_id comes after all others of its score. Terms are as long as they are, and
    one document may fill a segment. Empty tables give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    asked = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("binary"))
    id_type = items.schema["item_id"].dataType.simpleString()
    asked = stage(asked.mapInArrow(_item_terms, f"item long, item_id {id_type}, terms array<binary>"), "items")
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    n_items, size = asked.count(), terms.agg(F.coalesce(F.sum(F.length("term") + 40), F.lit(0))).first()[0]
    wanted = spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in terms.toLocalIterator())) if size <= RIDE else None
    index = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(_postings(wanted), "segment long, term binary, docs binary, counts binary, ids array<long>")
    index = stage(index, "index")
    heads = index.filter("term is null").drop("term")
    n_docs, n_terms = _sizes(index)
    df = F.sum(F.length("docs") / 4).cast("long")
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = index.filter("term is not null").groupBy("term").agg(df.alias("df")).select("term", weight.alias("weight")).filter("weight > 0")
    blocks = max(1, -(-n_items // ITEMS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    in_block = asked.select("block", F.explode("terms").alias("term")).distinct().join(weights, "term")
    posts = index.drop("ids").join(in_block, "term")
    heads = heads.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("salt", F.pmod("segment", F.lit(SALTS)))

    def look(least: DataFrame | None, rounds: int | None) -> DataFrame:
        floors = asked.withColumn("least", F.lit(1).cast("long")) if least is None else asked.join(least, "item", "left").fillna(1, ["least"])
        grouped = floors.groupBy("block").agg(F.collect_list(F.struct("item", "item_id", "least", "terms")).alias("items"))  # about ITEMS each
        grouped = grouped.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = heads.join(grouped, ["block", "salt"]).drop("salt").unionByName(posts, allowMissingColumns=True)
        find = _searched(n_docs, n_terms, k, rounds, to_arrow_type(items.schema["item_id"].dataType))
        return rows.groupBy("segment", "block").applyInArrow(find, f"item long, item_id {id_type}, doc_id long, score long")

    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    least = look(None, first_rounds).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    least = stage(least.filter(F.col("rank") == k).select("item", F.col("score").alias("least")), "floors")
    found = stage(look(least, None), "found")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _sizes(index: DataFrame) -> tuple[int, int]:
    """Documents with a term and terms of all, summed over the segments' heads."""

    def summed(batches):
        for batch in batches:
            lengths = [np.frombuffer(x, "<i4") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int((x > 0).sum()) for x in lengths], pa.int64()), pa.array([int(x.sum()) for x in lengths], pa.int64())], ["n", "l"])

    row = index.filter("term is null").select("docs").mapInArrow(summed, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0
