"""Ranked search, whitening and exact top-k against brute force, and their answers to odd input."""

import collections
import math
import random

import numpy as np
import pytest

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import impact_search, treap_search, whitening


def brute_ranked(docs, items, k=10):
    counted = [(i, collections.Counter(treap_search.terms_of((t or "").encode()))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for nth, (doc_id, c) in enumerate(counted):
            m = 10 + (90 * sum(c.values()) * n_docs) // max(n_terms, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(treap_search.terms_of((text or "").encode())) if t in c
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, nth))
        out += [(item_id, r + 1, None if none else d, -s) for r, (s, none, d, _) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def some_docs(n=400):
    rng = random.Random(5)
    draw = lambda n, v: " ".join(f"W{int(rng.paretovariate(0.7)) % v}" for _ in range(n))
    docs = [(i, draw(rng.randrange(1, 80), 300)) for i in range(n)]
    passage = draw(25, 300)
    docs += [(1000 + i, f"{draw(9, 300)}\n{passage.upper()}-{draw(5, 300)}") for i in range(30)]
    docs += [(2000 + i, "the same w1 w2 again") for i in range(150)]  # many equal scores
    docs += [(1, "w1 w5"), (1, "w1 w5"), (None, "w5 w6 w7"), (None, None), (7, None), (8, ""), (9, " .,;"), (3000, "é É ñ w5"), (3001, draw(30_000, 300))]
    items = [(1, passage), (2, "w1 W2 w1"), (3, draw(40, 300)), (4, "É"), (5, None), (6, "unheard of"), (6, "w5"), (None, "w7"), (2, "w1 W2 w1"), (8, "same again")]
    return docs, items


def ranked(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, term int, segment int, score int").repartition(3)
    i = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, item int, block int")
    return sorted((tuple(r) for r in treap_search.search(d, i, **more).collect()), key=str)


def test_ranked_search_matches_brute_force(spark, monkeypatch):
    docs, items = some_docs()
    want = brute_ranked(docs, items)
    assert ranked(spark, docs, items) == want
    monkeypatch.setattr(treap_search, "RIDE", 0)  # all terms are indexed and joined
    monkeypatch.setattr(treap_search, "ITEMS", 3)  # several blocks of items
    assert ranked(spark, docs, items, first_rounds=1) == want


def test_ranked_search_of_empty_tables(spark):
    docs, items = some_docs(5)
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == [] and ranked(spark, [(1, None)], items) == []


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(2)
    term = np.sort(rng.integers(0, 9, 400))
    impact = rng.integers(0, 12, 400)
    left, right, roots = treap_search.treaps(term, impact)
    assert term[roots].tolist() == sorted(set(term.tolist()))
    for child, side in ((left, -1), (right, 1)):
        up = np.flatnonzero(child >= 0)
        assert (term[child[up]] == term[up]).all() and ((child[up] - up) * side > 0).all() and (impact[child[up]] <= impact[up]).all()

    def walk(v):
        return [*walk(left[v]), v, *walk(right[v])] if v >= 0 else []

    assert [v for r in roots for v in walk(r)] == list(range(400))


def test_traversal_in_small_chunks(monkeypatch):
    """Chunks that are split and put together again lose no document."""
    monkeypatch.setattr(treap_search, "CHUNK", 40)
    rng = np.random.default_rng(3)
    docs = [np.sort(rng.choice(300, rng.integers(1, 200), replace=False)).astype(np.int32) for _ in range(30)]
    counts = [rng.integers(1, 5, len(x)) for x in docs]
    segment = treap_search.Segment(docs, counts, rng.integers(1, 9000, 30).tolist(), rng.integers(80, 900, 300), 300)
    queries = [rng.choice(30, rng.integers(1, 25), replace=False) for _ in range(20)] + [np.empty(0, np.int64)]
    query, place, score = segment.top(queries, 5, np.ones(21))
    for q, terms in enumerate(queries):
        total = np.zeros(300, np.int64)
        for t in terms:
            at = segment.term == t
            total[segment.doc[at]] += segment.impact[at]
        want = [(int(total[d]), int(d)) for d in np.lexsort((np.arange(300), -total))[:5] if total[d] > 0]
        assert [(int(s), int(d)) for s, d in zip(score[query == q], place[query == q])] == want


VECTORS = "vec_id long, embedding array<float>, label int, x int, raw int, digest int, n int, row int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 1, 1, 1, 1, 1, 1) for i, v in rows], VECTORS).repartition(3)


def some_vectors(n=500, dim=12):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(n, dim)).astype(np.float32)
    rows = [(i, base[i].tolist()) for i in range(n)]
    rows += [(1000 + i, base[0].tolist()) for i in range(250)]  # a third are equal
    rows += [(50, base[3].tolist()), (50, base[3].tolist()), (100, (base[4] * 40).tolist()), (150, [0.0] * dim)]
    odd = [(5000, None), (5050, [float("nan")] * dim), (5100, [None] + [1.0] * (dim - 1)), (5150, [float("inf")] * dim), (5200, [])]
    return rows, odd


def brute_top(rows, every=50, k=5):
    x = [(i, [math.floor(256 * float(np.float32(e))) for e in v]) for i, v in rows]
    out = []
    for a, (query_id, q) in enumerate(x):
        if query_id is not None and query_id % every == 0:
            scores = sorted((-max(min(sum(s * t for s, t in zip(q, v)), 2**63 - 1), -(2**63)), i) for b, (i, v) in enumerate(x) if a != b and len(v) == len(q) and i is not None)
            out += [(query_id, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found_top(spark, rows):
    return sorted(tuple(r) for r in impact_search.search(vectors(spark, rows)).collect())


def test_top_k_matches_brute_force(spark, monkeypatch):
    rows, odd = some_vectors()
    assert found_top(spark, rows + odd) == brute_top(rows)
    monkeypatch.setattr(impact_search, "SHARD", (64, 64))
    monkeypatch.setattr(impact_search, "BLOCK", 3)
    assert found_top(spark, rows) == brute_top(rows)


def test_top_k_of_odd_tables(spark):
    rng = np.random.default_rng(1)
    huge = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 16)).astype(np.float32).tolist()) for i in range(0, 300, 10)]
    mixed = huge + [(i, [1.0, 2.0]) for i in (50, 51, 52)] + [(None, [1.0, 2.0]), (350, [3.0])]
    assert found_top(spark, mixed) == brute_top(mixed)
    assert found_top(spark, []) == [] and found_top(spark, [(50, [1.0])]) == []
    assert found_top(spark, [(50, [1.0]), (50, [1.0])]) == [(50, 1, 50, 65536)] * 2


def test_impact_index_stops_before_its_end():
    """Vectors that stand out are found without reading all segments, and none that could beat them is lost."""
    rng = np.random.default_rng(4)
    entries = rng.integers(-90, 90, (600, 16)).astype(np.int64)
    queries = entries[:20] + rng.integers(-4, 5, (20, 16))
    index = impact_search.ImpactIndex(entries)
    for query, (rows, products) in zip(queries, index.top(queries, 3)):
        exact = entries @ query
        assert sorted(products.tolist(), reverse=True)[:3] == sorted(exact.tolist(), reverse=True)[:3]
        assert set(np.flatnonzero(exact >= np.sort(exact)[-3]).tolist()) == set(rows.tolist())


def test_residues_give_exact_integers():
    moduli = whitening.primes(10**30)
    assert all(all(p % d for d in range(2, 1500)) for p in moduli) and math.prod(moduli) > 2 * 10**30
    values = np.array([[0, -1, 10**30], [-(10**30), 7, 123456789012345678901234567890]], dtype=object)
    back = whitening.reconstruct([np.array([[int(v) % p for v in row] for row in values.tolist()], dtype=np.int64) for p in moduli], moduli)
    assert (back == values).all()


def test_whitening_matches_brute_force(spark):
    rows, odd = some_vectors()
    got = whitening.whiten(vectors(spark, rows + odd + [(6000, [1.0, 2.0])]), components=8).collect()
    x = np.array([[math.floor(64 * e) + 1_000_000 for e in v] for _, v in rows], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, centred = len(fit), fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    want = ((x - fit.mean(axis=0)) @ axes[:, :8]) / np.sqrt(values[:8])
    whole = n * x.astype(object) - fit.astype(object).sum(axis=0)
    assert len(got) == 8 * len(rows) and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    held = collections.defaultdict(list)
    for (i, _), w, d in zip(rows, want, (whole * whole).sum(axis=1)):
        held[i].append((np.abs(w), int(d)))
    by_row = collections.defaultdict(dict)
    for r in got:
        by_row[r["vec_id"]].setdefault(r["component"], []).append((abs(r["whitened"]), r["deviation"]))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-6)
    for i, rows_of in held.items():
        for c in range(1, 9):
            for (w, d), (a, b) in zip(sorted((w[c - 1], d) for w, d in rows_of), sorted(by_row[i][c])):
                assert w == pytest.approx(a, abs=1e-8) and d == b


def test_whitening_is_exact_where_doubles_are_not(spark):
    """Entries of 10^15 with a spread of a few units: a plain scatter in doubles would lose them."""
    rng = np.random.default_rng(6)
    small = rng.integers(-20, 20, (300, 4))
    frame = spark.createDataFrame([(i, [float(2**44 + int(e)) for e in v]) for i, v in enumerate(small)], "vec_id long, embedding array<double>")
    got = whitening.whiten(frame).collect()
    fit = np.unique(small * 64, axis=0)
    values = np.linalg.eigvalsh(np.cov(fit.T, bias=True))[::-1]
    assert sorted({round(r["explained"], 9) for r in got}, reverse=True) == [round(v, 9) for v in values / values.sum()]
    assert max(r["identity_error"] for r in got) < 1e-9


def test_whitening_of_odd_tables(spark):
    rows = lambda *values: whitening.whiten(vectors(spark, values)).collect()
    assert rows() == [] and rows((1, None)) == [] and rows((1, [1.0, 2.0]), (2, [1.0, 2.0])) == []
    flat = rows((1, [1.0, 5.0]), (2, [2.0, 5.0]), (None, [2.0, 5.0]), (3, [9.0]))
    assert sorted((str(r["vec_id"]), r["component"], r["n"], round(abs(r["whitened"]), 9)) for r in flat) == [("1", 1, 2, 1.0), ("2", 1, 2, 1.0), ("None", 1, 2, 1.0)]
    far = rows((1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.0]))
    assert {r["deviation"] for r in far if r["vec_id"] != 3} == {None}
