"""The training-data operators against brute force, and their answers to odd input."""

import collections
import random
import re
import zlib
from hashlib import sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import embedding_dedup, jaccard_join, language_id, packing, queries, quotations, repeats, shared, token_files, toxicity
from ledgerloom.llm.embedding_dedup import near_vectors
from ledgerloom.llm.exact_dedup import DigestIndex
from ledgerloom.llm.graph import components
from ledgerloom.llm.jaccard_join import near_texts
from ledgerloom.llm.mixing import mix_plan, mixed
from ledgerloom.llm.queries import tokenizer_file
from ledgerloom.llm.quotations import formatted, link_quotations

DOCS = "doc_id long, text string, lang string, source string, digest int, k1 int, anchor int, component int, n int, id int"


def documents(spark, texts, ids=None):
    """Documents with columns whose names the operators use inside."""
    rows = [(i, t, "en", f"s{k % 2}", 1, 1, 1, 1, 1, 1) for k, (i, t) in enumerate(zip(ids if ids is not None else range(len(texts)), texts))]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", " ", "a", "A b", "a B", "é" * 70, "x" * 300, "x" * 120]
    shared = words(rng, 30)
    base = words(rng, 120)
    for k in range(40):
        out.append(words(rng, rng.randrange(1, 90)) + (" " + shared if k % 3 == 0 else "") + "\n" + words(rng, 5))
        near = base.split()
        for _ in range(rng.randrange(0, 4)):
            near[rng.randrange(len(near))] = f"v{rng.randrange(9999)}"
        out.append(" ".join(near))
        if k % 5 == 0:
            out.append(out[-1].upper() if k % 2 else out[-1])
    out.append(words(rng, 6000))
    return out


def brute_repeats(rows):
    seen: dict[bytes, int] = {}
    for i, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - 49):
            w = data[p : p + 50]
            seen[w] = min(seen.get(w, i), i)
    out = {}
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - 49):
            if seen[data[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha256(kept).hexdigest())
    return out


def test_repeats_match_brute_force(spark, texts):
    got = repeats.remove_repeats(documents(spark, texts)).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in got} == brute_repeats(list(enumerate(texts)))


def test_repeats_of_hot_anchors(spark, texts, monkeypatch):
    rng = random.Random(4)
    passage = words(rng, 12)
    many = [f"{words(rng, 9)} {passage} {words(rng, 9)}" for _ in range(60)]
    want = brute_repeats(list(enumerate(many)))
    for hot in (20_000, 5):
        monkeypatch.setattr(repeats, "HOT", hot)
        got = repeats.remove_repeats(documents(spark, many)).collect()
        assert {r.doc_id: tuple(r)[1:5] for r in got} == want


def test_pieces_that_share_only_an_anchor_leave_the_sort(monkeypatch):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    word, passage = letters(30), letters(90)
    sorted_pieces = []

    def found(texts):
        rows = list(zip(*(x.tolist() for x in repeats.pieces([t.encode() for t in texts])[:3])))
        asks = [[{"begin": begin, "size": size} for doc, begin, size in rows if doc == k] for k in range(len(texts))]
        batch = pa.RecordBatch.from_pydict({"doc": list(range(len(texts))), "t": [0] * len(texts), "text": texts, "asks": asks})
        cut = pa.Table.from_batches(repeats._cut([batch])).sort_by("anchor").combine_chunks()
        return [r for b in repeats._sorted_suffixes(cut.to_batches(max_chunksize=100)) for r in b.to_pylist()]

    real = repeats.repeated
    monkeypatch.setattr(repeats, "repeated", lambda anchors, docs, texts: sorted_pieces.append(len(texts)) or real(anchors, docs, texts))
    assert found([letters(200) + word + letters(200) for _ in range(40)]) == [] and sum(sorted_pieces) == 0
    # what is there in full is found: all of the passage in the later documents, and no more than letters beside it that agree
    told = found([letters(200) + passage + letters(200) for _ in range(3)])
    covered = {k: {x for r in told if r["doc"] == k for x in range(r["begin"], r["begin"] + r["size"])} for k in range(3)}
    assert not covered[0] and all(set(range(200, 290)) <= covered[k] and len(covered[k]) < 96 for k in (1, 2)) and sum(sorted_pieces) > 0


@pytest.mark.parametrize("width", [1, 4, 16, 31])
def test_parts_of_pieces_hold_each_string_once(width):
    rng = random.Random(width)
    data = bytes(rng.choice(b"ab") for _ in range(3000)) + bytes(rng.choice(b"abcdefgh") for _ in range(3000))
    begin, size = repeats.pieces([data])[1:3]
    texts = [data[b : b + s] for b, s in zip(begin.tolist(), size.tolist())]
    piece, first, stop, files = repeats.parts(texts, width)
    strings = sorted((p, x) for p, a, b in zip(piece.tolist(), first.tolist(), stop.tolist()) for x in range(a, b - repeats.SPAN + 1))
    assert strings == [(p, x) for p, t in enumerate(texts) for x in range(len(t) - repeats.SPAN + 1)]
    # equal strings are in files of one hash
    held = {}
    for p, a, b, f in zip(piece.tolist(), first.tolist(), stop.tolist(), files.tolist()):
        for x in range(a, b - repeats.SPAN + 1):
            assert held.setdefault(texts[p][x : x + repeats.SPAN], f) == f


def test_repeats_odd_input(spark):
    t = "the quick brown fox jumps over the lazy dog again and again and again"
    got = repeats.remove_repeats(documents(spark, [t, t, t, None, t], [None, 7, 7, 8, 9])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (7, 0), (7, 0), (8, 0), (9, len(t))]
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


def test_suffix_sort_orders_groups():
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(97, 99, size=400, dtype=np.uint8))
    at = np.arange(350)
    group = rng.integers(0, 5, size=350)
    order = repeats.Suffixes(data).sort(at, group, np.arange(350))
    assert order.tolist() == sorted(range(350), key=lambda i: (group[i], data[i : i + 50], i))


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there\nsecond line"),
        (1, 1, "assistant", "> hello   THERE\nIndeed"),
        (1, 2, "user", "On it:\n> > Hello there\n> Indeed\nfine"),
        (1, 3, None, ">unknown"),
        (2, 0, "user", None),
        (None, None, "user", "x"),
    ]
    got = {(r.conv_id, r.turn): r for r in formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 0].answers_turn is None and got[1, 0].depth == 0
    assert got[1, 1].answers_turn == 0 and got[1, 1].text == "Indeed" and got[1, 1].n_linked == 1
    assert got[1, 2].answers_turn == 1 and got[1, 2].n_quotes == 2 and got[1, 2].n_linked == 2 and got[1, 2].text == "On it:\nfine"
    assert got[1, 3].answers_turn == 2 and got[1, 3].n_linked == 0 and got[1, 3].text == "" and got[1, 3].depth == 3
    assert got[2, 0].text == "" and got[None, None].depth == 0 and "<|user|>" in got[None, None].formatted
    assert link_quotations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quotations_with_nulls_repeats_and_clashing_columns(spark):
    long = "\n".join(f"line {k} of a very long text" for k in range(5_000))
    rows = [
        (-1, -1, "user", "minus one", 1, 1), (-1, None, "user", "no turn", 1, 1), (None, -1, "user", "no conversation", 1, 1),
        (None, 4, "bot", "> no turn\nx", 1, 1), (-1, 4, "bot", "> no turn\nx", 1, 1), (-1, 4, "bot", "> no turn\nx", 1, 1),
        (5, 0, "user", long, 1, 1), (5, 1, "bot", "> line 4999 of a very long text\ny", 1, 1), (5, 2, "bot", "z", 1, 1),
    ]
    got = link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copy int, depth int")).collect()
    found = {(r.conv_id, r.turn, r.copy): (r.answers_turn, r.n_linked, r.depth) for r in got}
    assert found == {
        (-1, None, 0): (None, 0, 0), (-1, -1, 0): (None, 0, 1), (-1, 4, 0): (None, 1, 1), (-1, 4, 1): (None, 1, 1),
        (None, -1, 0): (None, 0, 0), (None, 4, 0): (-1, 0, 1), (5, 0, 0): (None, 0, 0), (5, 1, 0): (0, 1, 1), (5, 2, 0): (1, 0, 2),
    }


def test_quotations_of_several_lines_of_a_longer_message(spark):
    rows = [
        (1, 0, "user", "L1\nL2\n\nL3\nL4"),
        (1, 1, "assistant", "L2\nL4\nL3"),
        (1, 2, "user", "> L2\n> l3\nfirst"),
        (1, 3, "assistant", "> L2\n> L4\nsecond"),
        (1, 4, "user", "> L1\n> L3\nskips one"),
        (1, 5, "assistant", "> L3\n> L4\n> L5\none too many"),
        (1, 6, "user", "> Z1\n> Z2\nlater only"),
        (1, 7, "assistant", "Z0\nZ1\nZ2"),
        (1, 8, "user", "A\n> x\nB\nC"),
        (1, 9, "assistant", ">> A\n>> B\n> L3\n>\n> L4\nboth"),
        (2, 0, "user", "other"),
        (2, 1, "user", "> L2\n> L3\nof another conversation"),
        (2, 2, "user", "x\nx\nx\ny"),
        (2, 3, "user", "> x\n> x\n> y\nz"),
    ]
    got = {(r.conv_id, r.turn): r for r in link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = {2: (0, 1, 1), 3: (1, 1, 1), 4: (3, 1, 0), 5: (4, 1, 0), 6: (5, 1, 0), 8: (7, 1, 0), 9: (0, 2, 2)}
    assert {k: (r.answers_turn, r.n_quotes, r.n_linked) for k in want for r in [got[1, k]]} == want
    assert got[1, 2].depth == 1 and got[1, 3].depth == 2
    assert got[2, 1].n_linked == 0 and (got[2, 3].answers_turn, got[2, 3].n_linked) == (2, 1)


def brute_quotations(rows):
    """(conv, turn, copy): what it answers, quotes, links, depth, by looking at every pair of messages of a conversation."""
    squeeze = lambda t: re.sub("[ \t\r\n]+", " ", t.lower()).strip(" ")
    first, copies = lambda x: (x is not None, x or 0), collections.Counter()
    parsed = collections.defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (first(r[0]), first(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))):
        runs = []
        for line in (text or "").split("\n"):
            marks = re.match(r"^([ \t]*>)+", line)
            level = marks.group().count(">") if marks else 0
            line = re.sub(r"^([ \t]*>)+ ?", "", line)
            if not runs or runs[-1][0] != level:
                runs.append((level, []))
            runs[-1][1].append(line)
        parsed[conv].append((turn, copies[conv, turn], runs))
        copies[conv, turn] += 1
    out = {}
    for conv, messages in parsed.items():
        turns, ups = sorted({t for t, _, _ in messages}, key=first), {}
        for turn, copy, runs in messages:
            links, quotes = [], 0
            for at, (level, lines) in enumerate(runs):
                whole, parts = squeeze("\n".join(lines)), [squeeze(x) for x in lines if squeeze(x)]
                if level == 0 or not whole:
                    continue
                quotes += 1
                same, inside = [], []
                for other, _, theirs in messages:
                    own = [ls for k, ls in theirs if k == 0]
                    body = [x for ls in own for x in ls]
                    if whole in [squeeze("\n".join(ls)) for ls in own] + [squeeze(x) for x in body] + [squeeze("\n".join("\n".join(ls) for ls in own))]:
                        same.append(other)
                    said = [squeeze(x) for x in body if squeeze(x)]
                    if len(parts) > 1 and any(said[i : i + len(parts)] == parts for i in range(len(said))):
                        inside.append(other)
                for found in (same, inside):
                    if found and first(min(found, key=first)) < first(turn):
                        links.append((level, at, min(found, key=first)))
                        break
            before = [t for t in turns if first(t) < first(turn)]
            answers = min(links, key=lambda x: x[:2])[2] if links else before[-1] if before else "none"
            out[conv, turn, copy] = [None if answers == "none" else answers, quotes, len(links), 0]
            ups[turn] = min(ups.get(turn, answers), answers, key=lambda a: (a != "none", first(a) if a != "none" else 0))
        for turn, copy, _ in messages:
            up = ups[turn]
            while up != "none":
                out[conv, turn, copy][3] += 1
                up = ups[up]
    return {k: tuple(v) for k, v in out.items()}


def test_quotations_match_brute_force_and_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(21)
    lines = ["a", "b", "A  b", "", "c d", "e"]
    rows = []
    for conv in [None, *range(40)]:
        for turn in [None, *range(rng.randrange(2, 9))]:
            for _ in range(rng.choice([1, 1, 1, 2])):
                text = "\n".join(rng.choice(["", "", "", "> ", "> ", ">> ", ">"]) + rng.choice(lines) for _ in range(rng.randrange(1, 8)))
                rows.append((conv, turn, rng.choice(["user", "bot", None]), rng.choice([text] * 9 + [None])))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    result = queries.QUERIES["op2_chat_formatting"](spark, str(tmp_path))
    got = result.collect()
    want = brute_quotations(rows)
    assert {(r.conv_id, r.turn, r.copy): (r.answers_turn, r.n_quotes, r.n_linked, r.depth) for r in got} == want
    assert sum(v[2] for v in want.values()) > 100
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    said = con.execute(queries.ORACLES["op2_chat_formatting"]).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got))) == sorted(map(repr, said))


def plain_features(text):
    """The hashed words, stems, pairs and skip-pairs of a text, one by one."""
    import xxhash

    found = re.findall(r"[^\W_]+", text.lower())
    hashes, most = [xxhash.xxh64_intdigest(w) for w in found], (1 << 64) - 1
    a, b, c = (int(x) for x in toxicity.MULTIPLIERS)
    out = hashes + [xxhash.xxh64_intdigest(w[: toxicity.STEM], 1) for w in found if len(w) > toxicity.STEM]
    out += [(x * a + y * b) & most for x, y in zip(hashes, hashes[1:])] + [(x * b + y * c) & most for x, y in zip(hashes, hashes[2:])]
    return {((((h ^ (h >> 31)) * a) & most) >> 34) & toxicity.SPACE for h in out}


def test_toxicity_matches_a_plain_loop(spark):
    """Weights and scores by FTRL one coordinate at a time; clashing names, a very long text and repeated rows."""
    rng = random.Random(15)
    rows = [(i, words(rng, 12, 40) + (" scoundrel" if i % 3 == 0 else ""), "x", 7, b"f") for i in range(160)]
    rows += [(500, words(rng, 60_000, 40), "x", 7, b"f"), (501, "", "x", 7, b"f"), (502, None, "x", 7, b"f"), rows[3], rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, score int, features binary")
    marks = [(i, int(i % 3 == 0)) for i in range(160)]
    got = toxicity.score(docs, spark.createDataFrame([(i, t, 1, "y") for i, t in marks], "doc_id long, toxic int, shard int, text string"), l1=0.5).collect()

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    toxic = dict(marks)
    seen = [(toxic[i], sorted(plain_features(t or ""))) for i, t, *_ in rows if i in toxic and not held(i)]
    seen.sort(key=lambda x: (x[0], np.array(x[1], dtype="<i8").tobytes()))
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(c):
        penalty = 0.0 if c == "bias" else 0.5
        return 0.0 if abs(z[c]) <= penalty else -(z[c] - np.sign(z[c]) * penalty) / (1.0 + n[c] ** 0.5)

    for _ in range(3):
        for k in np.random.default_rng(7).permutation(len(seen)):
            label, features = seen[k]
            used = [*features, "bias"]
            w = {c: weight(c) for c in used}
            g = 1 / (1 + np.exp(-max(-30, min(30, sum(w.values()))))) - label
            for c in used:
                z[c] += g - ((n[c] + g * g) ** 0.5 - n[c] ** 0.5) * w[c]
                n[c] += g * g
    final = {c: weight(c) for c in z if abs(weight(c)) > 1e-3}
    for r in got:
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        total = final.get("bias", 0.0) + sum(final.get(c, 0.0) for c in plain_features(text or ""))
        assert abs(r.score - 1 / (1 + np.exp(-max(-30, min(30, total))))) < 1e-9 and r.predicted == (r.score >= 0.5) and r.held_out == held(r.doc_id)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(5)
    bad = ["scum", "moron"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 1
        t = words(rng, 40)
        rows.append(t + (" " + rng.choice(bad) if toxic else ""))
        labels.append((i, int(toxic)))
    rows += [None, ""]
    marked = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(documents(spark, rows), marked).collect()
    wrong = sum(r.predicted != labels[r.doc_id][1] for r in got if r.doc_id < 600 and r.held_out)
    assert wrong <= 3 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert [r.predicted for r in got if r.doc_id >= 600] == [0, 0]
    assert {r.score for r in toxicity.score(documents(spark, rows), marked.filter("false")).collect()} == {0.0}
    assert toxicity.score(documents(spark, []), marked).count() == 0


def test_digest_index_keeps_and_remembers(spark):
    index = DigestIndex(spark, "digests_test", buckets=4)
    got = {r.doc_id: r for r in index.add(documents(spark, ["Aé", "aé", "aÉ", None, "", "b"])).collect()}
    assert [got[i].kept for i in range(6)] == [False, True, True, False, True, True]
    assert got[0].keep_id == 1 and got[0].group_size == 2 and got[3].group_size == 2
    assert got[0].text_sha256 == sha256("aé".encode()).hexdigest()
    later = {r.doc_id: (r.keep_id, r.kept, r.known) for r in index.add(documents(spark, ["AÉ", "B", "c", "C"], [10, 11, 12, 12])).collect()}
    assert later == {10: (2, False, True), 11: (5, False, True), 12: (12, True, False)}
    assert index.add(documents(spark, [])).count() == 0
    assert {r.digest is None for r in spark.table("digests_test").collect()} == {False}
    spark.sql("drop table digests_test")


def test_a_batch_that_is_added_again_gets_its_answer(spark):
    index = DigestIndex(spark, "digests_again", buckets=4)
    answer = lambda rows: sorted((r.doc_id, r.keep_id, r.kept, r.known) for r in rows.collect())
    index.add(documents(spark, ["a", "b"])).count()
    first = documents(spark, ["b", "c", "C", "d"], [10, 11, 12, 13])
    lost = index.add(first, batch="one")  # its answer is never read
    index.add(documents(spark, ["d", "e"], [20, 21]), batch="two").count()
    want = [(10, 1, False, True), (11, 12, False, False), (12, 12, True, False), (13, 13, True, False)]
    assert answer(index.add(first, batch="one")) == want == answer(lost)
    assert answer(index.add(documents(spark, ["d", "e"], [20, 21]), batch="two")) == [(20, 13, False, True), (21, 21, True, False)]
    assert spark.table("digests_again").count() == 5
    spark.sql("drop table digests_again")


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_shingle_join_matches_brute_force(spark, texts, width, percent):
    got = near_texts(documents(spark, texts), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, width, percent)


def test_shingle_join_chains_and_odd_input(spark):
    rng = random.Random(6)
    chain, now = [], [f"c{rng.randrange(9999)}" for _ in range(200)]
    for k in range(40):  # neighbours link, the ends share little
        now = list(now)
        now[(k * 5) % 200] = f"n{k}"
        chain.append(" ".join(now))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_texts(documents(spark, chain)).collect()}
    assert got == brute_components(chain, 3, 90)
    odd = near_texts(documents(spark, ["a b", "A  B", "c", None, "c"], [None, 3, 4, 5, 4])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in odd if r.doc_id) == [(3, 1, 3), (4, 1, 4), (4, 1, 4), (5, 0, 5)]
    assert near_texts(documents(spark, [])).count() == 0


def test_shingle_join_of_repeated_ids(spark):
    """Each text of a repeated doc_id links, not the least one only."""
    rng = random.Random(16)
    near = words(rng, 80)
    for other in (words(rng, 80), "zz " + words(rng, 80), "a " + words(rng, 80), ""):
        rows = documents(spark, [near, other, near + " w1", other, None], [7, 7, 9, 7, 8])
        got = {(r.doc_id, r.n_shingles > 0): r.component_id for r in near_texts(rows).collect()}
        assert got[9, True] == got[7, True] == 7 and got[8, False] == 8


def test_shingle_join_of_very_long_texts(spark):
    rng = random.Random(17)
    long = words(rng, 60_000, 100_000).split()
    near = [*long[:30_000], "x", *long[30_010:]]
    far = [f"y{k}" if k % 20 == 0 else w for k, w in enumerate(long)]
    texts = [" ".join(x) for x in (long, near, far)] + [words(rng, 9) for _ in range(5)]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_texts(documents(spark, texts)).collect()} == brute_components(texts, 3, 90)


def test_list_rows_without_partners_go(spark):
    """Of a list those rows stay whose size and place allow a link with another, and nothing else is joined or compared."""
    rng = random.Random(18)
    early = lambda n, pos: pos < n - -(-180 * n // 190) + 1
    rows = [(t, rng.randrange(60), n, t * 100 + g, 1 + (g == 7)) for t in range(8) for g in range(12) for n in [rng.randrange(40, 1500)]]
    rows += [(9, 80, 800, 900, 1), (9, 80, 800, 901, 1)]
    rows = [(t, min(pos, n // 10), n, g, m) for t, pos, n, g, m in rows]
    fits = lambda r, s: r[0] == s[0] and r[3] != s[3] and 100 * min(r[2], s[2]) >= 90 * max(r[2], s[2]) and (r[2] == s[2] or early(*min((r[2], r[1]), (s[2], s[1]))))
    wanted = {r[3] for r in rows if r[4] > 1 or any(fits(r, s) for s in rows)}
    lists = spark.createDataFrame(rows, "token long, pos int, n long, group long, members long")
    assert {r.group for r in jaccard_join._with_partners(lists, 90).collect()} == wanted
    assert 8 < len(wanted) < len(rows)


def test_components(spark):
    edges = [(i + 1, i) for i in range(100)] + [(200, 201), (202, 201), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200, 202: 200}


def test_vectors_recall_and_odd_input(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 32))
    vectors = [v.tolist() for v in base]
    for v in base[:30]:
        for share in (0.1, 0.3, 0.5):
            vectors.append((v + share * rng.standard_normal(32)).tolist())
    vectors += [base[0].tolist()] * 5
    rows = list(enumerate(vectors)) + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [1.0, None]), (904, []), (None, base[0].tolist()), (905, [1.0, 2.0])]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    x = np.array(vectors, dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    found = np.array([got[i].n_links for i in range(len(vectors))])
    assert (found <= links.sum(1)).all() and found.sum() >= 0.9 * links.sum()
    assert got[len(vectors) - 1].component_id == 0 and not got[len(vectors) - 1].kept and got[0].kept
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 905))
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_any_scale_and_repeated_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e200, 2e200]), (2, [1e200, 2e200]), (3, [1e-200, 2e-200]), (4, [-1.0, 2.0]), (5, [1e308, -1e308]), (5, [5e-324, 1e-323]), (6, [1e308, -1e308])]
    table = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<double>, rep int, links int")
    got = [(r.vec_id, r.n_links, r.component_id) for r in near_vectors(table).collect()]
    assert {x for x in got if x[0] < 4} == {(i, 4, 0) for i in range(4)} and (4, 0, 4) in got
    assert {x[2] for x in got if x[0] in (5, 6)} == {0, 5} or {x[2] for x in got if x[0] in (5, 6)} == {0}


def test_links_of_two_forms_of_one_vector(spark):
    """Two classes whose smallest vec_id is the same keep their own links, and meet in one component."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = spark.createDataFrame([(1, a), (7, a), (1, b), (12, [0.0, 1.0, 0.01]), (30, [0.0, 0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(rows).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (7, 1, 1, False), (12, 1, 1, False), (30, 0, 30, True)]


def test_vector_tables_grow_with_the_number_of_vectors():
    shapes = [embedding_dedup.shape(n, 0.9, 2.0, 0.91) for n in (0, 1_000, 50_000, 10**6, 10**9)]
    assert shapes[:3] == [(16, 10)] * 3
    near, far = (embedding_dedup.together(d, 2.0) for d in (0.2**0.5, 2**0.5))
    for n, (tables, projections) in zip((10**6, 10**9), shapes[3:]):
        assert 1 - (1 - near**projections) ** tables >= 0.91 and n * far**projections <= 50_000 * far**10


def test_code_lengths_are_limited_and_complete():
    for counts in ([5], [1, 1], [1 << k for k in range(30)], [0, 3, 0, 1, 1, 9]):
        lengths = token_files.code_lengths(np.array(counts), 16).astype(int)
        used = lengths[lengths > 0]
        assert used.max() <= 16 and ((lengths > 0) == (np.array(counts) > 0)).all()
        assert len(used) == 1 or sum(2.0**-n for n in used) == 1


def test_codes_round_trip():
    rng = np.random.default_rng(3)
    counts = np.zeros(5000, dtype=np.int64)
    ids = (rng.zipf(1.3, 40_000) % 5000).astype(np.uint32)
    counts += np.bincount(ids, minlength=5000)
    code = token_files.Code(token_files.code_lengths(counts, 16), 16)
    for n in (1, 127, 128, 129, len(ids)):
        bits, checkpoints = code.encode(ids[:n])
        assert (code.decode(bits, checkpoints, n) == ids[:n]).all()


def whole_ids(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], dtype="<u4") for x in texts]


ODD_TEXTS = ["a  b", " lead", "trail ", "tab\there", "a \n b\n\nc", "it's we'll", "x<|endoftext|>y", "nb sp", " ", "ﬁ É ÀB", "日本 語", "12 345", "a\x1cb", "\r\n"]


def test_token_files_round_trip(spark, texts):
    texts = texts + ODD_TEXTS
    got = token_files.round_trip(documents(spark, texts), tokenizer_file("byte_bpe_50k.json")).orderBy("doc_id").collect()
    start = 0
    for r, ids in zip(got, whole_ids("byte_bpe_50k.json", texts, 2), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.round_trip(documents(spark, []), tokenizer_file("byte_bpe_50k.json")).count() == 0
    assert token_files.round_trip(documents(spark, ["a", "b", "c"], [None, 2, 2]), tokenizer_file("byte_bpe_50k.json")).count() == 3


def test_mixing_meets_targets(spark, texts):
    rows = mix_plan(documents(spark, texts)).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    total = sum(r.size for r in rows)
    assert abs(sum(r.target for r in {r.source: r for r in rows}.values()) - 1.5 * total) < 1e-6 * total
    for part in by.values():
        assert abs(sum(r.taken for r in part) - part[0].target) <= 1 and part[0].target <= 2 * part[0].source_size
    again = {r.doc_id: r.taken for r in mix_plan(documents(spark, texts)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    out = mixed(documents(spark, texts))
    assert out.columns == DOCS.replace(",", "").split()[::2] and out.count() == sum(len(r.takes) for r in rows)
    assert mix_plan(documents(spark, [])).collect() == []
    assert [(r.size, r.target, r.taken) for r in mix_plan(documents(spark, [None, ""], [None, None])).collect()] == [(0, 0.0, 0)] * 2


def test_mixing_of_a_source_without_words(spark):
    rows = [(1, None, "empty"), (2, "", "empty"), (3, "a b c", "full"), (4, "d e", None)]
    got = {r.doc_id: r for r in mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].target == got[2].target == 0 and got[1].taken == 0 and got[1].takes == []
    assert got[3].taken + got[4].taken == pytest.approx(7.5, abs=1)


def test_mixing_of_repeated_rows(spark):
    """Each row has its own takes, and its place doesn't depend on the order of the input."""
    rows = [(1, "a b c d", "s", 1, 0.5), (1, "a b c d", "s", 2, 0.5), (1, "e f", "s", 3, 0.5), (None, "g h", None, 4, 0.5), (None, "g h", None, 5, 0.5), (7, " ".join("w" * 30_000), "s", 6, 0.5)]
    schema = "doc_id long, text string, source string, size int, _position double"
    plans = [sorted(map(repr, mix_plan(spark.createDataFrame(r, schema).repartition(3)).collect())) for r in (rows, rows[::-1])]
    assert plans[0] == plans[1]
    want = sum(len(r.takes) for r in mix_plan(spark.createDataFrame(rows, schema)).collect())
    out = mixed(spark.createDataFrame(rows, schema))
    got = out.collect()
    assert out.columns == ["doc_id", "text", "source", "size", "_position"] and len(got) == want
    assert max(collections.Counter(got).values()) <= 2


def test_packing_places_every_piece(spark, texts):
    texts = texts + ODD_TEXTS
    got = packing.pack(documents(spark, texts), tokenizer_file("word_bpe_49k.json")).collect()
    want = [(i, p // 2048, p, len(x[p : p + 2048]), zlib.crc32(x[p : p + 2048].tobytes())) for i, x in enumerate(whole_ids("word_bpe_49k.json", texts, 0)) for p in range(0, len(x), 2048)]
    assert sorted(tuple(r)[:5] for r in got) == want
    check_places([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    assert packing.pack(documents(spark, []), tokenizer_file("word_bpe_49k.json")).count() == 0
    assert packing.pack(documents(spark, ["a", None, "b"], [None, 2, 2]), tokenizer_file("word_bpe_49k.json")).count() == 3


def check_places(places, capacity):
    by = collections.defaultdict(list)
    for s, o, n in places:
        by[s].append((o, n))
    for part in by.values():
        end = 0
        for o, n in sorted(part):
            assert o == end
            end += n
        assert end <= capacity
    return len(by)


def best_packing(sizes, capacity):
    """The fewest sequences, by search."""
    best = len(sizes)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for r in sorted(set(x for x in rooms if x >= sizes[k])):
            i = rooms.index(r)
            put(k + 1, rooms[:i] + [r - sizes[k]] + rooms[i + 1 :])
        put(k + 1, [*rooms, capacity - sizes[k]])

    put(0, [])
    return best


def test_reduction_is_never_worse_than_the_best():
    rng = random.Random(8)
    for _ in range(150):
        sizes = sorted((rng.randrange(1, 31) for _ in range(rng.randrange(1, 9))), reverse=True)
        plan = packing.Plan(np.bincount(sizes, minlength=31), 30)
        places = [(first + b, offset + e * n, n) for n, _, each, bins, first, offset in plan.runs for b in range(bins) for e in range(each)]
        assert sorted((p[2] for p in places), reverse=True) == sizes
        used = check_places(places, 30)
        best = best_packing(sizes, 30)
        assert used <= best + 1 and (plan.fixed < used or used == best)


def test_a_worker_holds_the_last_helper_alone(monkeypatch):
    monkeypatch.setattr(shared, "_held", {})
    first = shared.only("a", list)
    assert shared.only("a", list) is first
    shared.only("b", dict)
    assert set(shared._held) == {"b"} and shared.only("a", list) is not first


def test_language_id(spark):
    rng = random.Random(9)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "öt"]}
    rows = []
    for i in range(120):
        lang = "aa" if i % 3 else "bb"
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(20)), lang))
    rows += [(200, None, "aa"), (201, "12 %% 3", "bb"), (202, "", None), (None, "kalomi", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert all(got[i].lang_pred == rows[i][2] for i in range(120))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 for i in range(120))
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and got[None].lang_pred == "aa"
    assert language_id.identify(docs.filter("false")).count() == 0
    kept = language_id.in_some_language(docs)
    assert kept.columns == docs.columns and kept.count() == 121


def phrases_of(training, text):
    """Phrases by trying every length."""
    phrases, i = 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in training:
            n += 1
        phrases, i = phrases + 1, i + n
    return phrases


def test_cross_parsing_counts_longest_matches():
    rng = random.Random(10)
    training = {"x": ["abracadabra banana", "cab"], "y": [" ".join("".join(rng.choice("abcn") for _ in range(9)) for _ in range(60))]}
    parser = language_id.Parser(training)
    texts = ["abrabanana cadab", "", "q", "a", "a" * 511, "ab" * 256, ("abracadabra banana cab " * 200).strip()]
    texts += ["".join(rng.choice("abcn ") for _ in range(n)).strip() for n in (512, 513, 1024, 3000, 5000)]
    texts = [" ".join(t.split()) for t in texts]
    bits, _ = parser.parse(texts)
    for k, (lang, found) in enumerate(training.items()):
        whole = " ".join(found)
        want = [phrases_of(whole, t) * np.log2(len(whole) + 1) / max(len(t), 1) for t in texts]
        assert bits[:, k] == pytest.approx(want)
    assert parser.languages == ["x", "y"]


def test_automaton_of_many_letters_stays_small():
    codes = [int(x) for x in np.random.default_rng(4).integers(0, 5000, size=4000)]
    automaton = language_id.Automaton(codes, 5001)
    assert len(automaton.next) < 60_000
    state = np.zeros(1, dtype=np.int32)
    begun = []
    for c in codes:
        state, new = automaton.step(state, np.array([c]))
        begun.append(bool(new[0]))
    assert begun == [True] + [False] * (len(codes) - 1)


def test_language_id_reads_whole_texts(spark):
    """Languages that differ behind the first 2,100 letters only, and repeated and clashing rows."""
    rng = random.Random(12)
    same = " ".join(rng.choice(["ka", "lo", "mi"]) for _ in range(720))
    tail = {"aa": "schung ", "bb": "nienten "}
    rows = [(i, same + " " + tail[lang] * 60, lang, 1.0, True) for i, lang in enumerate(["aa", "bb"] * 20)]
    rows += [(100, tail["aa"] * 30, None, 1.0, True), (100, tail["bb"] * 30, None, 1.0, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, held_out boolean")
    got = [(r.doc_id, r.lang_pred) for r in language_id.identify(docs).collect()]
    assert sorted(got) == sorted((i, "aa" if tail["aa"] in t else "bb") for i, t, *_ in rows)
    kept = language_id.in_some_language(docs, ["bb"])
    assert {r.lang or "" for r in kept.collect()} == {"bb", ""} and kept.count() == 21


def test_pipeline_stages_keep_columns(spark, texts, tmp_path):
    import corpus_pipeline

    documents(spark, texts).drop("digest", "k1", "anchor", "component", "n", "id").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    last = {}
    for i in kept:
        last["".join(c.lower() if c.isascii() else c for c in texts[i])] = i
    kept = sorted(last.values())
    roots = brute_components([texts[i] for i in kept], 5, 80)
    kept = [kept[i] for i, (_, root) in roots.items() if root == i]
    taken = {r.doc_id for r in mix_plan(docs.filter(docs.doc_id.isin(kept))).collect() if r.taken}
    assert {r.doc_id for r in out} == taken
    check_places([(r.sequence_id, r.offset, r.length) for r in out], 2048)


def test_pipeline_of_an_empty_table_and_of_clashing_columns(spark, texts, tmp_path):
    import corpus_pipeline

    documents(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    documents(spark, texts).write.parquet(f"{tmp_path}/clash/documents.parquet")
    documents(spark, texts).drop("digest", "k1", "anchor", "component", "n", "id").write.parquet(f"{tmp_path}/plain/documents.parquet")
    out = [sorted(map(tuple, corpus_pipeline.run(spark, f"{tmp_path}/{k}").select("doc_id", "piece", "length", "ids_crc32").collect())) for k in ("clash", "plain")]
    assert out[0] == out[1] and out[0]


def test_new_units_are_encoded_together(monkeypatch):
    """Words with a space before them share texts when they are encoded; the ids are those of whole texts."""
    import public_tokenizers

    from ledgerloom.llm import tokens

    text = "One " + " ".join(f"w{k}x foo-bar{k} d'uné{k}! Ġa{k}" for k in range(300)) + "\nend 日本 語"
    coder, sent = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")), []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            sent.append(len(texts))
            return coded.encode_batch_fast(texts, **options)

    coded, coder.tokenizer = coder.tokenizer, Counting()
    for t in (text, "a\tb c", "x y", " lead trail "):
        assert coder.encode([t])[0] == tokens.pack(f"<{len(ids := coded.encode(t, add_special_tokens=False).ids)}I", *ids)
    assert max(sent) < 100


def test_messages_without_quotes_are_not_linked(spark, monkeypatch):
    # a join with no quotes is dropped while its other side runs, whose files then go
    monkeypatch.setattr(quotations, "link_stretches", lambda *_: pytest.fail("nothing to link"))
    rows = spark.createDataFrame([(1, 1, "user", "hello"), (1, 2, "assistant", "a > b"), (1, 3, "user", None)], "conv_id long, turn long, role string, text string")
    assert [(r["turn"], r["answers_turn"], r["n_quotes"], r["depth"], r["text"]) for r in link_quotations(rows).orderBy("turn").collect()] == [(1, None, 0, 0, "hello"), (2, 1, 0, 1, "a > b"), (3, 2, 0, 2, "")]


def test_turns_whose_depth_is_known_leave_the_doubling(spark, monkeypatch):
    met = []

    def joined(left, right, on, how):
        met.append(left.count())
        return join(left, right, on, how)

    rows = [(1, t, t - 1 if t else None) for t in range(70)] + [(c, t, t - 1 if t else None) for c in range(2, 60) for t in range(2)]
    links = spark.createDataFrame(rows, "conv_id long, turn long, up long")
    join = type(links).join
    monkeypatch.setattr(type(links), "join", joined)
    got = {(r["conv_id"], r["turn"]): r["depth"] for r in quotations.reply_depths(links).collect()}
    assert got == {(c, t): t for c, t, _ in rows} and met == [127, 68, 66, 62, 54, 38, 6]


def test_new_words_between_dropped_spaces_are_encoded_many_at_once(monkeypatch):
    from ledgerloom.llm import tokens

    coder, sent = tokens.Encoder(tokenizer_file("word_bpe_49k.json")), []
    units = [f"w{k}x" for k in range(1000)] + [coder.mark, "12,5%", "don't", "̈x", "ẞ"]
    one = [coder._encode([u])[0] for u in units]
    fast = coder.tokenizer.encode_batch_fast
    coder.tokenizer = type("Seen", (), {"encode_batch_fast": lambda self, texts, **k: (sent.append(len(texts)), fast(texts, **k))[1]})()
    assert coder._encode_units(units) == one and sum(sent) < 300
