"""Language ID by cross-parsing entropy with suffix automata of labelled text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import only
from .tokens import slices

#: No language: the text is null or has no letter.
UNKNOWN = "und"
#: Letters of a text that are parsed side by side with the others; a state is carried from one to the next.
LANE = 512
#: Gaps that a state's row of transitions is tried in before the search moves on for good.
TRIES = 32
#: Characters of the labelled rows of one language, and how many of its rows are looked at.
LETTERS, ROWS = 100_000, 96


def training_text(docs: DataFrame, rows: int, letters: int) -> dict[str, list[str]]:
    """Whole labelled texts of each language: of the first ``rows`` documents by a hash of their id those
    that together have ``letters`` characters at most, and the shortest if none has so few.

    Documents are left out of this sample or taken whole. What is collected is bounded by the number of
    languages times ``letters``, but for a language whose shortest text is longer."""
    marked = docs.filter("lang is not null and text is not null").select("lang", "doc_id", F.xxhash64("text").alias("_t"), "text")
    # texts stay behind until the rows are chosen
    order = F.xxhash64("doc_id"), "doc_id", "_t"
    some = marked.select("lang", "doc_id", "_t", F.length("text").alias("_size")).withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    by_lang = Window.partitionBy("lang")
    some = some.filter(F.col("_n") <= rows).withColumn("_fits", F.col("_size") <= letters)
    some = some.withColumn("_least", F.row_number().over(by_lang.orderBy("_size", "_n"))).withColumn("_any", F.max("_fits").over(by_lang))
    some = some.withColumn("_sum", F.sum(F.when(F.col("_fits"), F.col("_size")).otherwise(0)).over(by_lang.orderBy("_n")))
    picked = some.filter(F.when(F.col("_any"), F.col("_fits") & ((F.col("_sum") <= letters) | (F.col("_sum") == F.col("_size")))).otherwise(F.col("_least") == 1))
    picked = picked.select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_id"), F.col("_t").alias("_hash")).distinct()
    # at most ``rows`` rows of three numbers and names a language
    texts = marked.join(F.broadcast(picked), (F.col("lang") == F.col("_lang")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_hash")))
    held: dict[str, dict[str, None]] = {}
    for row in sorted(texts.select("lang", "text").distinct().collect()):
        if any(c.isalpha() for c in row["text"]):
            held.setdefault(row["lang"], {})[row["text"]] = None
    return {lang: list(found) for lang, found in held.items()}


class Automaton:
    """The suffix automaton of some codes, its transitions packed by row displacement.

    State s goes on c to ``next[base[s] + c]`` if ``owner[base[s] + c]`` is s; else a phrase ends. The
    states' rows are shifted over each other into one array, so it has about as many entries as there
    are transitions, however many letters there are."""

    def __init__(self, codes: list[int], width: int):
        nexts = self._built(codes)
        self.root = np.zeros(width, dtype=np.int32)
        for c, s in nexts[0].items():
            self.root[c] = s
        # states with several transitions find a gap near the end of what is taken, those with one fill what is left
        taken = bytearray(4 * width)
        self.base = np.zeros(len(nexts), dtype=np.int32)
        cursor = free = width
        for s in sorted(range(len(nexts)), key=lambda s: -len(nexts[s])):
            found = list(nexts[s])
            if not found:
                break
            low = min(found)
            if len(found) > 1:
                at = taken.find(0, cursor)
                for _ in range(TRIES):
                    if not any(taken[at - low + c] for c in found):
                        break
                    at = taken.find(0, at + 1)
                else:
                    cursor = at
                    while any(taken[at - low + c] for c in found):
                        at = taken.find(0, at + 1)
            else:
                at = free = taken.find(0, free)
            if at + 3 * width >= len(taken):
                taken.extend(bytes(len(taken)))
            self.base[s] = at - low
            for c in found:
                taken[at - low + c] = 1
        total = int(self.base.max()) + width + 1
        self.next, self.owner = np.zeros(total, dtype=np.int32), np.full(total, -1, dtype=np.int32)
        for s, found in enumerate(nexts):
            for c, t in found.items():
                self.next[self.base[s] + c] = t
                self.owner[self.base[s] + c] = s

    @staticmethod
    def _built(codes: list[int]) -> list[dict[int, int]]:
        nexts, links, longest, last = [{}], [-1], [0], 0
        for c in codes:
            cur = len(nexts)
            nexts.append({})
            links.append(0)
            longest.append(longest[last] + 1)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = links[p]
            if p >= 0:
                q = nexts[p][c]
                if longest[p] + 1 == longest[q]:
                    links[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    links.append(links[q])
                    longest.append(longest[p] + 1)
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = links[p]
                    links[q] = links[cur] = clone
            last = cur
        return nexts

    def step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states behind the codes, and where a phrase begins with them: where none goes on, or the
        last one was a letter that the automaton has nowhere."""
        at = self.base[state] + codes
        ends = self.owner[at] != state
        return np.where(ends, self.root[codes], self.next[at]), ends | (state == 0)


class Parser:
    """Counts the phrases into which each language's text parses other texts."""

    def __init__(self, training: dict[str, list[str]]):
        self.languages = list(training)
        letters = sorted({c for t in training.values() for x in t for c in x.lower() if c.isalpha()})
        self.other = len(letters) + 1  # a letter that no training text has
        self.width = self.other + 1
        self.classes = np.zeros(0x110000, dtype=np.int32)
        self.classes[[c for c in range(0x110000) if chr(c).isalpha()]] = self.other
        for k, c in enumerate(letters):
            self.classes[ord(c)] = k + 1
        self.automata, self.bits = [], []
        for t in training.values():
            codes = self.codes([" ".join(t)])[0]
            self.automata.append(Automaton(codes.tolist(), self.width))
            self.bits.append(np.log2(len(codes) + 1))

    def codes(self, texts: list[str]) -> list[np.ndarray]:
        """Letter classes of each text, where whatever is no letter is one gap."""
        low = [t.lower() for t in texts]
        flat = self.classes[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        out, at = [], 0
        for t in low:
            c = flat[at : at + len(t)]
            at += len(t)
            gap = c == 0
            out.append(c[~(gap & np.concatenate([[True], gap[:-1]]))] if len(c) else c)
        return out

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a letter for each text and language, and whether the text has a letter.

        A phrase is the longest match from where the last one ended, over the whole text. A text is read
        in lanes of LANE letters side by side, each from the start state first. Then every lane but a
        text's first is read again from the state in which the lane before it ended, until it falls in
        with what was read before, and so on until no lane's end changes: so the lanes give what reading from
        end to end gives.
        """
        coded = self.codes(texts)
        sizes = np.array([len(c) for c in coded], dtype=np.int64)
        some = np.array([bool(c.any()) for c in coded], dtype=bool)
        phrases = np.zeros((len(texts), len(self.languages)))
        owner = np.repeat(np.arange(len(texts)), -(-sizes // LANE))
        if len(owner):
            flat = np.concatenate(coded)
            starts = np.cumsum(sizes) - sizes
            nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
            begin = starts[owner] + nth * LANE
            length = np.minimum(LANE, sizes[owner] - nth * LANE)
            for k, automaton in enumerate(self.automata):
                begun = self._phrases(automaton, flat, begin, length, nth)
                some_texts = np.flatnonzero(sizes)
                phrases[some_texts, k] = np.add.reduceat(begun, starts[some_texts], dtype=np.int64)
        return phrases * np.array(self.bits) / np.maximum(sizes, 1)[:, None], some

    @staticmethod
    def _phrases(automaton: Automaton, flat: np.ndarray, begin: np.ndarray, length: np.ndarray, nth: np.ndarray) -> np.ndarray:
        states, begun = np.zeros(len(flat), dtype=np.int32), np.zeros(len(flat), dtype=bool)
        order = np.argsort(-length, kind="stable")
        active = np.searchsorted(-length[order], -np.arange(LANE), side="left")  # lanes longer than t
        state = np.zeros(len(begin), dtype=np.int32)
        first = begin[order]
        for t in range(int(length.max())):
            n = active[t]
            at = first[:n] + t
            state[:n], begun[at] = automaton.step(state[:n], flat[at])
            states[at] = state[:n]
        lanes = np.flatnonzero(nth > 0)
        while len(lanes):
            state, live, changed = states[begin[lanes] - 1], lanes, []
            for t in range(LANE):
                if not len(live):
                    break
                at = begin[live] + t
                state, new = automaton.step(state, flat[at])
                differs = states[at] != state
                states[at], begun[at] = state, new
                ended = t + 1 == length[live]
                changed.append(live[differs & ended])
                go = differs & ~ended
                live, state = live[go], state[go]
            ends = np.concatenate(changed) + 1
            ends = ends[ends < len(nth)]
            lanes = np.sort(ends[nth[ends] > 0])
        return begun


def predictions(training: dict[str, list[str]], texts: list[str]) -> Iterator[tuple[str, float]]:
    parser = only(("parser", tuple((k, tuple(v)) for k, v in training.items())), lambda: Parser(training))
    bits, some = parser.parse(texts)
    for row, letters in zip(bits, some):
        if not letters or not parser.languages:
            yield UNKNOWN, 0.0
            continue
        best = int(np.argmin(row))
        second = float(np.delete(row, best).min()) if len(row) > 1 else float("inf")
        yield parser.languages[best], float(second / (row[best] + second)) if np.isfinite(second) else 1.0


def _predict(training: dict[str, list[str]]):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            found = [x for a, b in slices(texts) for x in predictions(training, [t or "" for t in texts[a:b]])]
            kept = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                [*(batch.schema.names[i] for i in kept), "lang_pred", "score"],
            )

    return run


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame, rows: int = ROWS, letters: int = LETTERS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row.

    Each language of the rows that are not held out gives a bounded sample of whole texts (from ``rows``
    documents, ``letters`` characters in all), whose suffix automaton then parses the texts from end to
    end: a phrase is the longest match from where the last one ended. The language with the fewest
    phrases wins, where phrases count the bits of a place in its sample, by letter; of equal ones,
    the first by name. The score is the runner-up's share of the bits of both: 0.5 for a tie.

    Null and empty texts and texts without a letter give ``und`` and 0. With no labelled row every
    text gives that. A null doc_id is not held out. Repeated rows are answered each; a very long text
    is parsed whole; an empty table gives an empty result. Other columns are not read.
    """
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    training = training_text(docs.filter(~held_out()).select("doc_id", "lang", "text"), rows, letters)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(_predict(training), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def in_some_language(docs: DataFrame, languages: Sequence[str] | None = None, rows: int = ROWS, letters: int = LETTERS) -> DataFrame:
    """The rows whose text is in one of ``languages`` (of those that are labelled, if None), with all
    their columns.

    The language is that of ``identify``, learnt from all rows with a language. Null and empty texts
    and texts without a letter are in none. With no labelled row no row is kept. Repeated rows are
    judged each; an empty table gives an empty result.
    """
    training = training_text(docs.select("doc_id", "lang", "text"), rows, letters)
    wanted = set(training if languages is None else languages)

    def keep(batches):
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            found = [x[0] in wanted for a, b in slices(texts) for x in predictions(training, [t or "" for t in texts[a:b]])]
            yield batch.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
