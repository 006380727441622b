"""Token ids of whole texts, as little-endian unsigned 32-bit integers."""

from __future__ import annotations

import json
import os
import re
from itertools import repeat
from struct import pack

import numpy as np

from .shared import only

#: White space other than a space and a newline, and what Python alone takes for white space.
ODD = re.compile(r"[^\S \n]")
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Units that are encoded in one text.
TOGETHER = 256
#: Letters and the marks behind them, which no tokenizer here merges; an apostrophe may begin a suffix.
WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


class Encoder:
    """Encodes texts with a tokenizers file, one short unit at a time and each unit once.

    A tokenizer that splits its input before merging never merges over such a split, so what stands
    between two of them can be encoded on its own and remembered:

    - byte-level BPE without a normalizer splits before a space and around a newline, where no other
      white space stands next to it; a unit is a word with the space or the newline before it;
    - BPE that drops white space splits at it; a unit is a word.

    Both split between letters and the mark behind them. Texts with other white space or with the
    start of a special token, and any other kind of tokenizer, are encoded whole. Units are held in
    two generations of at most ``limit``; one that is met again moves to the newer. Other white space
    shows in units that are new; once it does, every text is looked through for it first.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before, splits = kind.get("normalizer"), kind.get("pre_tokenizer") or {}
        levels = splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space")
        drops = splits.get("type") == "Sequence" and splits["pretokenizers"][0].get("behavior") == "Removed" and splits["pretokenizers"][0].get("invert")
        self.special = tuple(x["content"][:2] for x in kind.get("added_tokens", []))
        self.mode = "led" if levels and not before else "words" if drops and r"[^\s\p{L}\p{N}]+" in splits["pretokenizers"][0]["pattern"].get("Regex", "") else "whole"
        self.ending = (kind.get("model") or {}).get("end_of_word_suffix") or ""
        self.limit, self.new, self.old, self.marks = limit, {}, {}, {}
        self.leads = np.zeros(self.vocabulary, dtype=bool)
        if self.mode == "led":
            # the pieces that begin with a space, which byte-level vocabularies write as a letter
            self.leads[[i for token, i in self.tokenizer.get_vocab().items() if token[:1] == "\u0120"]] = True
        self.mark, self.behind = "", 0
        if self.mode == "words":
            # the word between others, which is left out
            self.mark, at = self._mark()
            self.leads[at], self.behind = bool(self.mark), 4
        self.strict = False

    def _encode(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [pack(f"<{len(x)}I", *x) for x in (c.ids for c in coded)]

    def _mark(self) -> tuple[str, int]:
        """A short and rare plain word that is one piece, and its id."""
        words = ((w.removesuffix(self.ending), i) for w, i in self.tokenizer.get_vocab().items())
        words = sorted(((w, i) for w, i in words if w.isascii() and w.isalpha()), key=lambda x: (len(x[0]) < 3, len(x[0]), -x[1]))
        return next(((w, i) for w, i in words if self.tokenizer.encode(w, add_special_tokens=False).ids == [i]), ("", -1))

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit. Words are encoded many at once, as no merge goes over a space: one with a space before it
        has one piece that begins with one, and where white space is dropped a word of one piece stands between two."""
        if self.mode == "whole" or (self.mode == "words" and not self.mark):
            return self._encode([self._written(u) for u in units])
        out: dict[int, bytes] = {}
        led = self.mode == "led"
        plain = [i for i, u in enumerate(units) if u and u[0] != "\n" and not ODD.search(u)] if led else range(len(units))
        runs = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        between = " " if led else f" {self.mark} "
        for run, coded in zip(runs, self.tokenizer.encode_batch_fast([between + between.join([units[i] for i in run]) for run in runs], add_special_tokens=False)):
            ids = np.array(coded.ids, dtype="<u4")
            at = np.flatnonzero(self.leads[ids])
            if len(at) == len(run):
                raw, at = ids.tobytes(), [*(at * 4).tolist(), len(ids) * 4]
                out.update(zip(run, [raw[a + self.behind : b] for a, b in zip(at, at[1:])]))
        rest = [i for i in range(len(units)) if i not in out]
        out.update(zip(rest, self._encode([self._written(units[i]) for i in rest])))
        return [out[i] for i in range(len(units))]

    def _written(self, unit: str) -> str:
        """A unit as it stands in a text."""
        return unit if self.mode == "words" or unit[:1] == "\n" else " " + unit

    def _learn(self, units: set[str]) -> None:
        """Puts units into the newer generation, those with marks behind their letters by parts."""
        old, new, parts, need = self.old, self.new, {}, set()
        for u in units:
            got = old.get(u)
            if got is not None:
                new[u] = got
                continue
            split = WORD_AND_MARKS.fullmatch(u)
            if split and split[1].lower().isalpha():
                stem, marks = parts[u] = split.groups()
                if stem not in new:
                    got = old.get(stem)
                    if got is not None:
                        new[stem] = got
                    else:
                        need.add(stem)
                if marks not in self.marks:
                    self.marks[marks] = self._encode([marks])[0]
            else:
                need.add(u)
                if self.mode == "led" and not self.strict and ODD.search(u[1:] if u[:1] == "\n" else u):
                    self.strict = True
        need = list(need)
        new.update(zip(need, self._encode_units(need)))
        for u, (stem, marks) in parts.items():
            new[u] = new[stem] + self.marks[marks]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without special tokens."""
        if len(self.marks) > self.limit:
            self.marks = {}
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        out: list[bytes] = [b""] * len(texts)
        units: list[str] = []
        spans = []
        for i, t in enumerate(texts):
            if self.mode == "words":
                odd = any(x in t for x in SEPARATORS)
            else:
                odd = "  " in t or "\n\n" in t or " \n" in t or "\n " in t or (self.strict and ODD.search(t))
            if self.mode == "whole" or odd or any(x in t for x in self.special):
                out[i] = self._encode([t])[0]
            elif t:
                # a text's first word has no space before it
                head, *rest = ["", *t.split()] if self.mode == "words" else t.replace("\n", " \n").split(" ")
                spans.append((i, len(units), len(rest), head))
                units += rest
        found = list(map(self.new.get, units))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            strict = self.strict
            self._learn({units[i] for i in missing})
            if self.strict and not strict:
                return self.encode(texts)
            for i in missing:
                found[i] = self.new[units[i]]
        heads = iter(self._encode([s[3] for s in spans])) if self.mode != "words" else repeat(b"")
        for i, at, n, head in spans:
            out[i] = next(heads) + b"".join(found[at : at + n])
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python worker."""
    return only(("encoder", path), lambda: Encoder(path))


def slices(texts: list[str | None], most: int = 4_000_000):
    """(from, to) of runs of texts with about ``most`` characters, so that a batch of long texts is not split all at once."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
