"""Token ids of whole texts, each distinct word encoded once by the tokenizers library.

A tokenizer that splits at white space before it merges encodes a text as the
chain of its parts. ``DROPPED``: white space separates words and leaves no ids.
``LEADING``: a space opens the word behind it, so a text may be cut before a
space that has no white space on either side. ``None``: texts are not cut.

Normalising, splitting into units and merging are the library's; a worker only
remembers the ids of the parts and units that it has met.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

DROPPED, LEADING = "dropped", "leading"
#: Distinct parts, and distinct units, that are remembered; with more, the parts that came once and all units go.
KEPT = 900_000
#: Before the first word of a text, which has no space in front.
_FIRST = "\0"
_SPACE = re.compile(" ")
_OTHER = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Encoder:
    def __init__(self, path: str, cut: str | None, kept: int = KEPT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cut = cut
        self.kept = kept
        self.plain = re.compile(r"\S+" if cut == DROPPED else r"[^\s\0]\S*(?:\n\S+)*")
        self.units: dict[str, bytes] = {}  # ids as unsigned 32-bit numbers
        self._start()

    def _start(self) -> None:
        self.known: dict[str, int] = {}  # parts in the order of their numbers
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)  # met in a later call too
        self.used = 0

    def _forget(self) -> None:
        """Keeps the parts that came again, if they leave half of the memory free."""
        stay = np.flatnonzero(self.again[: len(self.known)])
        if len(stay) > self.kept // 2:
            stay = stay[:0]
        names = [part for part, again in zip(self.known, self.again.tolist(), strict=False) if again] if len(stay) else []
        sizes = self.size[stay]
        begin = np.cumsum(sizes) - sizes
        flat = self.ids[np.repeat(self.begin[stay] - begin, sizes) + np.arange(int(sizes.sum()))]
        self._start()
        self._add(names, flat, begin)

    def _parts(self, text: str) -> list[str]:
        if self.cut == DROPPED:
            return text.replace("\n", " ").split(" ")
        if self.cut is None or _FIRST in text:
            return [_FIRST + text]
        words = text.split(" ")
        if "  " in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or _OTHER.search(text):
            out = [_FIRST + words[0]]
            for word in words[1:]:
                if not out[-1][-1].isspace() and out[-1] != _FIRST and word and not word[0].isspace():
                    out.append(word)
                else:
                    out[-1] += " " + word
            return out
        words[0] = _FIRST + words[0]
        return words

    def _learn(self, parts: list[str]) -> None:
        plain = list(filter(self.plain.fullmatch, parts)) if self.cut else []
        for at in range(0, len(plain), 4000):
            self._learn_plain(plain[at : at + 4000])
        rest = [part for part in parts if part not in self.known]
        for part in rest:
            text = part if self.cut == DROPPED else part[1:] if part[0] == _FIRST else " " + part
            self._add([part], self.tokenizer.encode(text, add_special_tokens=False).ids, [0])

    def _learn_plain(self, parts: list[str]) -> None:
        """Parts without white space at their ends are split into units together; each unit is merged once."""
        text = " ".join(parts)
        text = " " + text if self.cut == LEADING else text
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        starts = [m.start() for m in _SPACE.finditer(text)]
        starts = starts if self.cut == LEADING else [0, *starts]
        if len(starts) != len(parts):  # white space came or went: each by itself
            return
        if len(self.units) > self.kept:
            self.units = {}
        units = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        names = [unit for unit, _ in units]
        merge = self.tokenizer.model.tokenize
        for unit in {*names}.difference(self.units):
            self.units[unit] = array("I", [token.id for token in merge(unit)]).tobytes()
        ids = list(map(self.units.__getitem__, names))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        places = np.fromiter((place[0] for _, place in units), np.int64, len(units))
        begin = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(places, starts)]
        self._add(parts, np.frombuffer(b"".join(ids), np.uint32), begin)

    def _add(self, parts: list[str], flat: list[int] | np.ndarray, begin) -> None:
        n = len(self.known)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(parts) > len(self.begin):
            self.begin, self.size, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.again))
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[n : n + len(parts)] = np.asarray(begin) + self.used
        self.size[n : n + len(parts)] = np.diff(begin, append=len(flat))
        self.known.update(zip(parts, range(n, n + len(parts)), strict=True))
        self.used += len(flat)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 offsets of the texts in them; null is empty."""
        if len(self.known) > self.kept:
            self._forget()
        each = [self._parts(text) if text else [] for text in texts]
        parts = list(chain.from_iterable(each))
        index = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        absent = np.flatnonzero(index < 0)
        self.again[index[index >= 0]] = True
        if len(absent):
            new = [parts[k] for k in absent.tolist()]
            self._learn(list(dict.fromkeys(new)))
            index[absent] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        sizes = self.size[index]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.begin[index] - (ends - sizes), sizes) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[np.cumsum([0, *map(len, each)])]


_encoders: dict[tuple[str, str | None, int], Encoder] = {}


def encoder(path: str, cut: str | None, kept: int = KEPT) -> Encoder:
    """The worker's encoder for a tokenizer file, which remembers about ``kept`` parts and units."""
    key = path, cut, kept
    if key not in _encoders:
        _encoders[key] = Encoder(path, cut, kept)
    return _encoders[key]


def release() -> None:
    """Gives back what earlier tasks of this worker remembered; for tasks that need the memory."""
    _encoders.clear()
    pa.default_memory_pool().release_unused()
