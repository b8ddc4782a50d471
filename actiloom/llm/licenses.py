"""License scans by conditional compression, confirmed by wording.

Candidate blocks are the places of a whole text where templates have their closest
wordings (aligned word by word, case, marks and line ends aside); what overlaps is
one block. Every template whose words the block could hold compresses it as
zstandard raw dictionary, and templates are ranked by the bytes that this takes off
the block's compressed size. Down the ranking, the first whose exact differences
confirm it, with few enough of its words missing, is the notice: none below saves
as much. Of equal reductions the one that differs in fewer words wins, then the
first by name. Its span is reported with the words that are missing and those that
are added and is cut out, and what is left on either side is searched again.
Identifiers in licence fields and expressions that are left over are blocks of
their own. ``saved`` is the share of the span's compressed bytes that the template
saves.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actiloom.llm.frames import pick, portions
from actiloom.llm.licence_forms import forms

#: Short notices by which works name their licence; ``licence_forms`` has longer ones.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "bsd-2-clause": "Released under the BSD 2-Clause License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright to this work under CC0 1.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}
MARKERS = r"licen[cs]e|licen[cs]ing|copyright|rights reserved|creative ?commons|\bcc[ -](by|0)|\bcc0\b|public domain|\b[al]?gpl(v\d)?\b|unencumbered"
_MARKER = re.compile(MARKERS, re.I)
_WORD = re.compile(r"[^\W_]+(?:[.'][^\W_]+)*")
#: An identifier of a licence, several of them, and the words before or after that make them a licence's.
_ID = r"[a-z][a-z0-9]*(?:[.+-][a-z0-9]+)*\+?"
_SEVERAL = rf"[(\"']*{_ID}(?:[)\"'\s]*[\s,/][\s(]*(?:and/or|or|and|with)[\s(\"']+{_ID})*"
FIELDS = [
    re.compile(rf"(?:\bspdx-license-identifier\s*:|\blicen[cs]es?(?:-expression)?\"?\s*[:=])\s*(?P<ids>{_SEVERAL})", re.I),
    re.compile(rf"\blicen[cs]ed under(?: either| both)?(?: of)?(?: the)?\s+(?P<ids>{_SEVERAL})", re.I),
    re.compile(rf"(?<![\w.+-])(?P<ids>{_ID})[- ]licen[cs]ed\b", re.I),
]
IDENTIFIERS = re.compile(rf"(?!(?:and|or|with)\b(?![.+-])){_ID}", re.I)
IDENTIFIER = ["spdx", "license", "identifier"]
LEVEL = 19
#: Confirmed with at most this share of a template's words missing.
TOLERANCE = 0.2


class Template:
    def __init__(self, name: str, text: str, codes: dict[str, int], needed: str = "") -> None:
        self.name, self.words = name, [w.lower() for w in _WORD.findall(text)]
        self.needed = {codes.setdefault(w, len(codes)) for w in needed.split() if w in self.words}
        self.codes = [codes.setdefault(w, len(codes)) for w in self.words]
        self.counts = Counter(self.codes)
        self.most = int(TOLERANCE * len(self.words) + 1e-9)
        self.given = zstandard.ZstdCompressionDict(" ".join(self.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)

    def possible(self, counts: Counter) -> bool:
        """Whether enough of the template's words occur at all."""
        if any(not counts[w] for w in self.needed):
            return False
        return sum(n - min(n, counts[w]) for w, n in self.counts.items()) <= self.most

    def ends(self, codes: np.ndarray) -> np.ndarray:
        """For each end of a span: differing words, missing ones and the latest start of the closest one, in one number.

        A closest span differs in no more words than the template has, so it is at
        most twice as long; longer texts are aligned in overlapping parts.
        """
        size = len(self.words)
        out = np.full(len(codes) + 1, size * (DIFFERS + MISSING) + START)
        for first in range(0, len(codes) + 1, PART):
            begin = max(0, first - 2 * size)
            part = codes[begin : first + PART - 1]
            if self.possible(Counter(part[part >= 0].tolist())):
                out[first : first + PART] = self._align(part, begin)[first - begin :]
        return out

    def _align(self, codes: np.ndarray, begin: int) -> np.ndarray:
        row = (START - begin - np.arange(len(codes) + 1)).astype(np.int64)
        across = np.arange(len(codes) + 1) * DIFFERS
        for code in self.codes:
            below = row + DIFFERS + MISSING
            np.minimum(below[1:], np.where(codes == code, row[:-1], row[:-1] + DIFFERS + MISSING), out=below[1:])
            row = np.minimum.accumulate(below - across) + across
        return row


#: Parts of the number that an alignment minimises: words that differ, words missing, START less the start.
DIFFERS, MISSING, START = 1 << 47, 1 << 32, (1 << 32) - 1
#: Words of a text that are aligned at a time.
PART = 8192


class Matcher:
    def __init__(self, templates: dict[str, str] | None = None) -> None:
        self.codes: dict[str, int] = {}
        given = [(name, text, "") for name, text in (TEMPLATES if templates is None else templates).items()]
        given += forms() if templates is None else []
        self.templates = [Template(name, text, self.codes, needed) for name, text, needed in sorted(given)]
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        self.given: dict[int, zstandard.ZstdCompressor] = {}
        self.sizes = lru_cache(20_000)(self._sizes)
        self.identifier = [self.codes.get(w, -1) for w in IDENTIFIER]

    def _sizes(self, place: int, block: str) -> tuple[int, int]:
        """Compressed bytes of a block of words, alone and with a template as dictionary."""
        if place not in self.given:
            self.given[place] = zstandard.ZstdCompressor(level=LEVEL, dict_data=self.templates[place].given)
        raw = block.encode("utf-8", "surrogatepass")
        return len(self.alone.compress(raw)), len(self.given[place].compress(raw))

    def reduction(self, place: int, words: list[str]) -> int:
        """Bytes that a template as dictionary takes off the compressed size of a block."""
        alone, given = self.sizes(place, " ".join(words))
        return alone - given

    def notices(self, text: str | None) -> list[tuple]:
        """Span of characters, name, share saved, missing and added words of each notice, in order."""
        if not text or not _MARKER.search(text):
            return []
        places = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in places]
        codes = np.array([self.codes.get(w, -1) for w in words], np.int64)
        # Words over which each marker lies.
        starts, ends = (np.array(x, np.int64) for x in zip(*places, strict=True)) if places else (np.zeros(0, np.int64),) * 2
        markers = [(int(np.searchsorted(ends, m.start(), "right")), int(np.searchsorted(starts, m.end()))) for m in _MARKER.finditer(text)]
        held = self._named(FIELDS[0], text, starts, ends, words, codes, [])
        open_parts = _between(held, 0, len(words))
        while open_parts:
            low, high = open_parts.pop()
            found = []
            for begin, end in self._blocks(codes, markers, low, high):
                found += self._winner(codes, words, markers, begin, end)
            if found:
                held += found
                open_parts += _between(sorted(found), low, high)
        for field in FIELDS[1:]:
            held += self._named(field, text, starts, ends, words, codes, sorted(held))
        out = []
        for begin, end, place in held:
            first, last = places[begin][0], places[end - 1][1]
            last += text[last : last + 1] in (".", "!", "?", ";", ":")
            template, (alone, given) = self.templates[place], self.sizes(place, " ".join(words[begin:end]))
            out.append((first, last, template.name, 1 - given / alone, *differences(template.words, words[begin:end])))
        return sorted(out)

    def _closest(self, template: Template, codes: np.ndarray, markers: list[tuple[int, int]], low: int, high: int) -> tuple[int, list[tuple[int, int]]]:
        """Differing words and places of a template's closest spans between two words that lack few enough of its words."""
        part, row = codes[low:high], template.ends(codes[low:high])
        differing, missing = row // DIFFERS, row % DIFFERS // MISSING
        start = START - row % MISSING
        ends = np.flatnonzero(missing <= template.most)
        for least in np.unique(differing[ends]).tolist():
            # Of a start's ends the last: a replaced last word belongs to the span.
            last = {int(start[end]): int(end) for end in ends[differing[ends] == least]}
            spans, until = [], 0
            for begin, end in sorted(last.items(), key=lambda x: x[1]):
                named = template.needed <= set(part[begin:end].tolist())
                if begin >= until and end > begin and named and _holds(markers, low + begin, low + end):
                    spans.append((low + begin, low + end))
                    until = end
            if spans:
                return least, spans
        return 0, []

    def _possible(self, codes: np.ndarray) -> list[int]:
        """Templates that could be confirmed in a block: no other has enough of its words there."""
        counts = Counter(codes[codes >= 0].tolist())
        return [place for place, template in enumerate(self.templates) if template.possible(counts)]

    def _blocks(self, codes: np.ndarray, markers: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
        """Candidate blocks of words: closest spans of all templates, those that overlap as one."""
        spans = set()
        for place in self._possible(codes[low:high]):
            spans.update(self._closest(self.templates[place], codes, markers, low, high)[1])
        blocks: list[tuple[int, int]] = []
        for begin, end in sorted(spans):
            if blocks and begin < blocks[-1][1]:
                blocks[-1] = (blocks[-1][0], max(end, blocks[-1][1]))
            else:
                blocks.append((begin, end))
        return blocks

    def _winner(self, codes: np.ndarray, words: list[str], markers: list[tuple[int, int]], begin: int, end: int) -> list[tuple[int, int, int]]:
        """Spans of the template that compression ranks highest among those that wording confirms, and its place."""
        ranked = [(self.reduction(place, words[begin:end]), place) for place in self._possible(codes[begin:end])]
        ranked = sorted((x for x in ranked if x[0] > 0), key=lambda x: (-x[0], x[1]))
        for _, equal in groupby(ranked, key=lambda x: x[0]):
            confirmed = []
            for _, place in equal:
                least, spans = self._closest(self.templates[place], codes, markers, begin, end)
                if spans:
                    confirmed.append((least, place, spans))
            if confirmed:
                _, place, spans = min(confirmed)
                return [(*span, place) for span in spans]
        return []

    def _named(
        self, field: re.Pattern, text: str, starts: np.ndarray, ends: np.ndarray, words: list[str], codes: np.ndarray, held: list[tuple]
    ) -> list[tuple[int, int, int]]:
        """Identifiers in a field or expression outside of the spans held, each as a block behind the usual field name.

        The words of the field belong to the span of the first identifier.
        """

        def within(low: int, high: int) -> tuple[int, int]:
            return int(np.searchsorted(ends, low, "right")), int(np.searchsorted(starts, high))

        out, begins = [], [x[0] for x in held]
        for match in field.finditer(text):
            around = [match.start(), match.end() if match.end() > match.end("ids") else 0]
            for each in IDENTIFIERS.finditer(text, *match.span("ids")):
                begin, end = within(*each.span())
                if begin == end or _meets(held, begins, begin, end):
                    continue
                said = [*IDENTIFIER, *words[begin:end]]
                found = self._winner(np.concatenate([self.identifier, codes[begin:end]]), said, [(0, len(said))], 0, len(said))
                if found:
                    whole = within(min(each.start(), around[0]), max(each.end(), around[1]))
                    first = each.start() == match.start("ids") or not text[match.start("ids") : each.start()].strip("(\"' ")
                    span = whole if first and not _meets(held, begins, *whole) else (begin, end)
                    out.append((*span, found[0][2]))
        return out


def _between(spans: list[tuple], low: int, high: int) -> list[tuple[int, int]]:
    """What lies between two words beside some spans in order."""
    return list(zip([low, *(x[1] for x in spans)], [*(x[0] for x in spans), high], strict=True))


def _holds(markers: list[tuple[int, int]], begin: int, end: int) -> bool:
    """Whether a marker lies wholly between two words; markers are in order and do not overlap."""
    at = bisect_left(markers, (begin, begin))
    return at < len(markers) and markers[at][1] <= end


def _meets(held: list[tuple], begins: list[int], begin: int, end: int) -> bool:
    """Whether a span meets one of those held, which are in order and do not overlap."""
    at = bisect_left(begins, end)
    return at > 0 and held[at - 1][1] > begin


def differences(template: list[str], words: list[str]) -> tuple[list[str], list[str]]:
    """Words of the template that the span lacks, and words that it adds, in order, of the fewest differing words."""
    told = {w: k for k, w in enumerate(dict.fromkeys(template))}
    codes = np.array([told.get(w, -1) for w in words], np.int64)
    across = np.arange(len(words) + 1) * DIFFERS
    row, steps = across, []
    for word in template:
        same = codes == told[word]
        below = row + DIFFERS + MISSING
        step = np.zeros(len(row), np.uint8)
        beside = np.where(same, row[:-1], row[:-1] + DIFFERS + MISSING)
        step[1:][beside <= below[1:]] = 1
        np.minimum(below[1:], beside, out=below[1:])
        row = np.minimum.accumulate(below - across) + across
        step[row < below] = 2
        steps.append(step)
    missing, added = [], []
    i, j = len(template), len(words)
    while i or j:
        step = steps[i - 1][j] if i else 2
        if step == 1 and template[i - 1] == words[j - 1]:
            pass
        else:
            if step != 2:
                missing.append(template[i - 1])
            if step:
                added.append(words[j - 1])
        i, j = i - (step != 2), j - (step > 0)
    return missing[::-1], added[::-1]


ROWS = "doc_id long, first long, last long, template string, saved double, missing array<string>, added array<string>"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each confirmed notice: ``doc_id``, span of characters, ``template``, ``saved``, ``missing``, ``added``.

    Whole texts are searched, across sentences and lines; a span without a marker
    is none, nor does a null or empty text give any. Spans of a text do not
    overlap. Equal rows give equal notices each; of templates that reduce a block
    by as many bytes the one that differs in fewer words wins, then the first by
    name. An empty table gives no rows; other columns are not looked at. Unless
    templates are given, the short notices and the forms of ``licence_forms`` are
    searched for.
    """

    def search(batches):
        matcher = Matcher(templates)
        for batch in portions(batches, "text"):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                rows += ((doc_id, *found) for found in matcher.notices(text))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]
                names = ["doc_id", "first", "last", "template", "saved", "missing", "added"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # Spark drops the texts without any marker before they reach Python.
    marked = pick(docs, "doc_id", "text").filter(F.col("text").rlike("(?i)" + MARKERS))
    return marked.mapInArrow(search, ROWS)
