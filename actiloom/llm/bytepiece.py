"""Byte-level BPE through a sentencepiece model that is serialised from a rank file.

A rank file lists byte strings and their ranks, the lower the earlier merged.
Every byte is mapped to a character of its own, so that each byte string is a
piece of text; the piece's score is its negative rank, and the model normalises
nothing. Merging the adjacent pair of the highest score, the leftmost of equal
ones, is then merging by ranks. A text is split by the tokenizer's pattern; a
pre-token that is itself in the vocabulary is that id, every other one is merged
by the library. Ids are decoded by the inverse mapping, each to its byte string.

Pre-tokens are remembered with their ids while a worker lives, at most ``KEPT``
of them and none beyond ``LONGEST`` characters; this changes no result.
"""

from __future__ import annotations

import base64
import struct
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actiloom.llm.frames import pick, portions

#: Distinct pre-tokens that a worker remembers.
KEPT = 250_000
#: Characters of the longest pre-token that is remembered.
LONGEST = 64
#: Where the characters that stand for bytes begin; nothing there is a space, a control or a combining mark.
FIRST_CHARACTER = 0x4E00

_VARINT, _BYTES, _FLOAT = 0, 2, 5
_BPE = 2
_NORMAL, _UNKNOWN = 1, 2


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a rank file: a base64 string and a number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def mapped(piece: bytes) -> str:
    """The characters that stand for a byte string."""
    return (np.frombuffer(piece, np.uint8).astype("<u2") + np.uint16(FIRST_CHARACTER)).tobytes().decode("utf-16-le")


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(place: int, value: int | bytes | float) -> bytes:
    """One field of a message in the protocol buffers' wire format."""
    if isinstance(value, bytes):
        return _number(place << 3 | _BYTES) + _number(len(value)) + value
    if isinstance(value, float):
        return _number(place << 3 | _FLOAT) + struct.pack("<f", value)
    return _number(place << 3 | _VARINT) + _number(value & (1 << 64) - 1)


def model_bytes(pieces: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece k + 1 is the byte string of rank k; piece 0 is the unknown one."""
    if not set(range(256)) <= {piece[0] for piece in pieces if len(piece) == 1}:
        raise ValueError("every single byte must be in the vocabulary")
    if len(pieces) >= 1 << 24:
        raise ValueError("a rank must be exact as a 32-bit float")
    message = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, _UNKNOWN))]
    for rank, piece in enumerate(pieces):
        message.append(_field(1, _field(1, mapped(piece).encode()) + _field(2, float(-rank)) + _field(3, _NORMAL)))
    # Model type, then the ids of unknown, start, end and padding; -1 is none.
    trainer = _field(3, _BPE) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    # Identity: no character map, no space put in front, none removed, none replaced.
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*message, _field(2, trainer), _field(3, normalizer)])


class Codec:
    """Encodes texts and decodes ids by one vocabulary."""

    def __init__(self, path: str, pattern: str, kept: int = KEPT) -> None:
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        # Ranks may leave gaps: pieces are numbered in their order, ids stay the file's.
        self.pieces = sorted(ranks, key=ranks.__getitem__)
        self.id_of = np.array([ranks[piece] for piece in self.pieces], np.uint32)
        self.places = {piece: k + 1 for k, piece in enumerate(self.pieces)}
        self.strings = {rank: piece for piece, rank in ranks.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.pieces))
        # White space as Unicode has it; the control characters from 0x1C to 0x1F are none.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.kept = kept
        self._start()

    def _start(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def merge(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pre-tokens, and how many each has; one in the vocabulary is its own id, another is merged."""
        data = [part.encode() for part in parts]
        own = list(map(self.places.get, data))
        rest = [piece for piece, place in zip(data, own, strict=True) if place is None]
        text = mapped(b"".join(rest))
        ends = np.cumsum([0, *map(len, rest)]).tolist()
        merged = iter(self.model.encode([text[a:b] for a, b in pairwise(ends)], num_threads=1) if rest else [])
        each = [next(merged) if place is None else (place,) for place in own]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return self.id_of[np.fromiter(chain.from_iterable(each), np.int64, int(sizes.sum())) - 1], sizes

    def _add(self, parts: list[str]) -> None:
        ids, sizes = self.merge(parts)
        n, total = len(self.known), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(parts) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + total] = ids
        self.begin[n : n + len(parts)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(parts)] = sizes
        self.known.update(zip(parts, range(n, n + len(parts)), strict=True))
        self.used += total

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        if len(self.known) > self.kept:
            self._start()
        each = [self.split(text) if text else [] for text in texts]
        parts = list(chain.from_iterable(each))
        index = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        absent = np.flatnonzero(index < 0)
        long: dict[int, np.ndarray] = {}
        if len(absent):
            new = [parts[k] for k in absent.tolist()]
            short = list(dict.fromkeys(part for part in new if len(part) <= LONGEST))
            for at in range(0, len(short), 4000):
                self._add(short[at : at + 4000])
            index[absent] = np.fromiter(map(self.known.get, new, repeat(-1)), np.int64, len(new))
            for k in np.flatnonzero(index < 0).tolist():
                long[k] = self.merge([parts[k]])[0]
        sizes = np.where(index < 0, 0, self.size[index])
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.begin[index] - (ends - sizes), sizes) + np.arange(total)]
        at = np.cumsum([0, *map(len, each)])
        places = np.concatenate([[0], ends])
        out = [ids[places[a] : places[b]] for a, b in zip(at[:-1], at[1:], strict=True)]
        for text in np.unique(np.searchsorted(at, list(long), "right") - 1).tolist() if long else []:
            out[text] = self._with_long(long, places, ids, int(at[text]), int(at[text + 1]))
        return out

    @staticmethod
    def _with_long(long: dict[int, np.ndarray], places: np.ndarray, ids: np.ndarray, first: int, last: int) -> np.ndarray:
        """The ids of the pre-tokens [first, last), among them some that are not remembered."""
        out, at = [], first
        for k in sorted(k for k in long if first <= k < last):
            out += [ids[places[at] : places[k]], long[k]]
            at = k + 1
        return np.concatenate([*out, ids[places[at] : places[last]]])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str, int], Codec] = {}


def codec(path: str, pattern: str, kept: int = KEPT) -> Codec:
    """The worker's codec for a vocabulary file and a pattern."""
    key = path, pattern, kept
    if key not in _codecs:
        _codecs[key] = Codec(path, pattern, kept)
    return _codecs[key]


def encode(docs: DataFrame, path: str, pattern: str, kept: int = KEPT) -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``ids``, the ids of the whole text as little-endian unsigned 32-bit numbers.

    A null or empty text has no ids. Strings of special tokens are ordinary
    text. Rows that repeat, or share an id, are encoded each; a null doc_id
    stays null. An empty table gives no rows. Other columns are not looked at.
    """

    def run(batches):
        for batch in portions(batches, "text", 1 << 20):
            found = codec(path, pattern, kept).encode(batch["text"].to_pylist())
            ids = pa.array([own.astype("<u4").tobytes() for own in found], pa.binary())
            yield pa.record_batch({"doc_id": batch["doc_id"], "ids": ids})

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of ``encode`` with ``decoded``, the bytes that their ids stand for; null ids stay null."""

    def run(batches):
        for batch in batches:
            own = codec(path, pattern)
            found = [None if ids is None else own.decode(np.frombuffer(ids, "<u4")) for ids in batch["ids"].to_pylist()]
            yield pa.record_batch({"doc_id": batch["doc_id"], "ids": batch["ids"], "decoded": pa.array(found, pa.binary())})

    return encoded.select(F.col("doc_id"), F.col("ids")).mapInArrow(run, "doc_id long, ids binary, decoded binary")
