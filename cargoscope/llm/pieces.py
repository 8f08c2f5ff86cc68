"""SentencePiece encoding and decoding of a merge-type (BPE) model, exactly, by backtracking.

The library merges the best-scored adjacent pair first, the leftmost of equals. The same tokens come out of a left to
right search, without any queue of merges:

* An Aho-Corasick pass over a segment gives the longest piece that starts at each position; the shorter pieces at that
  position are its prefixes, a table of the vocabulary.
* Two adjacent tokens are *compatible* if re-merging their joined characters gives the two back. A token sequence is
  the encoding exactly if all its neighbours are compatible: the first merge across a border of the whole would also
  be made when the two tokens at that border are merged alone, since merges elsewhere don't change their order.
* So a prefix of the text has one sequence at most. A position from which no piece leads on has failed whatever lies
  behind it; it is marked in a bitfield, the last token is given up, and a shorter one is tried. No position fails twice.

Only pieces that re-merge to themselves are candidates, as no other piece can be the outcome of merges. A character
that is no piece of its own stands for its UTF-8 bytes (byte fallback).

A text is cut where no piece of the vocabulary can span: before a space mark that follows another character, if no
piece holds such a pair. Segments are encoded one by one and short ones are kept, so memory is that of one chunk, or of
the longest run without a space (one integer a character and one bit for the failed positions).

Decoding is a state machine over ids: pieces give their text, runs of byte tokens are joined and read as UTF-8 (a byte
that begins no character becomes U+FFFD), control tokens give nothing, and the space mark before the first text goes.

Defined results: a null or empty text encodes to the end id alone and decodes to the empty text; rows are encoded one
by one, so repeated rows, null ids and ties between rows need no rule; an empty table gives an empty result; extra
input columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
import struct
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cargoscope.llm.common import per_row

MODEL = "piece_bpe_32k.model"
#: The mark that stands for a space inside pieces (a fixed value of the model format).
SPACE = "▁"
#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters that are cut into segments at a time.
CHUNK_CHARS = 1 << 16
#: Segments of up to so many characters are kept with their ids, in two generations of this size; so many pairs are
#: kept with their compatibility, in a table that is emptied when full.
KEPT_CHARS, KEPT_SEGMENTS, KEPT_PAIRS = 32, 400_000, 500_000

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message: integers, or the bytes of other fields."""
    at = 0

    def integer() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = integer()
        kind = key & 7
        if kind == 0:
            yield key >> 3, integer()
            continue
        size = integer() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at : at + size]
        at += size


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """The characters of ``text`` merged as the library does: best score first, the leftmost of equals."""
    parts = list(text)
    while True:
        found = [(-scores[joined], i) for i in range(len(parts) - 1) if (joined := parts[i] + parts[i + 1]) in scores]
        if not found:
            return parts
        at = min(found)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Model:
    """Pieces, scores and special ids of a model file; options this module doesn't follow are an error."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        self.types: list[int] = []
        self.scores: dict[str, float] = {}
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in _fields(raw):
            if number == 1:
                entry = dict(_fields(value))
                piece, kind = entry[1].decode(), entry.get(3, NORMAL)
                self.pieces.append(piece)
                self.types.append(kind)
                if kind == NORMAL:
                    self.scores[piece] = struct.unpack("<f", entry.get(2, b"\0\0\0\0"))[0]
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        # Field numbers of the model format (fixed values): type 3, white space as suffix 24, byte fallback 35;
        # character map 2, dummy prefix 3, extra white space removed 4, white space escaped 5, rules 6.
        known = trainer.get(3) == 2 and not trainer.get(24) and trainer.get(35) == 1
        plain = not normalizer.get(2) and not normalizer.get(6) and not normalizer.get(4, 1) and normalizer.get(5, 1)
        if not (known and plain) or {USER_DEFINED, UNUSED} & set(self.types):
            raise ValueError(f"{path} is not a merge-type model with byte fallback and identity normalisation")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.end = trainer.get(42, 2)


class Encoder:
    """Backtracking encoder over one model."""

    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.model = model
        letters = {c for p in model.scores for c in p}
        # Candidates: pieces that are their own encoding, and characters of pieces that are no pieces themselves.
        self.tokens = [p for p in model.scores if merge(p, model.scores) == [p]]
        self.tokens += sorted(letters - set(self.tokens))
        place = {t: k for k, t in enumerate(self.tokens)}
        # The last entries are those of an unknown character, -1: one character, and nothing shorter (-2).
        self.lengths = [*map(len, self.tokens), 1]
        self.shorter = [*(next((place[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in place), -2) for t in self.tokens), -2]
        self.before = [len(t) - 1 for t in self.tokens]
        self.out = [(model.ids[t],) if t in model.ids else self._bytes(t) for t in self.tokens]
        self.machine = ahocorasick.Automaton()
        for t, k in place.items():
            self.machine.add_word(t, k)
        self.machine.make_automaton()
        # Cut before a space mark that follows another character, if no piece spans such a place.
        spanned = any(SPACE in p.lstrip(SPACE) for p in model.scores)
        self.segment = re.compile("(?s).+" if spanned else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.border = None if spanned else re.compile(f"[^{SPACE}](?={SPACE})")
        self.pairs: dict[int, bool] = {}

    def _bytes(self, text: str) -> tuple[int, ...]:
        return tuple(self.model.bytes[b] for b in text.encode())

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side re-merge to themselves."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        a, b = self.tokens[left], self.tokens[right]
        found = self.pairs[left * len(self.tokens) + right] = merge(a + b, self.model.scores) == [a, b]
        return found

    def longest(self, segment: str) -> array:
        """Per position the longest token that starts there, or -1; one pass of the automaton."""
        out = array("i", [-1]) * len(segment)
        before = self.before
        for end, k in self.machine.iter(segment):
            out[end - before[k]] = k  # ends come in order, so the last one written is the longest
        return out

    def encode_segment(self, segment: str) -> list[int]:
        longest, lengths, shorter, pairs, size = self.longest(segment), self.lengths, self.shorter, self.pairs, len(self.tokens)
        failed: bytearray | None = None  # one bit a position; most segments need none
        taken: list[int] = []
        at, before, k = 0, -1, longest[0]
        while True:
            end = at + lengths[k]
            if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                # Unknown characters never merge with what is beside them.
                fits = before < 0 or k < 0 or pairs.get(before * size + k)
                if fits is None:
                    fits = self.compatible(before, k)
                if fits:
                    taken.append(k)
                    if end == len(segment):
                        break
                    at, before, k = end, k, longest[end]
                    continue
            k = shorter[k]
            while k == -2:
                # Nothing leads on from here, whatever comes before: give up the last token for a shorter one.
                if failed is None:
                    failed = bytearray(len(segment) // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                last = taken.pop()
                at -= lengths[last]
                before, k = taken[-1] if taken else -1, shorter[last]
        ids: list[int] = []
        at = 0
        for k in taken:
            ids += self.out[k] if k >= 0 else self._bytes(segment[at])
            at += lengths[k]
        return ids

    def segments(self, text: str, chunk: int = CHUNK_CHARS) -> Iterator[list[str]]:
        """The segments of a text, a chunk of it at a time."""
        if not text:
            return
        marked = (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)
        at = 0
        while at < len(marked):
            to = len(marked)
            if self.border and at + chunk < to and (found := self.border.search(marked, at + chunk)):
                to = found.end()
            yield self.segment.findall(marked, at, to)
            at = to


class Decoder:
    """Ids to text, block by block. Bytes are held back until the run of byte tokens ends or a character is complete."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.text = [p.replace(SPACE, " ") if t == NORMAL else "" for p, t in zip(model.pieces, model.types, strict=True)]
        self.unknown = " ⁇ "

    def blocks(self, ids: Iterable[list[int]], start: bool = True) -> Iterator[str]:
        """``start`` tells whether the ids begin a text, whose first space mark goes."""
        model, state = self.model, None
        strip = start and model.dummy_prefix
        for block in ids:
            out = []
            for i in block:
                if (byte := model.byte_of.get(i)) is not None:
                    state = state or codecs.getincrementaldecoder("utf-8")(_EACH_BYTE)
                    out.append(state.decode(bytes([byte])))
                    strip = False
                    continue
                if state is not None:
                    out.append(state.decode(b"", True))
                    state = None
                if model.types[i] == UNKNOWN:
                    out.append(self.unknown)
                    strip = False
                elif made := self.text[i]:
                    if strip:
                        made = made.removeprefix(" ")
                        strip = False
                    out.append(made)
            yield "".join(out)
        if state is not None:
            yield state.decode(b"", True)


_EACH_BYTE = "cargoscope-each-byte"
codecs.register_error(_EACH_BYTE, lambda e: ("�" * (e.end - e.start), e.end))


class _Segments(dict):
    """Ids in decimal of segments, filled on first use. When full, it becomes the older generation, from which segments
    that occur again come back; the older one before it goes."""

    def __init__(self, encoder: Encoder, most: int = KEPT_SEGMENTS) -> None:
        super().__init__()
        self.encoder, self.most, self.older = encoder, most, {}

    def __missing__(self, segment: str) -> str:
        made = self.older.get(segment)
        if made is None:
            made = " ".join(map(str, self.encoder.encode_segment(segment)))
        if len(segment) <= KEPT_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[segment] = made
        return made


class Coder:
    """Encoder and decoder over one model file."""

    def __init__(self, path: str) -> None:
        self.model = Model(path)
        self.encoder = Encoder(self.model)
        self.decoder = Decoder(self.model)
        self.kept = _Segments(self.encoder)
        # What an id in decimal decodes to, in bytes; only ids that the encoder gives.
        self.raw = {str(i): t.encode() for i, t in enumerate(self.decoder.text)} | {str(i): bytes([b]) for i, b in self.model.byte_of.items()}

    def encode(self, text: str, end: bool = True) -> list[int]:
        ids = [i for segments in self.encoder.segments(text) for s in segments for i in self.encoder.encode_segment(s)]
        return [*ids, self.model.end] if end else ids

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decoder.blocks([list(ids)]))

    def digests(self, text: str, chunk: int = CHUNK_CHARS) -> tuple[int, str, str]:
        """Tokens with the end id, digest of the ids in decimal and digest of the text decoded from them, a chunk at a
        time. The bytes of the ids go through the decoder's state machine; chunks end at whole characters."""
        n, ids, decoded, start = 1, hashlib.sha256(), hashlib.sha256(), self.model.dummy_prefix
        state = codecs.getincrementaldecoder("utf-8")(_EACH_BYTE)
        kept, raw = self.kept, self.raw
        for segments in self.encoder.segments(text, chunk):
            numbers = " ".join([kept[s] for s in segments])
            each = numbers.split(" ")
            n += len(each)
            ids.update((numbers + " ").encode())
            part = state.decode(b"".join([raw[i] for i in each]))
            decoded.update((part.removeprefix(" ") if start else part).encode())
            start = False
        decoded.update(state.decode(b"", True).encode())
        ids.update(str(self.model.end).encode())
        return n, ids.hexdigest(), decoded.hexdigest()


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One coder a worker process and model file."""
    return Coder(path)


def _digests(path: str):
    def start():
        made = coder(path)

        def one(row: dict):
            n, ids, decoded = made.digests(row["text"] or "")
            yield {"doc_id": row["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

        return one

    return start


def _path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    return path


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): tokens with the end id, digest of the ids in decimal, and digest of the text
    decoded from them."""
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return narrow.mapInArrow(per_row(SCHEMA, _digests(_path(path))), DDL)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the ids with the end id, as an array of 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    file = _path(path)

    def start():
        made = coder(file)
        return lambda row: iter([{"doc_id": row["doc_id"], "ids": made.encode(row["text"] or "")}])

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return narrow.mapInArrow(per_row(schema, start), "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``ids`` (doc_id, ids): the text; a null or empty array gives the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    file = _path(path)

    def start():
        made = coder(file)
        return lambda row: iter([{"doc_id": row["doc_id"], "text": made.decode(row["ids"] or [])}])

    narrow = ids.select(ids["doc_id"].cast("long").alias("doc_id"), ids["ids"].cast("array<int>").alias("ids"))
    return narrow.mapInArrow(per_row(schema, start), "doc_id long, text string")
