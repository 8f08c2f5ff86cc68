"""Byte-level BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding reads bytes and emits tokens as soon as they can no longer change. How far ahead one must look follows from
the merge list alone (:func:`sufficient_lookahead`): a merge can only be disturbed from the right by an earlier-ranked
merge that takes one of the tokens on its right edge, which in turn can only be disturbed by a still earlier one, so
the chains are finite and their longest reach is a constant of the vocabulary. A run of any length is then encoded
with a window of constant size: tokens that end at least that far before the window's end are final, and the rest of
the run is encoded afresh from the last final boundary.

Decoding feeds the tokens' bytes to an incremental UTF-8 state machine, block by block; bytes that form no character
become U+FFFD, as in the public library.

Defined results: a null or empty text has no tokens and decodes to the empty text; rows are encoded one by one, so
repeated rows, null ids and ties need no rule; an empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cargoscope.llm.common import per_row

TOKENIZER = "byte_bpe_50k.json"
#: Pre-token rule of the public byte-level vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text that are cut into pre-tokens at a time.
CHUNK_CHARS = 1 << 16
#: Short runs kept with their tokens per task; emptied when full.
CACHE_RUNS = 300_000
#: Runs of up to this many bytes are encoded in one window.
WINDOW_BYTES = 4096
DECODE_TOKENS = 1 << 15

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files: printable Latin-1 stands for itself, the
    other bytes take the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes beyond a token's end that can still change it, for merges in rank order.

    ``reach[t]`` is how far beyond ``t``'s end the merges seen so far that take ``t`` on their left can depend: the
    length of the partner plus the partner's own reach. ``edge[t]`` covers the tokens on the right edge inside ``t``,
    which only merges ranked before ``t``'s own could have taken. One pass in rank order fills both.
    """
    reach: dict[bytes, int] = {}
    edge: dict[bytes, int] = {}
    for left, right in merges:
        inner = max(edge.get(right, 0), reach.get(right, 0))
        reach[left] = max(reach.get(left, 0), len(right) + inner)
        made = left + right
        edge[made] = max(edge.get(made, 0), inner)
    return max([0, *(reach.get(t, 0) for t in reach), *edge.values()])


class Vocabulary:
    """Ranks and token bytes of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {to_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = [(to_bytes(a), to_bytes(b)) for a, b in pairs]
        self.lookahead = sufficient_lookahead(self.merges)
        self.tokens: dict[int, bytes] = {i: t for t, i in self.ids.items()}
        self.tokens.update({i: t.encode() for t, i in self.special.items()})
        # Merges on ids: (left, right) -> (rank, merged id)
        self.pairs = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in reversed(list(enumerate(self.merges)))}
        self.ranks = {pair: rank for pair, (rank, _) in self.pairs.items()}
        self.made = [self.ids[a + b] for a, b in self.merges]
        self.single = [self.ids[bytes([b])] for b in range(256)]


def merge_window(run: bytes, vocabulary: Vocabulary) -> list[int]:
    """Tokens of a window: the lowest-ranked adjacent pair is merged first, the leftmost of equals."""
    ids = [vocabulary.single[b] for b in run]
    if len(ids) >= 100:
        return _merge_long(ids, vocabulary.pairs)
    none, of, made = len(vocabulary.made), vocabulary.ranks.get, vocabulary.made
    ranks = [of(pair, none) for pair in zip(ids, ids[1:])]
    while ranks and (lowest := min(ranks)) != none:
        i = ranks.index(lowest)
        ids[i : i + 2] = [new := made[lowest]]
        del ranks[i]
        if i:
            ranks[i - 1] = of((ids[i - 1], new), none)
        if i < len(ranks):
            ranks[i] = of((new, ids[i + 1]), none)
    return ids


def _merge_long(ids: list[int], pairs: dict) -> list[int]:
    """The same with a heap over a linked list, for long windows."""
    import heapq

    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := pairs.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        j = after[i] if i < n else n
        if j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], ids[j] = made, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            if found := pairs.get((made, ids[after[i]])):
                heapq.heappush(heap, (found[0], i, made, ids[after[i]], found[1]))
        if (p := before[i]) >= 0 and (found := pairs.get((ids[p], made))):
            heapq.heappush(heap, (found[0], p, ids[p], made, found[1]))
    return [t for t in ids if t >= 0]


def stream_run(run: bytes, vocabulary: Vocabulary, window: int = WINDOW_BYTES) -> Iterator[list[int]]:
    """Tokens of one run of bytes, in blocks, each emitted once it is stable; memory is that of one window."""
    at, size = 0, max(window, 2 * vocabulary.lookahead + 2)
    while at < len(run):
        ids = merge_window(run[at : at + size], vocabulary)
        if at + size >= len(run):
            yield ids
            return
        final, taken = 0, 0
        for token in ids:
            if taken + len(vocabulary.tokens[token]) > size - vocabulary.lookahead:
                break
            taken += len(vocabulary.tokens[token])
            final += 1
        if final:
            yield ids[:final]
            at += taken
        else:
            size *= 2


class _Runs(dict):
    """Packed ids of runs, filled on first use and emptied when full."""

    def __init__(self, vocabulary: Vocabulary, most: int) -> None:
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, run: str) -> bytes:
        raw = run.encode()
        if len(raw) > WINDOW_BYTES:
            return b"".join(np.array(ids, "<u4").tobytes() for ids in stream_run(raw, self.vocabulary))
        ids = merge_window(raw, self.vocabulary)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[run] = packed
        return packed


class Transducer:
    """Streaming encoder and decoder over one vocabulary file."""

    def __init__(self, path: str, cache_runs: int = CACHE_RUNS, chunk_chars: int = CHUNK_CHARS) -> None:
        self.vocabulary = Vocabulary(path)
        self.runs = _Runs(self.vocabulary, cache_runs)
        self.chunk = chunk_chars
        self.pattern = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.vocabulary.special, key=len, reverse=True))) or r"(?!)")

    def pieces(self, text: str, start: int, end: int) -> Iterator[list[str]]:
        """Pre-tokens of ``text[start:end]``, a chunk at a time.

        A chunk ends just before white space that follows a character of another kind: no pre-token spans that place
        and none looks across it. A run without such a place is taken whole; its bytes are streamed below.
        """
        at = start
        while at < end:
            to = end
            if at + self.chunk < end:
                found = _BOUNDARY.search(text, at + self.chunk, end)
                to = found.end() if found else end
            yield self.pattern.findall(text, at, to)
            at = to

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed little-endian 32-bit ids, in blocks."""
        at = 0
        for found in self.specials.finditer(text):
            yield from self._plain(text, at, found.start())
            yield np.array([self.vocabulary.special[found.group()]], "<u4").tobytes()
            at = found.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, start: int, end: int) -> Iterator[bytes]:
        runs = self.runs
        for pieces in self.pieces(text, start, end):
            yield b"".join([runs[p] for p in pieces])

    def decode(self, blocks: Iterator[bytes]) -> Iterator[str]:
        """Text of packed ids, in blocks; a character may span tokens and blocks."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        tokens = self.vocabulary.tokens
        for block in blocks:
            ids = np.frombuffer(block, "<u4")
            for at in range(0, len(ids), DECODE_TOKENS):
                yield state.decode(b"".join([tokens[i] for i in ids[at : at + DECODE_TOKENS].tolist()]))
        yield state.decode(b"", True)


_BOUNDARY = regex.compile(r"\S(?=\s)")


def _digests(path: str):
    def start():
        transducer = Transducer(path)

        def one(row: dict):
            ids, text, n = hashlib.sha256(), hashlib.sha256(), 0

            def blocks():
                nonlocal n
                for block in transducer.encode(row["text"] or ""):
                    ids.update(block)
                    n += len(block) // 4
                    yield block

            for part in transducer.decode(blocks()):
                text.update(part.encode())
            yield {"doc_id": row["doc_id"], "n_tokens": n, "ids_sha256": ids.hexdigest(), "decoded_sha256": text.hexdigest()}

        return one

    return start


def _path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return path


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): tokens, digest of the ids and digest of the text decoded from them."""
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return narrow.mapInArrow(per_row(SCHEMA, _digests(_path(path))), DDL)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the ids themselves, as an array of 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    file = _path(path)

    def start():
        transducer = Transducer(file)
        return lambda row: iter([{"doc_id": row["doc_id"], "ids": np.frombuffer(b"".join(transducer.encode(row["text"] or "")), "<u4").astype("i4").tolist()}])

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return narrow.mapInArrow(per_row(schema, start), "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``ids`` (doc_id, ids): the text, by the incremental byte-to-text state machine."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    file = _path(path)

    def start():
        transducer = Transducer(file)
        return lambda row: iter([{"doc_id": row["doc_id"], "text": "".join(transducer.decode(iter([np.array(row["ids"] or [], "<u4").tobytes()])))}])

    narrow = ids.select(ids["doc_id"].cast("long").alias("doc_id"), ids["ids"].cast("array<int>").alias("ids"))
    return narrow.mapInArrow(per_row(schema, start), "doc_id long, text string")
