"""Quality rules from tokeniser fertility.

Each text is cut into words, every word is encoded with a public piece vocabulary, and the text is judged by three
figures: characters per token, the share of byte-fallback tokens, and the entropy of its tokens. A band of accepted
values per script (the script most of the text's letters are written in) decides, with an entropy floor of its own.
Texts that fail the plain base rule (too few words, or too many words inside repeated 5-word windows) are rejected
before the bands are looked at.

Defined results: a null or empty text has no words, so ``base_failed`` is true and ``kept`` false; rows are judged one
by one, so repeated rows and null ids pass through with the same verdict; an empty table gives an empty result; extra
input columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cargoscope.llm.common import per_row

TOKENIZER = "piece_bpe_32k.model"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Words kept with their tokens per task. When full it is emptied, so memory stays bounded on any input.
CACHE_WORDS = 400_000

# Accepted bands per script: (lowest and highest characters per token, highest byte-fallback share), measured on clean
# prose with room on both sides. The vocabulary splits Latin and Cyrillic into sub-words (prose: 1.5 to 4.2 characters
# per token; hexadecimal, base64 and digits lie below 1.25), Vietnamese partly, most others into letters (0.7 to 0.95),
# and what it lacks, points and rare letters among it, into bytes.
BANDS = {
    "latin": (1.25, 6.0, 0.10),
    "vietnamese": (0.95, 4.0, 0.15),
    "cyrillic": (1.0, 6.0, 0.15),
    "greek": (0.45, 1.6, 0.50),
    "hebrew": (0.45, 1.6, 0.65),
    "arabic": (0.45, 1.8, 0.50),
    "indic": (0.40, 1.6, 0.50),
    "thai": (0.50, 1.6, 0.25),
    "hangul": (0.40, 1.6, 0.40),
    "cjk": (0.35, 2.0, 0.60),
    "other": (0.20, 2.0, 1.00),
}
# Lowest accepted token entropy in bits at a token count, straight lines between in log2 of the count, per script. A
# text of n tokens can't exceed log2(n) bits, so short texts get a lower floor. Below the first count there is no floor,
# beyond the last it stays. Letters of an alphabet reach 4 to 4.8 bits in prose of any length, syllables 5 to 5.6.
_LETTERS = ((32, 2.8), (64, 3.1), (128, 3.4), (256, 3.6), (512, 3.7))
_PARTLY = ((32, 3.0), (64, 4.2), (128, 4.8), (256, 5.1), (512, 5.3))
ENTROPY_FLOORS = {
    "latin": ((32, 3.0), (64, 4.2), (128, 5.2), (256, 5.75), (512, 6.1), (1024, 6.3), (4096, 6.45)),
    "vietnamese": _PARTLY,
    "cyrillic": _PARTLY,
    "greek": _LETTERS,
    "hebrew": _LETTERS,
    "arabic": _LETTERS,
    "indic": ((32, 2.9), (64, 3.3), (128, 3.6), (256, 3.8), (512, 3.9)),
    "thai": ((32, 3.3), (64, 3.8), (128, 4.2), (256, 4.4), (512, 4.5)),
    "hangul": ((32, 3.3), (64, 3.9), (128, 4.4), (256, 4.7), (512, 4.8)),
    "cjk": ((32, 3.3), (64, 4.2), (128, 4.7), (256, 5.0), (512, 5.2)),
    "other": ((32, 2.4), (64, 2.8), (128, 3.1), (256, 3.3), (512, 3.4)),
}
# Code points by script; letters of no range are ``other``, whose floor also fits texts that fall back to bytes.
RANGES = (
    ("latin", 0x41, 0x250), ("latin", 0x1E00, 0x1EA0), ("vietnamese", 0x1EA0, 0x1F00), ("greek", 0x370, 0x400), ("greek", 0x1F00, 0x2000),
    ("cyrillic", 0x400, 0x530), ("hebrew", 0x590, 0x600), ("hebrew", 0xFB1D, 0xFB50), ("arabic", 0x600, 0x700), ("arabic", 0x750, 0x780),
    ("arabic", 0x8A0, 0x900), ("arabic", 0xFB50, 0xFE00), ("arabic", 0xFE70, 0xFF00), ("indic", 0x900, 0xA00), ("indic", 0xB80, 0xC00),
    ("thai", 0xE00, 0xE80), ("hangul", 0x1100, 0x1200), ("hangul", 0x3130, 0x3190), ("hangul", 0xAC00, 0xD7B0), ("cjk", 0x2E80, 0x3130),
    ("cjk", 0x3190, 0xA000), ("cjk", 0xF900, 0xFB00), ("cjk", 0x20000, 0x32000),
)
#: Latin text is taken as Vietnamese from this share of letters that only its alphabet has, in percent.
VIETNAMESE_PERCENT = 5

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
        ("script", pa.string()),
        ("n_tokens", pa.int64()),
        ("chars_per_token", pa.float64()),
        ("fallback_share", pa.float64()),
        ("token_entropy", pa.float64()),
    ]
)
DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, script string, n_tokens long, chars_per_token double, "
    "fallback_share double, token_entropy double"
)

_ASCII_LETTER = re.compile("[A-Za-z]")
_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
#: Bytes that start a code point and aren't white space.
_STARTS = ((_BYTES & 0xC0) != 0x80) & ~_SPACE
_SYMBOL = np.isin(_BYTES, list(b"#*$%&|<>"))


def entropy_floor(n_tokens: int, script: str) -> float:
    points = ENTROPY_FLOORS[script]
    if n_tokens < points[0][0]:
        return 0.0
    return float(np.interp(math.log2(n_tokens), [math.log2(n) for n, _ in points], [h for _, h in points]))


@lru_cache(maxsize=1 << 16)
def _script_of_letter(char: str) -> str:
    point = ord(char)
    return next((name for name, low, high in RANGES if low <= point < high), "other")


def script_of(text: str) -> str:
    """The script of most letters; ``other`` if there is none."""
    if text.isascii():
        return "latin" if _ASCII_LETTER.search(text) else "other"
    found: Counter = Counter()
    for char, n in Counter(text).items():
        if char.isalpha():
            found[_script_of_letter(char)] += n
    marked = found.pop("vietnamese", 0)
    if marked:
        found["latin"] += marked
    script = min(found, key=lambda s: (-found[s], s)) if found else "other"
    return "vietnamese" if script == "latin" and 100 * marked >= VIETNAMESE_PERCENT * found["latin"] else script


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 5-word window found twice or more in the text, the first place included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mix = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        mix = mix * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        mix ^= mix >> np.uint64(29)
    order = np.argsort(mix, kind="stable")
    ranked = mix[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


class Fertility:
    """Token figures of a list of words. Words repeat, so each is encoded once while it stays in the cache."""

    def __init__(self, model_file: str, cache_words: int = CACHE_WORDS) -> None:
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.is_byte = np.array([self.pieces.is_byte(i) or self.pieces.is_unknown(i) for i in range(self.pieces.get_piece_size())])
        self.cache: dict[bytes, list[int]] = {}
        self.cache_words = cache_words

    def figures(self, words: list[bytes], chars: int) -> tuple[int, float, float, float]:
        """Tokens, characters per token, byte-fallback share, token entropy in bits."""
        counts = Counter(words)
        cache = self.cache
        missing = [w for w in counts if w not in cache]
        if missing:
            if len(cache) + len(missing) > self.cache_words:
                cache.clear()
                missing = list(counts)
            cache.update(zip(missing, self.pieces.encode([w.decode("utf-8", "replace") for w in missing], num_threads=1), strict=True))
        found = [cache[w] for w in counts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        if not len(flat):
            return 0, 0.0, 0.0, 0.0
        weights = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), sizes)
        total = int(weights.sum())
        by_token = np.bincount(flat, weights)
        share = by_token[by_token > 0] / total
        entropy = float(-(share * np.log2(share)).sum())
        return total, chars / total, float(weights[self.is_byte[flat]].sum() / total), max(0.0, entropy)


def judge(script: str, n_tokens: int, chars_per_token: float, fallback_share: float, entropy: float) -> bool:
    low, high, most_fallback = BANDS[script]
    return n_tokens > 0 and low <= chars_per_token <= high and fallback_share <= most_fallback and entropy >= entropy_floor(n_tokens, script)


def _verdicts(model_file: str):
    def start():
        fertility = Fertility(model_file)

        def one(row: dict):
            text = row["text"] or ""
            raw = text.encode()
            data = np.frombuffer(raw, np.uint8)
            words = raw.split()
            word_chars = int(_STARTS[data].sum())
            repeats = repeat_words(words)
            base_failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
            script = script_of(text)
            figures = fertility.figures(words, word_chars)
            yield {
                "doc_id": row["doc_id"],
                "n_words": len(words),
                "word_chars": word_chars,
                "n_symbols": int(_SYMBOL[data].sum()),
                "n_dup_lines": duplicate_lines(raw),
                "n_repeat_words": repeats,
                "base_failed": base_failed,
                "kept": not base_failed and judge(script, *figures),
                "script": script,
                "n_tokens": figures[0],
                "chars_per_token": figures[1],
                "fallback_share": figures[2],
                "token_entropy": figures[3],
            }

        return one

    return start


def quality(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """One verdict per row of ``docs`` (doc_id, text); ``model_file``: a sentencepiece model on every node."""
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path(TOKENIZER)
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return narrow.mapInArrow(per_row(SCHEMA, _verdicts(model_file)), DDL)


def accepted(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; the verdict is made in the same pass over the text."""
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path(TOKENIZER)
    at = docs.columns.index("text")

    def keep(batches):
        verdict = _verdicts(model_file)()
        for batch in batches:
            texts = batch.column(at)
            mask = [next(verdict({"doc_id": None, "text": texts[i].as_py()}))["kept"] for i in range(batch.num_rows)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
