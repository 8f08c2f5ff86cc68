"""SentencePiece encoding and decoding against the public library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from cargoscope.llm import pieces

PATH = public_tokenizers.path(pieces.MODEL)
HARD = [
    "", " ", "  ", "a", " a", "a ", "\n", "\t\n a", "a\x00b", "▁", "▁▁ a▁", "<s>", "</s><unk>", "<0x0A> <0xFF>", "日本語のテキスト、句読点。", "👩‍👩‍👧 x",
    "é é", " " * 1000 + "x", "a" * 5000, "　全角", "x" + " " * 15 + "y" + " " * 31, "\U0010ffff", "สวัสดีชาวโลก", "مرحبا بالعالم", "   ", "�", "﻿x",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return pieces.coder(PATH)


def texts():
    rng = random.Random(1)
    vocabulary = [p for p in pieces.coder(PATH).model.pieces if len(p) > 1]
    some = " ▁ aeinrstthé\n.,<>0x日本\U0001f600　"
    yield from HARD
    for _ in range(1500):
        yield "".join(rng.choice(some) for _ in range(rng.randint(1, 60)))
        yield "".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))
        yield " " * rng.randint(1, 80) + "".join(rng.choice("abc ") for _ in range(20))


def test_encoding_equals_library(library, coder):
    for text in texts():
        want = library.encode(text, add_eos=True)
        assert coder.encode(text) == want, text
        assert coder.decode(want) == library.decode(want), text


def test_decoding_of_any_ids_equals_library(library, coder):
    rng = random.Random(4)
    for _ in range(6000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(259), rng.randrange(131, 259), 0, 1, 2, 259]) for _ in range(rng.randint(0, 7))]
        assert coder.decode(ids) == library.decode(ids), ids


def test_chunks_and_full_tables_change_nothing(library, coder, monkeypatch):
    """Chunks of a few characters, and tables of kept segments and pairs that fill up at once."""
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 3)
    small = pieces.Coder(PATH)
    small.kept.most = 2
    for text in [*HARD, "The  quick\nbrown fox, " * 40]:
        ids = library.encode(text, add_eos=True)
        want = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert small.digests(text, chunk=3) == coder.digests(text) == want


def test_backtracking_gives_up_tokens(coder):
    """The longest piece first is wrong for many words; failed positions and shorter pieces find the encoding."""
    encoder, rng, wrong = coder.encoder, random.Random(6), 0
    vocabulary = [p for p in coder.model.scores if p.isalpha()]
    words = ["▁" + "".join(rng.choice(vocabulary) for _ in range(3)) for _ in range(300)] + ["▁▁▁▁word", "▁" + "a" * 30]
    for word in words:
        greedy, at, longest = [], 0, encoder.longest(word)
        while at < len(word):
            greedy += encoder.out[longest[at]]
            at += encoder.lengths[longest[at]]
        wrong += greedy != encoder.encode_segment(word)
        assert [coder.model.pieces[i] for i in encoder.encode_segment(word)] == pieces.merge(word, coder.model.scores)
    assert wrong >= 50


def test_digests_of_a_table(spark, library):
    rows = [(i, t, "x", 3) for i, t in enumerate(HARD)] + [(None, "a null id", None, None), (5, None, None, None), (5, "again", "n", 1), (5, "again", "n", 1)]
    rows.append((99, "lorem ipsum " * 60_000 + "é" * 70_000, "x", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, n_tokens int")
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, pieces.digests(docs).collect()), key=str) == sorted(want, key=str)
    assert pieces.digests(docs.limit(0)).count() == 0
    back = pieces.decode(pieces.encode(docs.where("doc_id < 90")))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(i, library.decode(library.encode(t or ""))) for i, t, *_ in rows if i is not None and i < 90}


def test_other_models_are_an_error(tmp_path):
    path = tmp_path / "other.model"
    path.write_bytes(b"\x12\x02\x18\x01")  # a trainer of type 1
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Model(str(path))
