"""Quality bands hold clean prose of every script, at every length, and reject noise."""

from __future__ import annotations

import base64
import random

import public_tokenizers
import pytest

from cargoscope.llm import fertility
from tests.llm.prose import PROSE


def verdict(script, text):
    return fertility.judge(script, *FIGURES.figures(text.encode().split(), len("".join(text.split()))))


FIGURES = fertility.Fertility(public_tokenizers.path(fertility.TOKENIZER))


@pytest.mark.parametrize("script", fertility.BANDS)
def test_clean_prose_is_kept(script):
    texts = PROSE["latin"][1:2] if script == "vietnamese" else [t for t in PROSE[script] if not t.startswith("Tất")]
    for text in texts:
        assert fertility.script_of(text) == script
        w = text.split()
        for n in (10, len(w) // 2, len(w)):
            assert verdict(script, " ".join(w[:n])), (script, n)
        # More tokens but no more kinds, against the highest floor; Latin sub-words never come to an end so early.
        assert script == "latin" or verdict(script, " ".join(w * 3)), script
        noise = " ".join(w[0][:1] * 6 for _ in range(60))
        assert not verdict(script, noise), script


def test_fertility_and_fallback_decide():
    rng = random.Random(1)
    for noise in (
        " ".join(rng.randbytes(16).hex() for _ in range(30)),
        " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(30)),
        " ".join("x" + str(rng.randrange(10**9)) for _ in range(60)),
    ):
        script = fertility.script_of(noise)
        figures = FIGURES.figures(noise.encode().split(), len("".join(noise.split())))
        low, high, _ = fertility.BANDS[script]
        assert not low <= figures[1] <= high and not fertility.judge(script, *figures)
    rare = " ".join(w + chr(rng.randrange(0xE000, 0xF8FF)) for w in PROSE["latin"][0].split())
    figures = FIGURES.figures(rare.encode().split(), len("".join(rare.split())))
    assert figures[2] > fertility.BANDS["latin"][2] and not fertility.judge("latin", *figures)
