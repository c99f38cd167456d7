"""Values of terms are learnt in place: same signatures as by the formula, one array a step."""

import random
from collections import Counter

import numpy as np
import xxhash

from ravelin.llm import fingerprints
from ravelin.llm.common import mix


def test_mixed_is_mix_in_place():
    x = np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    want, got = mix(x), fingerprints.mixed(x)
    assert got is x and (got == want).all()


def test_values_of_terms():
    s = fingerprints.Signer()
    words = [f"w{i}" for i in range(700)]  # more than a block
    s(" ".join(words))
    h = s.terms[:700]
    unit = lambda v: ((v >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * ((v & np.uint64(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-64)
    log = lambda k: -np.log(np.minimum(unit(mix(h[:, None] ^ s.salts[k])), np.float32(1 - 2**-20)))
    assert (s.r[:700] == log(0)).all() and (s.c[:700] == np.log(log(1))).all()


def by_formula(text):
    """The signature of one text, by the formula in the module's docstring, word by word."""
    if not text:
        return b""
    f32, salts = np.float32, mix(np.arange(1, 3 * fingerprints.SAMPLES + 1, dtype=np.uint64)).reshape(3, -1)
    unit = lambda v: np.minimum(((v >> np.uint64(32)).astype(f32) + f32(0.5)) * ((v & np.uint64(0xFFFFFFFF)).astype(f32) + f32(0.5)) * f32(2.0**-64), f32(1 - 2**-20))
    low, code = np.full(fingerprints.SAMPLES, np.inf, f32), np.zeros(fingerprints.SAMPLES, np.uint64)
    for w, n in Counter(text.split() or [text]).items():
        h = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))], np.uint64)
        r, c = -np.log(unit(mix(h ^ salts[0]))), np.log(-np.log(unit(mix(h ^ salts[1]))))
        b = (mix(h ^ salts[2]) >> np.uint64(40)).astype(f32) * f32(2.0**-24)
        t = np.floor(np.log(f32(n)) / r + b) if n > 1 else np.zeros_like(b)
        a = c - r * (t - b) - r if n > 1 else c - r * (f32(1) - b)
        better = a < low
        low, code = np.where(better, a, low), np.where(better, mix(h ^ mix(t.astype(np.int64).astype(np.uint64) + np.uint64(1))), code)
    return code.astype("<u2").tobytes()


class Small(fingerprints.Signer):
    """Bounds that some hundred words go beyond."""

    MOST, FULL, SPARE, CHARS, STEP, BLOCK, PART = 120, 8, 16, 900, 32, 8, 16


def test_groups_and_bounds_change_nothing():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["é", "слово", "\U0001f600"] * 20
    texts = [draw.choice([" ", "\n", "  ", "　"]).join(draw.choices(words, k=draw.choice([1, 2, 9, 40, 90]))) for _ in range(60)]
    texts += ["", None, " ", " \n  ", "\x1f", " a", "a ", " a a\x85b ", "x\ud800 y y", " ".join(f"v{i % 170}" for i in range(400)), "z" * 2000, "aa aa aa"]
    draw.shuffle(texts)
    want = [by_formula(t) for t in texts]
    for signer in (fingerprints.Signer(), Small()):
        assert signer.sign(texts) == want
        assert [signer(t) for t in texts[::7]] == want[::7]
    assert fingerprints.Signer().sign([]) == []


def test_values_of_a_word_are_made_once_for_a_group():
    """The values of words were forgotten and made again each time that 40,000 had come by."""
    signer, made = fingerprints.Signer(), []
    values = signer._values
    signer._values = lambda terms: (made.append(len(terms)), values(terms))[1]
    texts = [" ".join(f"w{(i * 500 + j) % 60_000}" for j in range(500)) for i in range(240)]  # each word in two texts, 60,000 words apart
    signer.sign(texts)
    assert sum(made) == 60_000
