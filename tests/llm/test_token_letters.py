"""Ids of letters before stops, for all code points and for random texts, against the library's encoding of whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from quakeframe.llm import tokens

TEXT = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


def ids_of(texts):
    ids, at = tokens.encode_texts(pa.array(texts), "letters", TEXT, 2)
    return [ids[a : b - 1].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def held_against_library(texts):
    tok = Tokenizer.from_str(TEXT)
    for lo in range(0, len(texts), 20_000):
        part = texts[lo : lo + 20_000]
        want = [e.ids for e in tok.encode_batch_fast(part, add_special_tokens=False)]
        wrong = [(t, g, w) for t, g, w in zip(part, ids_of(part), want, strict=True) if g != w]
        assert not wrong, wrong[:3]


def test_every_code_point_before_a_stop():
    letters = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    held_against_library([f"{c};" for c in letters])
    held_against_library([f"a{c}. b" for c in letters if np.sum([c.isalpha()])])


def test_random_texts_with_stops():
    rng = random.Random(9)
    some = [*"aäßéİÿZ09", "क़", "ড়", "יִ", "é", "Ⅻ", "½", "ⁿ", "中", "ー", "'s", "<|im_end|>", "_", *",.;:!? \n\t\xa0"]
    held_against_library(["".join(rng.choices(some, k=rng.randint(1, 25))) for _ in range(20_000)])


def test_letters_with_marks():
    """A small letter may join with a mark behind it where its capital doesn't."""
    import string

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        text = f.read()
    tool = Tokenizer.from_str(text)
    texts = [f"x{a}{chr(m)}y {a}{chr(m)}." for a in string.ascii_letters for m in range(0x300, 0x370)]
    ids, at = tokens.encode_texts(pa.array(texts), "marks", text, 2)
    want = [e.ids for e in tool.encode_batch(texts, add_special_tokens=False)]
    assert [ids[i : j - 1].tolist() for i, j in zip(at, at[1:], strict=False)] == want
