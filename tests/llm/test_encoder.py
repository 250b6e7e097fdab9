"""The encoder of packing against the tokenizer itself, over texts of odd letters."""

import random
import struct

import public_tokenizers
from tokenizers import Tokenizer
from tracelake.llm import packing

#: Letters that change in lower case or when composed, marks, signs, strings of special tokens, white space beyond ASCII.
PIECES = [
    *"aAbcDeEfgGiIzZ", "é", "É", "İ", "ı", "ß", "ẞ", "ſ", "K", "Å", "Ω", "ǅ", "ﬁ", "Σ", "ς", "ü", "ü", "é", "İ", "́", "̇", "क", "कि", "한", "ᄒ", "中", "ʼ",
    "0", "9", "½", "²", "١", "Ⅷ", ".", ",", "..", ".,", "'", "'s", "'ll", "-", "_", "!", "…", "。", "<|endoftext|>", "<|startoftext|>", "<|", " ", " ", "​", "‍", "\x00", "\x1f", "\U0001f600", "\U0001f468‍\U0001f469",
]


def test_ids_are_the_tokenizers(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3000)  # so that caches are dropped on the way
    rng = random.Random(20)
    words = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 7))) + rng.choice(["", "", ".", ","]) for _ in range(4000)]
    words += ["GELDİ.", "GELDİ,", "GELDİ", "geldi.", "Straße.", "ΟΔΟΣ,", "x" * 3000, "É" * 500 + "."]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t\x0b ", "\r\n"]) for _ in range(rng.randrange(25))) for _ in range(10_000)] + ["", " ", "GELDİ. GELDİ, geldi."]
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path, 2)
    for lo in range(0, len(texts), 512):
        some = texts[lo : lo + 512]
        for text, coded, e in zip(some, encoder.encode(some), tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
            assert list(struct.unpack(f"<{len(coded) // 4}I", coded)) == [*e.ids, 2], text
