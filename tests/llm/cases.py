"""Texts that every operator must get through, and random near copies."""

from __future__ import annotations

import random

LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(20_000))

#: null, empty, blank, marks only, special strings, odd spaces, other scripts, ties, very long.
ODD = [None, "", " ", "\n\n \t\n", "...!!! ---", "a <|endoftext|> b <|endoftext|><|endoftext|>", "<s> </s> <unk> <0x0A>",
       "it's we'll I'D  you’re", "é  b​ \x85 \x1c z\x0b\x0c", "日本語 テスト 123½²³ ٣", "🙂🙂 \U0001F468‍\U0001F469",
       "\x00\x01 a\tb\r\n c", "▁▁a ▁ b", "  lead", "trail  ", "x" * 5000, "a" * 3000 + " b " * 2000, "﻿bom �",
       "same text twice", "same text twice", "SAME text TWICE", LONG]

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, k long, t string, h long, fp long, row long, component_id long, _text_h long"


def documents(texts):
    return [(i, t, ("en", "de", None)[i % 3], "s", len(t) if t is not None else None) for i, t in enumerate(texts)]


def prose(seed, words, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x{r.randrange(9)}" for _ in range(words))


def edited(text, seed, changes=1):
    r = random.Random(seed)
    ws = text.split(" ")
    for _ in range(changes):
        ws[r.randrange(len(ws))] = f"edit{r.randrange(10 ** 6)}"
    return " ".join(ws)


class Groups:
    """Union-find for brute-force components."""

    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def sets(self):
        out = {}
        for x in self.up:
            out.setdefault(self.find(x), set()).add(x)
        return sorted(map(sorted, out.values()))
