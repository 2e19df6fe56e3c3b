"""Texts and reference definitions for the tests of this folder."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, chunk string, row string, id string, removed string, keep string"


def words_of(text):
    """Lower-cased words, by the letter of the definition."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles_of(text, n=5):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def make_texts(seed=5, n=40):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(120)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 90))) for _ in range(n)]
    out = list(base)
    for t in base[:15]:  # near copies
        w = t.split(" ")
        for k in range(0, len(w), 31):
            w[k] = r.choice(vocab)
        out.append(" ".join(w))
    out += [base[0], base[0].upper(), base[1] + "\n" + base[2], "", None, " \n\t ", "one two", "ONE  two", "x" * 5000, " ".join(vocab * 60), "中文 👍 é́ <|endoftext|> a.b@c.de 1.2.3.4"]
    return out
