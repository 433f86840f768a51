"""Counts of n-grams do not depend on how a long text is cut, nor does memory on its length."""

import tracemalloc
from collections import Counter

import numpy as np
import pytest

from arbora.llm import language_id


def plain(text):
    flat, out = [0], Counter()
    for ch in text.lower():
        flat += [ord(ch)] if ch.isalpha() else [0] if flat[-1] else []
    flat += [0] if flat[-1] else []
    if not any(flat):
        return {}
    for i, c in enumerate(flat):
        if c:
            out[c] += 1
        if i:
            out[1 << 63 | flat[i - 1] << 21 | c] += 1
        if i > 1:
            out[flat[i - 2] << 42 | flat[i - 1] << 21 | c] += 1
    return dict(out)


TEXTS = ["", "a", "ab", " a", "a ", "  ", "1 2", "Ab, cd -- éÉ x\U0001f642y", "a" * 9, "one  two   three", "İstanbul ΣΑΣ", "ab" * 50 + "  " * 9 + "c"]


@pytest.mark.parametrize("piece,merge", [(1 << 18, 1 << 20), (1, 1), (2, 3), (3, 1 << 20), (7, 5)])
def test_any_piece(monkeypatch, piece, merge):
    monkeypatch.setattr(language_id, "PIECE", piece)
    monkeypatch.setattr(language_id, "MERGE", merge)
    for text in TEXTS:
        codes, counts = language_id.grams(text.encode())
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == plain(text), text
        assert codes.dtype == np.uint64 and (np.diff(codes.astype(object)) > 0).all()
    assert len(language_id.grams(None)[0]) == 0


def test_memory_of_long_texts():
    text = b"some words and then more of them, all of the same kind " * 400_000  # 22 MB
    language_id.grams(b"warm")
    tracemalloc.start()
    codes, counts = language_id.grams(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * len(text) and counts.sum() > len(text)
