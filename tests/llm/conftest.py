import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


@pytest.fixture
def shingle_set():
    return shingles
